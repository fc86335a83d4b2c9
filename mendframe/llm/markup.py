"""HTML parsing that no markup stops."""

from __future__ import annotations

from html.parser import HTMLParser


class Markup(HTMLParser):
    """The library's parser, with sections of an unknown kind (<![foo[..) taken as comments up to the next >, as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.rawdata.find(">", i + 3) + 1 or -1

    def parse_declaration(self, i: int) -> int:
        return self.rawdata.find(">", i + 2) + 1 or -1
