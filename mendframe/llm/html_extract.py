"""Main text of web pages: host suffix arrays over all pages, article structure as a guard.

Parts that structure marks as something else (menus, headers, footers, sidebars, notices,
adverts, forms, comments) go. The other blocks of every page, marked by an article or main
element or not, are one token stream of 32 bits of each token's hash. A host's distinct
streams are cut into shards of about SHARD tokens, each with a suffix array (sorted to RUN
tokens by prefix doubling). A run of RUN tokens is boilerplate if LEAST_PAGES and LEAST_SHARE of
the host's distinct streams hold it. That count is over the whole host: a run that meets it has
a fair part of it in some shard, which names it a candidate by hash; the candidates' streams
are then counted over all pages by an aggregation. Shards read 16 bits a token, so they name
a few runs too many at most; the count is by all 32. Only hashes are shuffled, and the blocks
of the pages that hold boilerplate.

Covered runs go, unique runs stay. Article and main elements are a guard only: where a page
would lose over half of their tokens it is a copy of an article, and keeps them whole.

Nulls: a null page has the text ""; null urls are one host; null page_ids pass through.
Repeated rows give repeated rows and count once as a page. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _MUL, among, cells, map_arrow, mix, release, slices, staged, table, word_hashes
from .markup import Markup

RUN, SHARD, LEAST_PAGES, LEAST_SHARE = 8, 200_000, 3, 0.2

# Fixed values of HTML.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_DROP = {"head", "script", "style", "noscript", "template", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "audio", "video"}
#: Those that mark what they hold as something other than the article.
_MARK = {"nav", "footer", "aside", "form", "dialog", "menu"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"article", "main", "body", "div", "section", "ul", "ol", "table", "td", "th", "blockquote", "nav", "aside", "footer", "header", "form", "figure"}
#: Words in class and id that mark something other than the article.
_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "sidebar", "breadcrumb",
    "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "replies", "respond", "widget", "skip", "copyright",
}
_HEADER = {"header", "head"}
#: Those that mark an article element as a reader's comment or as something beside the article.
_NOT_ARTICLE = {"comment", "comments", "disqus", "replies", "reply", "respond", "related", "recommended", "promo", "promotion", "sponsor", "sponsored", "ad", "ads", "advert", "advertisement", "teaser"}
#: Words that say nothing beside those above: where and how something stands on a page.
_PLACES = {
    "bar", "box", "list", "links", "link", "item", "items", "slot", "unit", "wrap", "wrapper", "container", "inner", "outer", "area", "block", "panel", "section", "group", "row", "site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "side", "sticky", "fixed", "mobile",
    "desktop", "header", "head", "posts", "post", "articles", "stories", "form", "icons", "buttons", "button", "thread", "user", "reader", "line", "text", "message", "js", "the",
}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _named(attrs: dict) -> set[str]:
    """Words of classes and the id that mark something else: of names that hold nothing but such words, places and numbers."""
    found: set[str] = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = {w.lower() for w in _PART.findall(name)}
        if words <= _WORDS | _PLACES | _NOT_ARTICLE:
            found |= words & (_WORDS | _HEADER | _NOT_ARTICLE)
    return found


def _hidden(tag: str, attrs: dict) -> bool:
    """Whether an element shows no text of the page."""
    return tag in _DROP or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style") or ""))


def _mark(tag: str, attrs: dict, in_main: bool) -> str | None:
    """"beside", "form" or "other" for an element that its tag, role or name marks as something else than the article; None if nothing does."""
    names = _named(attrs)
    if tag in ("html", "body", "main"):
        return None
    if names & (_NOT_ARTICLE if tag == "article" else _NOT_ARTICLE & _WORDS):
        return "beside"
    if tag == "article":
        return None
    if tag == "form" and not names & _WORDS:
        return "form"
    if tag in _MARK or (attrs.get("role") or "").lower() in _ROLES or names & _WORDS or not in_main and (tag == "header" or names & _HEADER):
        return "other"
    return None


class _Page(Markup):
    """Text blocks of one page, whether an article or main element holds each, and which marked elements do.

    An element that is marked keeps what it holds if that is the page itself: an article or
    main element (and, for what stands beside articles, most of the text as well), or, for a
    form, which may wrap a page, most of its text.
    """

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, bool, str | None, bool]] = []  # tag, hidden above, article or main, marked
        self.blocks: list[str] = []
        self.inside: list[bool] = []
        self.under: list[tuple[int, ...]] = []
        self.text: list[str] = []
        self.dropped = False
        self.zones = {"article": 0, "main": 0}
        self.marks: list[int] = []  # open marked elements, by number
        self.kinds: list[str] = []  # of all marked elements
        self.holds: set[int] = set()  # those with an article or main element inside

    def _flush(self) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            self.text = []
            if block:
                self.blocks.append(block)
                self.inside.append(any(self.zones.values()))
                self.under.append(tuple(self.marks))

    def _pop(self) -> None:
        tag, self.dropped, zone, marked = self.open.pop()
        if zone:
            self.zones[zone] -= 1
        if marked:
            self.marks.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self._flush()
        shut = _CLOSES.get(tag)
        if shut:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in shut:
                    while len(self.open) > i:
                        self._pop()
                    break
                if self.open[i][0] in _SCOPE:
                    break
        if tag in _VOID:
            return
        found = {k: v for k, v in attrs}
        was = self.dropped
        self.dropped = was or _hidden(tag, found)
        zone, kind = None, None
        if not self.dropped:
            kind = _mark(tag, found, any(self.zones.values()))
            if kind:
                if tag in _INLINE:  # its text is apart from its line's
                    self._flush()
                self.marks.append(len(self.kinds))
                self.kinds.append(kind)
            else:
                zone = "article" if tag == "article" else "main" if tag == "main" or (found.get("role") or "").lower() == "main" else None
                if zone:
                    self.zones[zone] += 1
                    self.holds.update(self.marks)
        self.open.append((tag, was, zone, kind is not None))

    def handle_endtag(self, tag):
        if any(t[0] == tag for t in self.open):
            if tag in _INLINE and not self._near(tag):
                return
            at = max(i for i, t in enumerate(self.open) if t[0] == tag)
            if tag not in _INLINE or any(t[3] for t in self.open[at:]):
                self._flush()
            while len(self.open) > at:
                self._pop()
        elif tag not in _INLINE:
            self._flush()

    def _near(self, tag: str) -> bool:
        """Whether no block stands between here and the open inline element."""
        for t, *_ in reversed(self.open):
            if t == tag:
                return True
            if t not in _INLINE:
                return False
        return False

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)


    def kept(self) -> list[int]:
        """Places of the blocks that no marked element takes away."""
        sizes = [len(b) for b in self.blocks]
        most, held = sum(sizes) / 2, [0] * len(self.kinds)
        for n, under in zip(sizes, self.under, strict=True):
            for m in under:
                held[m] += n
        gone = [not (held[m] > most and m in self.holds if kind == "beside" else m in self.holds or kind == "form" and held[m] > most) for m, kind in enumerate(self.kinds)]
        return [i for i, under in enumerate(self.under) if not any(gone[m] for m in under)]


def parts_of(html: str | None) -> tuple[list[str], list[bool]]:
    """The page's blocks, and whether an article or main element holds each."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page._flush()
    kept = page.kept()
    return [page.blocks[i] for i in kept], [page.inside[i] for i in kept]


def blocks_of(html: str | None) -> tuple[bool, list[str]]:
    """(whether the page marks its article, its blocks)."""
    blocks, inside = parts_of(html)
    return any(inside), blocks


def stream_of(blocks: list[str]) -> np.ndarray:
    """32 bits of each token's hash, over all blocks."""
    return (word_hashes([w.encode() for b in blocks for w in b.split(" ")]) >> np.uint64(32)).astype("<u4")


def counted(streams: list[np.ndarray], kinds: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Over all streams, each with one place after its end: the run of `run` tokens that starts at each place, and on how many kinds of streams each run is."""
    lengths = np.array([len(s) for s in streams], np.int64)
    # One array of all streams, each ended by a token of its own, so that no run crosses pages.
    tokens = np.concatenate([np.append(s.astype(np.int64), -1 - k) for k, s in enumerate(streams)])
    page = np.repeat(np.arange(len(streams)), lengths + 1)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:  # ranks by the first `width` tokens of each suffix, doubled
        step = min(width, run - width)
        later = np.full(len(rank), -1, np.int64)
        later[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + later + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    order = np.lexsort((kinds[page], rank))  # the suffix array, equal runs together
    first = np.append(True, (np.diff(rank[order]) != 0) | (np.diff(kinds[page][order]) != 0))
    return rank, np.bincount(rank[order][first])


def run_hashes(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Over the places of counted(): 64 bits of the run that starts there, and whether it ends on its page."""
    lengths = np.array([len(s) for s in streams], np.int64)
    h = np.concatenate([np.append(s, 0) for s in streams]).astype(np.uint64) if streams else np.empty(0, np.uint64)
    rolled = np.full(len(h), run, np.uint64)
    for i in range(run):
        rolled = mix(rolled ^ np.append(h[i:], np.zeros(min(i, len(h)), np.uint64)) * _MUL[i % len(_MUL)] ^ np.uint64(i))
    left = np.repeat(np.cumsum(lengths + 1) - 1, lengths + 1) - np.arange(len(h))
    return rolled.view(np.int64), left >= run


def covered(starts: np.ndarray, lengths: list[int], run: int = RUN) -> list[np.ndarray]:
    """For each stream which tokens lie in a run that starts at one of the places."""
    ends = np.cumsum(np.array(lengths, np.int64) + 1)
    n = int(ends[-1]) if len(ends) else 0
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + run, n), -1)
    inside = np.cumsum(marks)[:-1] > 0
    return [inside[e - k - 1 : e - 1] for e, k in zip(ends, lengths, strict=True)]


def recurring(streams: list[np.ndarray], run: int = RUN, least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> list[np.ndarray]:
    """For each token stream which tokens lie in a run of `run` tokens that recurs on enough distinct streams."""
    if not any(map(len, streams)):
        return [np.zeros(0, bool) for _ in streams]
    kinds = np.unique([hash(s.tobytes()) for s in streams], return_inverse=True)[1]
    rank, on_pages = counted(streams, kinds, run)
    return covered(np.flatnonzero(on_pages[rank] >= max(least, int(np.ceil(share * (kinds.max() + 1))))), [len(s) for s in streams], run)


def unique_runs(blocks: list[str], covered: np.ndarray, run: int = RUN) -> list[str]:
    """Blocks less what is covered: whole blocks, and runs of at least `run` tokens within one. A recurring run that only spills over into a block leaves it whole."""
    kept, at = [], 0
    for b in blocks:
        words = b.split(" ")
        own, at = covered[at : at + len(words)], at + len(words)
        if own.all():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        gone = np.zeros(len(words), bool)
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            gone[lo:hi] = hi - lo >= run
        rest = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
        if rest:
            kept.append(rest)
    return kept


def main_text(blocks: list[str], inside: list[bool], gone: np.ndarray) -> str:
    """The page less covered tokens; article blocks stay whole if over half of their tokens are covered."""
    held = np.repeat(np.array(inside, bool), [b.count(" ") + 1 for b in blocks])
    if 2 * np.count_nonzero(gone & held) > np.count_nonzero(held):
        gone = gone & ~held
    return "\n".join(unique_runs(blocks, gone))


def streams_of(texts: pa.Array) -> list[np.ndarray]:
    """stream_of() of each text, its blocks joined by \\n, all at once: each distinct word is hashed once."""
    words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    flat = words.flatten().dictionary_encode()
    hashes = (word_hashes([w.encode() for w in flat.dictionary.to_pylist()]) >> np.uint64(32)).astype("<u4")
    tokens = hashes[flat.indices.to_numpy()]
    parts = np.split(tokens, np.cumsum(pc.list_value_length(words).to_numpy())[:-1]) if len(texts) else []
    return [s if n else s[:0] for s, n in zip(parts, pc.binary_length(texts).to_pylist(), strict=True)]


def coarse(stream: np.ndarray) -> np.ndarray:
    """16 of each token's 32 bits. Equal runs stay equal, so that runs counted by them are a few too many at most."""
    return (stream >> np.uint32(16)).astype("<u2")


def _arrow(df: DataFrame, rows: Callable[..., dict], schema: str, limit: int = 4_000_000) -> DataFrame:
    """Apply rows(*Arrow columns) -> columns to slices of some `limit` bytes of the last column."""
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for lo, hi in slices(batch.column(batch.num_columns - 1), limit):
                out = rows(*batch.slice(lo, hi - lo).columns)
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, target)


def boilerplate(parsed: DataFrame, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """host, run of the runs that enough distinct streams of their host hold; and the kinds of the pages that may hold one, all of these and few others. parsed: host, kind, n_tokens, text."""
    by_kind = parsed.groupBy("host", "kind").agg(F.first("n_tokens").alias("n"))
    need = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.count("*") * LEAST_SHARE)).cast("long")
    hosts = by_kind.groupBy("host").agg((1 + F.floor(F.sum("n") / size)).alias("shards"), need.alias("need"))

    def shipped(host, kind, text):
        return {"host": host, "kind": kind, "tokens": [coarse(s).tobytes() for s in streams_of(text)]}

    streams = _arrow(parsed.select("host", "kind", "text"), shipped, "host string, kind long, tokens binary")
    cut = streams.join(hosts, "host").withColumn("shard", F.pmod("kind", F.col("shards")))
    shards = cut.groupBy("host", "shard", "shards", "need").agg(F.collect_set(F.struct("kind", "tokens")).alias("pages"))
    shards = shards.select("host", "shards", "need", F.transform("pages", lambda p: p["kind"]).alias("kinds"), F.transform("pages", lambda p: p["tokens"]).alias("pages"))

    def name(_, host, shards, need, kinds, pages):
        out = {"host": [], "need": [], "near": []}
        for h, s, t, k, p in zip(host, shards, need, kinds, pages, strict=True):
            streams = [np.frombuffer(x, "<u2") for x in p]
            rank, on_pages = counted(streams, np.array(k, np.int64))
            run, ends = run_hashes(streams)
            found = np.unique(run[ends & (on_pages[rank] >= -(-t // s))])
            for column, v in zip(out, ([h] * len(found), [t] * len(found), found.tolist()), strict=True):
                out[column] += v
        return out

    asked = staged(map_arrow(shards, name, "host string, need long, near long", limit=400).distinct(), "runs-asked")
    bitmap = cells(asked, "near")

    def held(host, kind, text):
        streams = streams_of(text)
        near, ends = run_hashes([coarse(s) for s in streams])
        at = np.flatnonzero(ends & among(bitmap, near))
        page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])[at]
        pages, count = np.unique(page, return_counts=True)
        # Of the pages that hold any, the whole runs behind the coarse ones.
        mine = [streams[i] for i in pages.tolist()]
        whole, _ = run_hashes(mine)
        starts = np.cumsum([0, *[len(s) + 1 for s in streams]])[page]
        own = np.cumsum([0, *[len(s) + 1 for s in mine]])[np.repeat(np.arange(len(pages)), count)]
        offsets = pa.array(np.cumsum([0, *count]).astype(np.int32))
        lists = {"near": near[at], "run": whole[at - starts + own]}
        return {"host": host.take(pa.array(pages)), "kind": kind.take(pa.array(pages))} | {k: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for k, v in lists.items()}

    on = staged(_arrow(parsed.select("host", "kind", "text"), held, "host string, kind long, near array<long>, run array<long>"), "runs-held")
    each = on.select("host", "kind", F.inline(F.arrays_zip("near", "run")))
    counts = each.groupBy("host", "near", "run").agg(F.count_distinct("kind").alias("n"))
    return staged(counts.join(asked, ["host", "near"]).where("n >= need").select("host", "run"), "runs"), on.select("kind")


def extract(pages: DataFrame, size: int = SHARD) -> DataFrame:
    """page_id, url, text of every page (page_id, url, html)."""

    def rows(_, page_id, url, html):
        found = [parts_of(h) for h in html]
        return {"page_id": page_id, "url": url, "n_tokens": [sum(b.count(" ") + 1 for b in blocks) for blocks, _ in found], "inside": [i for _, i in found], "text": ["\n".join(b) for b, _ in found]}

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    picked = pages.select(F.col("page_id").cast("long"), "url", "html")
    # No block holds a \n, so the text of all gives them back.
    read = map_arrow(picked, rows, "page_id long, url string, n_tokens long, inside array<boolean>, text string")
    # Equal streams are one kind of page.
    parsed = staged(read.withColumns({"host": host, "kind": F.xxhash64(F.replace("text", F.lit("\n"), F.lit(" ")))}), "blocks")
    runs, kinds = boilerplate(parsed, size)
    bitmap = cells(kinds, "kind")

    def of(hit: bool, *names: str) -> Callable[..., dict]:
        def rows(kind, *columns):
            keep = pa.array(among(bitmap, kind.to_numpy()) == hit)
            return dict(zip(names, (c.filter(keep) for c in columns), strict=True))

        return rows

    def strip(_, page_id, url, runs, inside, text):
        texts = []
        for r, i, t, tokens in zip(runs, inside, text, streams_of(pa.array(text, pa.string())), strict=True):
            run, ends = run_hashes([tokens])
            gone = covered(np.flatnonzero(ends & np.isin(run, np.array(r or [], np.int64))), [len(tokens)])[0]
            texts.append(main_text(t.split("\n") if t else [], i, gone))
        return {"page_id": page_id, "url": url, "text": texts}

    kept = _arrow(parsed.select("kind", "page_id", "url", "text"), of(False, "page_id", "url", "text"), "page_id long, url string, text string")
    cut = _arrow(parsed.select("kind", "page_id", "url", "host", "inside", "text"), of(True, "page_id", "url", "host", "inside", "text"), "page_id long, url string, host string, inside array<boolean>, text string")
    # Each run is on a fifth of a host's streams, so a host has few: some five times a stream's at most.
    of_host = runs.groupBy("host").agg(F.collect_list("run").alias("runs"))
    cut = cut.join(of_host, "host", "left").select("page_id", "url", "runs", "inside", "text")
    return kept.unionByName(map_arrow(cut, strip, "page_id long, url string, text string"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
ORACLES: dict[str, str] = {}
