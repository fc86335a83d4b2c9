"""Interleaved document sequences with media columns.

Pages are parsed into ordered elements, text and media references, each with its position and
a reference with its caption. Media live apart, as rows of a table under the digest of their
bytes; references join them by digest, so positions and captions stay with the reference
whatever happens to the payload. A reference without a payload keeps null media columns.

Payloads are stored losslessly as 8-bit grey images (binary PGM: a header, then one byte a
sample) of TILE x TILE samples a tile; features are computed from the samples read back.

Nulls: a null text or page is empty: an empty text has one tile of padding, an empty page no
elements. Equal payloads have equal digests and join as one. Repeated rows give repeated
rows. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, staged, table
from .markup import Markup

TILE = 24
UNIT = TILE * TILE
ELEMENTS = "array<struct<position:int,kind:string,text:string,reference:string,caption:string>>"
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "section", "article", "blockquote", "pre", "br", "ul", "ol", "table", "body"}
_SILENT = {"script", "style", "template", "noscript", "title"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(Markup):
    """Collects the elements of one page."""

    def __init__(self):
        super().__init__()
        self.elements: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def _end_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.elements.append({"kind": "text", "text": text, "reference": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self._end_text()
            self.figure = []
        elif tag == "figcaption":
            self._end_text()
            self.caption = []
        elif tag in _MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self._end_text()
                e = {"kind": "media", "text": None, "reference": found["src"], "caption": found.get("alt") or None}
                self.elements.append(e)
                if self.figure is not None:
                    self.figure.append(e)
        elif tag in _BLOCKS:
            self._end_text()

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for e in self.figure or []:
                e["caption"] = text or e["caption"]
            self.caption = None
        elif tag == "figure":
            self._end_text()
            self.figure = None
        elif tag in _BLOCKS:
            self._end_text()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def elements_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._end_text()
    return [{"position": i, **e} for i, e in enumerate(parser.elements)]


def parse_pages(pages: DataFrame, key: str) -> DataFrame:
    """key, elements of each page (key, html)."""
    rows = lambda _, k, html: {"key": k, "elements": [elements_of(h) for h in html]}
    return map_arrow(pages.select(F.col(key).cast("long").alias("key"), "html"), rows, f"key long, elements {ELEMENTS}")


def resolve(parsed: DataFrame, media: DataFrame) -> DataFrame:
    """A row an element, key, position and the rest, with the columns of media (digest, ...) of references "sha256:<digest>".

    media has a row a digest; what it carries should be small, as it is shuffled.
    """
    flat = parsed.select("key", F.explode("elements").alias("e")).select("key", "e.*")
    flat = flat.withColumn("digest", F.regexp_extract("reference", "^sha256:([0-9a-f]{64})$", 1))
    return flat.join(media, "digest", "left")


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def encode_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (TILE, len(payload) // TILE) + payload


_HEADER = re.compile(rb"P5\n(\d+) (\d+)\n255\n")


def decode_image(stored: bytes) -> np.ndarray:
    """Samples of a stored image, rows by columns."""
    head = _HEADER.match(stored)
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(stored, np.uint8, width * height, head.end()).reshape(height, width)


def feature_of(samples: np.ndarray) -> str:
    """Mean, spread and 16 shares of brightness in thousandths, and mean steps across and down."""
    x = samples.astype(np.float64)
    shares = np.bincount((samples >> 4).ravel(), minlength=16) * 1000 // samples.size
    across, down = (np.abs(np.diff(x, axis=a)).mean() if x.shape[a] > 1 else 0.0 for a in (1, 0))
    return f"{x.mean():.3f}:{x.std():.3f}:{across:.3f}:{down:.3f}:" + ",".join(map(str, shares.tolist()))


def store_texts(docs: DataFrame) -> DataFrame:
    """Write doc_id, digest, media of each text's payload; returns the table as read back."""

    def rows(_, doc_id, text):
        payloads = [payload_of(t) for t in text]
        return {"doc_id": doc_id, "n_bytes": [len((t or "").encode()) for t in text], "digest": [hashlib.sha256(p).hexdigest() for p in payloads], "media": [encode_image(p) for p in payloads]}

    return staged(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_bytes long, digest string, media binary"), "media")


def media_facts(media: DataFrame) -> DataFrame:
    """One row a digest with sizes, checksums and feature, all from stored bytes."""

    def rows(_, stored):
        samples = [decode_image(s) for s in stored]
        payloads = [s.tobytes() for s in samples]
        digests = [hashlib.sha256(p).hexdigest() for p in payloads]
        return {
            "digest": digests, "payload_bytes": [len(p) for p in payloads], "tail_crc32": [zlib.crc32(p[-32:]) for p in payloads],
            "media_bytes": [len(s) for s in stored], "media_sha256": [hashlib.sha256(s).hexdigest() for s in stored], "feature": [feature_of(s) for s in samples],
        }

    facts = map_arrow(media.select("media"), rows, "digest string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return facts.groupBy("digest").agg(*[F.first(c).alias(c) for c in facts.columns if c != "digest"])


def op2_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image, met again through a page that refers to it by digest."""
    stored = store_texts(table(spark, sf_dir, "documents"))
    refs = stored.select("doc_id", "n_bytes", "digest")
    # A page's key is its document; n_bytes travels as the caption.
    html = F.format_string('<p>text of a document</p><figure><img src="sha256:%s"><figcaption>%d bytes</figcaption></figure>', "digest", "n_bytes")
    pages = refs.select("doc_id", html.alias("html"))
    found = resolve(parse_pages(pages, "doc_id"), media_facts(stored)).where("kind = 'media'")
    return found.select(
        F.col("key").alias("doc_id"), F.regexp_extract("caption", "^(\\d+) bytes$", 1).cast("long").alias("n_bytes"), "payload_bytes",
        F.col("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "position",
    )


QUERIES = {"op2_media_sequences": op2_media_sequences}
ORACLES: dict[str, str] = {}
