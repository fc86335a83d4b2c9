"""Token counts of document sections by offset-mapped attribution.

A document is encoded once, as a whole, so that its token count doesn't depend on how it is
cut. Each token's character span then meets the sections' spans (an interval join: both are
sorted by position, so it is a merge). A token that crosses a boundary goes, whole, to the
section that holds its first character (rule "first") or most of its characters ("most", the
earlier one on a tie).

Sections of a row may touch but not overlap; tokens outside every section count for none and
are given as section -1 where there are any. Null texts and null section lists are empty:
they give no rows. Repeated rows are counted each by itself. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .tokens import encoder, tokenizer_path


def token_spans(text: str, ids: np.ndarray, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of a byte-level tokenizer's ids; a token that starts inside a character starts at that character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(byte_lengths[ids])
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that start before each byte
    starts = ends - byte_lengths[ids]
    inside = np.zeros(len(raw) + 1, np.int64)
    inside[:-1] = (raw & 0xC0) == 0x80
    return before[starts] - inside[starts], before[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str = "first") -> np.ndarray:
    """For each token the number of its section, or -1. Sections are sorted and disjoint."""
    if not len(lo):
        return np.full(len(starts), -1)
    at = np.searchsorted(lo, starts, side="right") - 1
    held = np.where((at >= 0) & (starts < hi[np.maximum(at, 0)]), at, -1)
    if rule == "most":
        for i in np.flatnonzero((held < 0) | (ends > hi[np.maximum(at, 0)])):
            a, b = np.searchsorted(hi, starts[i], side="right"), np.searchsorted(lo, ends[i])
            if a < b:
                share = np.minimum(hi[a:b], ends[i]) - np.maximum(lo[a:b], starts[i])
                held[i] = a + int(np.argmax(share))
    return held


def line_sections(text: str) -> list[dict]:
    """A section a line, each with its line feed."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")]).tolist()
    ends[-1] -= 1
    return [{"start": a, "end": b} for a, b in zip([0, *ends[:-1]], ends, strict=True) if a < b]


def attribute_tokens(docs: DataFrame, path: str, sections: str | None = None, rule: str = "first") -> DataFrame:
    """doc_id, section, start, end, n_tokens, doc_tokens.

    sections: a column of array<struct<start,end>> in characters; None takes the lines.
    """

    def rows(state, *columns):
        doc_id, given, text = columns if sections else (columns[0], None, columns[1])
        enc, sizes = state
        ids, counts = enc.encode(text)
        out = {k: [] for k in ("doc_id", "section", "start", "end", "n_tokens", "doc_tokens")}
        at = 0
        for k, (d, t, n) in enumerate(zip(doc_id, text, counts.tolist(), strict=True)):
            own, at = ids[at : at + n], at + n
            spans = sorted(given[k] or [], key=lambda s: s["start"]) if sections else line_sections(t or "")
            lo, hi = (np.array([s[x] for s in spans], np.int64) for x in ("start", "end"))
            held = attribute(*token_spans(t or "", own, sizes), lo, hi, rule)
            got = np.bincount(held + 1, minlength=len(spans) + 1)
            first = 0 if got[0] else 1
            m = len(spans) + 1 - first
            out["doc_id"] += [d] * m
            out["section"] += range(first - 1, len(spans))
            out["start"] += ([None] if got[0] else []) + lo.tolist()
            out["end"] += ([None] if got[0] else []) + hi.tolist()
            out["n_tokens"] += got[first:].tolist()
            out["doc_tokens"] += [n] * m
        return out

    def setup():
        e = encoder(path)
        return e, e.byte_lengths()

    picked = docs.select(F.col("doc_id").cast("long"), *([sections] if sections else []), "text")
    return map_arrow(picked, rows, "doc_id long, section int, start long, end long, n_tokens long, doc_tokens long", setup=setup)


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded once."""
    return attribute_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op4_token_attribution": op4_token_attribution}
ORACLES: dict[str, str] = {}
