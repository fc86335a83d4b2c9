"""Near-duplicate lines by a segment-partition edit join.

All lines but blank ones are compared, after trimming: those of at least `least` characters (the
shorter of two counts) are alike within k edits, those of ONE and more within one, shorter ones
if equal, by their digests. A line within k edits of another holds one of that line's k + 1 even segments unchanged, near the same place. Each line
emits, for every length it could match, the substrings at the places where a segment may lie
(windows aware of how many segments precede); lines that share one are candidates, verified by
a banded bit-parallel edit distance. Keys hold the length and the segment's number, so lists
are of lines of like length only. As in the shingle join, each list is first linked to one
line of it (linear), links are contracted, and only lists of several components are joined
with themselves across them: components are exact. Such a list may be long (lines of one
pattern), so the join's condition holds what an edit can change at most: the parities of the
counts of letters (two of 64) and of pairs of letters (four of 128). What it lets through is
little but lines that are alike.

A class's first line, by doc_id and place, stays. Repeats within a document go. Repeats of
other documents' lines go as well, whatever their share, but for one case: a document over half
of which is copied (is_copy) keeps its copied lines if it is verified to be a near copy of one
other document, which document-level joins catch. Verified means that the exact lines that it
shares with that document, and of which that document has the first, are SAME of the characters
that the two hold together.

Nulls: a null text has no lines and stays null. A null doc_id comes first in the order. Rows of
equal doc_id and text are one document and share its decision. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, mix, staged, table
from .graph import connected_components

EDITS, LEAST = 2, 40
#: Shorter lines than LEAST, from here on, may differ by one edit.
ONE = 20
BITMAP = 1 << 24
SAME = 0.9


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: Myers' bit vectors over the 2k + 1 diagonals around the main one."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    lo, most = 0, len(b)
    while lo < most and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < most - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    m, n = len(a), len(b)
    if n <= k and m <= k:
        return True
    mask, diagonal = (1 << 2 * k + 1) - 1, 1 << k
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i + k
    # Bit r stands for row j - k + r of column j; vertical steps up (vp) and down (vn).
    vp, vn, score = mask & ~(diagonal - 1), 0, 0
    for j, c in enumerate(b):
        x = rows.get(c, 0) >> j & mask
        d0 = ((x & vp) + vp ^ vp | x | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if not d0 & diagonal:
            score += 1
            if score > 2 * k:
                return False
        d0 >>= 1
        vp, vn = (hn | ~(d0 | hp)) & mask, d0 & hp
    # From the main diagonal down the last column to the last row.
    for r in range(m - n):
        score += (vp >> k + r & 1) - (vn >> k + r & 1)
    return score <= k


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """k + 1 even segments [start, end); the later ones are the longer by at most one."""
    short, longer = divmod(length, k + 1)
    ends = [short * (i + 1) + max(0, i + 1 - (k + 1 - longer)) for i in range(k + 1)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def probes(length: int, k: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(length of the other line, segment, start, end) of each substring that may hold a segment of a line no longer than this one."""
    for other in range(max(least, length - k), length + 1):
        gap = length - other
        for i, (lo, hi) in enumerate(segments(other, k)):
            first = max(0, lo - i, lo + gap - (k - i))
            last = min(length - (hi - lo), lo + i, lo + gap + (k - i))
            for at in range(first, last + 1):
                yield other, i, at, at + hi - lo


def edits(length: int, k: int, least: int) -> int:
    """Edits that a line of this length, the shorter of two, may be apart."""
    return k if length >= least else min(1, k) if length >= ONE else 0


def all_probes(length: int, k: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """probes() by the edits that go with the other line's length."""
    yield from probes(length, k, least)
    if k and ONE < least:
        yield from (x for x in probes(length, 1, ONE) if x[0] < least)


def line_id(line: str) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(line)).view(np.int64))


def long_lines(text: str | None, least: int) -> list[tuple[int, str]]:
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if len(s := x.strip()) >= least]


def _keys(docs: DataFrame, k: int, least: int) -> DataFrame:
    """key, lid, n of each line's substrings, once a task."""

    def rows(state, text):
        import xxhash

        seen, plans = state
        key, lid, size = [], [], []
        digest = xxhash.xxh3_64_intdigest
        for t in text:
            for _, line in long_lines(t, min(least, ONE)):
                own = line_id(line)
                if own in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(own)
                n = len(line)
                if n not in plans:
                    if len(plans) > 5000:
                        plans.clear()
                    plans[n] = [(a, b, other * (k + 1) + i) for other, i, a, b in all_probes(n, k, least)]
                got = [digest(line[a:b], seed) for a, b, seed in plans[n]]
                key += got
                lid += [own] * len(got)
                size += [n] * len(got)
        return {"key": np.array(key, np.uint64).view(np.int64), "lid": np.array(lid, np.int64), "n": np.array(size, np.int32)}

    return map_arrow(docs.select("text"), rows, "key long, lid long, n int", setup=lambda: (set(), {}), limit=250_000)


def parities(line: str) -> tuple[int, int, int]:
    """Whether each of 64 classes of letters, and of 128 of pairs of letters, is held an odd number of times. An edit flips 2 bits of the first and 4 of the others at most."""
    codes = np.frombuffer(f"\n{line}\n".encode("utf-32-le"), np.uint32).astype(np.uint64)
    letters = np.bincount((mix(codes[1:-1]) & np.uint64(63)).astype(np.int64), minlength=64)
    pairs = np.bincount((mix(codes[:-1] << np.uint64(32) | codes[1:]) & np.uint64(127)).astype(np.int64), minlength=128)
    odd = np.packbits((np.concatenate([letters, pairs]) & 1).astype(np.uint8)).view("<i8")
    return tuple(odd.tolist())


def _texts(docs: DataFrame, live: DataFrame, least: int) -> DataFrame:
    """lid, line, bits of the lines in live; a bitmap of fixed size keeps most others out of the join."""
    wanted = live.select("lid").distinct()
    cell = F.pmod("lid", F.lit(BITMAP))
    words = wanted.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(lid, {BITMAP}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP >> 6, np.uint64)
    bitmap[words["w"].to_numpy().astype(np.int64)] = words["bits"].to_numpy().view(np.uint64)

    def rows(seen, text):
        lid, line = [], []
        for t in text:
            for _, s in long_lines(t, min(least, ONE)):
                own = line_id(s)
                if own not in seen and int(bitmap[own % BITMAP >> 6]) >> (own % 64) & 1:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(own)
                    lid.append(own)
                    line.append(s)
        return {"lid": lid, "bits": [parities(x) for x in line], "line": line}

    read = map_arrow(docs.select("text"), rows, "lid long, bits array<long>, line string", setup=set)
    return read.join(wanted, "lid", "left_semi").groupBy("lid").agg(F.first("line").alias("line"), F.first("bits").alias("bits"))


def _pairs(found: DataFrame, k: int) -> DataFrame:
    kept = found.where(f"lid <> p_lid and abs(n - p_n) <= {k}")
    return kept.select(F.least("lid", "p_lid").alias("a"), F.greatest("lid", "p_lid").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, least: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")

    def rows(_, a, b, x, y):
        ok = [i for i in range(len(a)) if within(x[i], y[i], edits(min(len(x[i]), len(y[i])), k, least))]
        return {"src": [a[i] for i in ok], "dst": [b[i] for i in ok]}

    return map_arrow(both.select("a", "b", "x", "y"), rows, "src long, dst long")


def line_links(docs: DataFrame, k: int = EDITS, least: int = LEAST) -> DataFrame:
    """(node, component) of the distinct lines that are alike but not equal to another, by their ids."""
    spans = Window.partitionBy("key")
    keys = _keys(docs, k, least).withColumns({"lo": F.min("lid").over(spans), "hi": F.max("lid").over(spans)})
    live = staged(keys.where("lo <> hi").select("key", "lid", "n").distinct(), "line-keys")
    texts = staged(_texts(docs, live, least), "lines")
    tops = live.groupBy("key").agg(F.min(F.struct("n", "lid")).alias("p"))
    star = live.join(tops, "key").select("lid", "n", F.col("p.lid").alias("p_lid"), F.col("p.n").alias("p_n"))
    stars = staged(_pairs(star, k), "line-stars")
    links = staged(_verified(stars, texts, k, least), "line-links")
    parts = staged(connected_components(links), "line-parts")

    named = live.join(parts, live["lid"] == parts["node"], "left").select("key", "lid", "n", F.coalesce("component", "lid").alias("c"))
    several = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rest = staged(named.join(several, "key", "left_semi").join(texts.select("lid", *[F.col("bits")[i].alias(f"b{i}") for i in range(3)]), "lid"), "line-rest")
    other = rest.select("key", *[F.col(c).alias(f"p_{c}") for c in ("lid", "n", "c", "b0", "b1", "b2")])
    flips = [F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"p_b{i}"))) for i in range(3)]
    able = (F.abs(F.col("n") - F.col("p_n")) <= k) & (flips[0] <= 2 * k) & (flips[1] + flips[2] <= 4 * k)
    across = _pairs(rest.join(other, "key").where("c < p_c").where(able), k).join(stars, ["a", "b"], "left_anti")
    return connected_components(links.unionByName(_verified(across, texts, k, least)))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, line_no, lid, n of every line that isn't blank."""

    def rows(_, doc_id, text):
        out = {c: [] for c in ("doc_id", "text_id", "line_no", "lid", "n")}
        for d, t in zip(doc_id, text, strict=True):
            lines = long_lines(t, 1)
            own = line_id(t) if lines else 0
            for c, v in zip(out, ([d] * len(lines), [own] * len(lines), [i for i, _ in lines], [line_id(s) for _, s in lines], [len(s) for _, s in lines]), strict=True):
                out[c] += v
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, text_id long, line_no int, lid long, n int")


def repeated_lines(docs: DataFrame, k: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, text_id, repeated, copied, their characters, and near_copy: each document's lines that repeat its own or an earlier document's, where there are any, and whether it is a near copy of one other."""
    parts = staged(line_links(docs, k, least), "line-parts").select(F.col("node").alias("lid"), "component")
    lines = staged(occurrences(docs).distinct(), "occurrences")
    seen = lines.join(parts, "lid", "left").withColumn("c", F.coalesce("component", "lid")).drop("component")
    groups = seen.groupBy("c").agg(F.min(F.struct("doc_id", "text_id", "line_no", "lid")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    own = Window.partitionBy("doc_id", "text_id", "c").orderBy("line_no")
    both = staged(seen.join(groups, "c").withColumn("nth", F.row_number().over(own)), "line-repeats")
    here = F.struct("doc_id", "text_id").eqNullSafe(F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.text_id").alias("text_id")))
    again, elsewhere = F.col("nth") > 1, (F.col("nth") == 1) & ~here
    marks = both.groupBy("doc_id", "text_id").agg(
        F.collect_list(F.when(again, F.col("line_no"))).alias("repeated"),
        F.collect_list(F.when(elsewhere, F.col("line_no"))).alias("copied"),
        F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("repeated_chars"),
        F.coalesce(F.sum(F.when(elsewhere, F.col("n"))), F.lit(0)).alias("copied_chars"),
    )
    # Characters of distinct lines: all less own repeats.
    told = lines.select("doc_id", "text_id", "n").unionByName(both.where(again).select("doc_id", "text_id", (-F.col("n")).alias("n")))
    sizes = told.groupBy("doc_id", "text_id").agg(F.sum("n").alias("chars"))
    shared = both.where(elsewhere & (F.col("lid") == F.col("first.lid"))).groupBy("doc_id", "text_id", F.col("first.doc_id").alias("o_doc"), F.col("first.text_id").alias("o_text")).agg(F.sum("n").alias("shared"))
    one, other = sizes.toDF("s_doc", "s_text", "chars"), sizes.toDF("p_doc", "p_text", "o_chars")
    pairs = shared.join(one, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("text_id") == F.col("s_text"))).where(F.col("shared") >= SAME * F.col("chars"))
    pairs = pairs.join(other, F.col("o_doc").eqNullSafe(F.col("p_doc")) & (F.col("o_text") == F.col("p_text"))).where(F.col("shared") >= SAME * (F.col("chars") + F.col("o_chars") - F.col("shared")))
    near = pairs.select(F.col("doc_id").alias("n_doc"), F.col("text_id").alias("n_text")).distinct().withColumn("near", F.lit(True))
    known = marks.join(near, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("text_id") == F.col("n_text")), "left")
    return known.withColumn("near_copy", F.coalesce("near", F.lit(False))).drop("n_doc", "n_text", "near").where("size(repeated) + size(copied) > 0")


def deduplicated(docs: DataFrame, k: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs with text less its repeated lines, and n_lines, n_repeated, n_copied, is_copy, n_kept."""
    marks = repeated_lines(docs, k, least)
    names = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*names).alias("_rest"), "text")

    def identify(_, i, rest, text):
        return {"_id": i, "_rest": rest, "_text_id": [line_id(t or "") for t in text], "text": text}

    rest_type = packed.schema["_rest"].dataType.simpleString()
    known = map_arrow(packed, identify, f"_id long, _rest {rest_type}, _text_id long, text string")
    got = known.join(marks, known["_id"].eqNullSafe(marks["doc_id"]) & (known["_text_id"] == marks["text_id"]), "left").drop("doc_id", "text_id")
    lines = F.split("text", "\n")
    zero = lambda c: F.coalesce(F.size(c), F.lit(0))
    copy = F.coalesce(2 * F.col("copied_chars") > F.length("text") - F.col("repeated_chars"), F.lit(False))
    got = got.withColumn("is_copy", copy)
    drop = F.when(F.col("is_copy") & F.col("near_copy"), F.col("repeated")).otherwise(F.concat("repeated", "copied"))
    kept = F.filter(lines, lambda _, i: ~F.array_contains(drop, i))
    text = F.when(F.col("repeated").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.size(drop), F.lit(0))
    extra = [F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), zero("repeated").alias("n_repeated"), zero("copied").alias("n_copied"), "is_copy", (F.coalesce(F.size(lines), F.lit(0)) - gone).alias("n_kept")]
    columns = [text.alias("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns]
    return got.select(F.struct(*columns).alias("doc"), F.struct(*extra).alias("lines"))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """docs less repeated lines, n_chars to match; documents of which nothing but white space is left go, if lines were taken from them."""
    out = deduplicated(docs).where("lines.n_kept = lines.n_lines or trim(doc.text) <> ''")
    chars = F.when(F.col("lines.n_kept") < F.col("lines.n_lines"), F.length("doc.text")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[(chars.cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document's lines."""
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "lines.*", F.length("doc.text").alias("kept_chars"), F.sha2("doc.text", 256).alias("text_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES: dict[str, str] = {}
