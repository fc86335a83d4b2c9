"""Exact Jaccard self-join of word-shingle sets by multiple-global-order prefix filtering.

A document's set is its distinct 5-word shingles (as 64-bit hashes). Under any global order of
shingles, two sets of similarity t share one of the first n - ceil(t n) + 1 of each. The first
order is rare-first, by a count of all documents' shingles in a fixed number of cells; its
prefixes are the postings that are shuffled. Two further orders, ascending and descending
hash, must also agree before the sets of a pair are fetched: every class sends its prefix under
each, cut to 16 bits a shingle, and a pair must share a shingle of both. Where prefixes hold
the first quarter of the hash space, they bound how much a pair shares as well.

Texts with equal word sequences form one class from the start. Within a posting list every
class first meets one class only, that with the fewest rarer shingles (a star, linear in the
list, around what is nearest to the original of a group of copies); what is linked is
contracted, and only lists that still hold several components give pairs across them. From
the long ones of those lists classes go that can't be similar to any other of the list: a
class overlaps the others at most in the shingles that some other class of long lists has, and
two classes of a list at most in what the list's middle has and neither of them lacks, and in
what each else shares. What a class lacks of the middle is sent as 256 bits. No link between different components is lost, so components are exact.

Nulls and texts without words have an empty set and link with nothing. Documents of fewer than
5 words have one shingle. Rows with equal doc_id count as separate copies of one document.
Empty tables give no rows; other columns are ignored. A class is named by 64 bits of a digest.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, map_arrow, mix, shingle_sets, staged, table, unstage
from .graph import connected_components

CELLS = 1 << 20
BITMAP = 1 << 24
SALTS = 16
LONG_LIST = 32


def class_ids(texts: list[str | None]) -> list[int | None]:
    """64 bits of a digest of each text's lower-cased words; None without words."""
    out = []
    for t in texts:
        words = ascii_words(t)
        out.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True) if words else None)
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def heads(x: np.ndarray, percent: int = 75) -> bytes:
    """An ascending set's first shingles under either hash order, the lowest and the highest: its prefix at least, and all of a quarter of the hash space. 16 bits a shingle; those beyond the quarter are cut to one value."""
    low, high = np.searchsorted(x, np.array([1 << 62, 3 << 62], np.uint64)).tolist()
    keep = min(len(x), prefix_length(len(x), percent))
    up, down = x[: max(low, keep)], x[::-1][: max(len(x) - high, keep)]
    cut = np.concatenate([np.minimum(up, np.uint64((1 << 62) - 1)), ~np.maximum(down, np.uint64(3 << 62))]) >> np.uint64(46)
    return np.array([low, len(x) - high, len(up)], "<u4").tobytes() + cut.astype("<u2").tobytes()


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Values of one ascending array that the other has."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0


def most_shared(n: int, head: bytes, p_n: int, p_head: bytes, percent: int = 75) -> int:
    """At most so many shingles two sets share: none to speak of (0) if their prefixes under the second or the third order have none in common, else those of both quarters and the smaller rest."""
    shared, rest, p_rest = 0, n, p_n
    sizes, p_sizes = np.frombuffer(head, "<u4", 3).tolist(), np.frombuffer(p_head, "<u4", 3).tolist()
    x, y = np.frombuffer(head, "<u2", offset=12), np.frombuffer(p_head, "<u2", offset=12)
    keep, p_keep = prefix_length(n, percent), prefix_length(p_n, percent)
    for k, a, b in ((0, x[: sizes[2]], y[: p_sizes[2]]), (1, x[sizes[2] :], y[p_sizes[2] :])):
        if not _shared(a[:keep], b[:p_keep]):
            return 0
        rest, p_rest = rest - sizes[k], p_rest - p_sizes[k]
        shared += _shared(a[: sizes[k]], b[: p_sizes[k]])
    return shared + min(rest, p_rest)


def _signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, cid, n of each document, heads once a class and task and, in a last row of each partition, its counts of shingles by cell."""

    def setup():
        return {"cells": np.zeros(CELLS, np.int64), "seen": set()}

    def rows(s, doc_id, text):
        sets = shingle_sets(text, size)
        if sets:
            s["cells"] += np.bincount((np.concatenate(sets) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        ids, head = class_ids(text), []
        for c, x in zip(ids, sets, strict=True):
            head.append(None if c is None or c in s["seen"] else heads(x, percent))
            s["seen"].add(c)
        return {"doc_id": doc_id, "cid": ids, "n": [len(x) for x in sets], "head": head, "cells": [None] * len(sets)}

    def finish(s):
        return {"doc_id": [None], "cid": [None], "n": [None], "head": [None], "cells": [zlib.compress(s["cells"].tobytes(), 1)]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, cid long, n int, head binary, cells binary", setup=setup, finish=finish)


def _summed(cells: DataFrame, n: int) -> np.ndarray:
    """Sum of n partitions' counts, a tree of which each node takes some 32; one row of fixed size reaches the driver. A vector is a few hundredths of what a partition reads."""

    def total(batches):
        import pyarrow as pa

        out = np.zeros(CELLS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                out += np.frombuffer(zlib.decompress(x), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(out.tobytes(), 1)])], names=["cells"])

    while n > 1:
        n = -(-n // 32)
        cells = cells.repartition(n).mapInArrow(total, "cells binary")
    return sum((np.frombuffer(zlib.decompress(r[0]), np.int64) for r in cells.collect()), np.zeros(CELLS, np.int64))


def _postings(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """token, salt, cid, n, pos: each class's prefix under the rare-first order, once a task. salt > 0: a token of many sets."""
    hot = int(8 * counts.mean() + 20_000)
    counts = np.minimum(counts, 2**31 - 1).astype(np.int32)

    def rows(seen, doc_id, text):
        picked = []
        for i, c in enumerate(class_ids(text)):
            if c is not None and c not in seen:
                seen.add(c)
                picked.append((c, text[i]))
        sets = shingle_sets([t for _, t in picked], size)
        parts = []
        for (c, _), x in zip(picked, sets, strict=True):
            n = len(x)
            keep = prefix_length(n, percent)
            often = counts[(x % np.uint64(CELLS)).astype(np.int64)]
            first = np.lexsort((mix(x), often))[:keep]
            parts.append((x[first], np.where(often[first] > hot, 1 + c % SALTS, 0), np.full(keep, c), np.full(keep, n), np.arange(keep)))
        if not parts:
            return dict.fromkeys(("token", "salt", "cid", "n", "pos"), [])
        token, salt, cid, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"token": token.view(np.int64), "salt": salt.astype(np.int32), "cid": cid, "n": n.astype(np.int32), "pos": pos.astype(np.int32)}

    return map_arrow(docs.select("doc_id", "text"), rows, "token long, salt int, cid long, n int, pos int", setup=set)


def _sized(na: str, nb: str, percent: int) -> Column:
    return (F.col(na) * 100 >= F.col(nb) * percent) & (F.col(nb) * 100 >= F.col(na) * percent)


def _placed(percent: int) -> Column:
    """Whether sets with a common token at these places can still share enough."""
    most = F.least("pos", "p_pos") + 1 + F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos")) - 1
    return most * (100 + percent) >= (F.col("n") + F.col("p_n")) * percent


def _pairs(found: DataFrame, percent: int) -> DataFrame:
    kept = found.where((F.col("cid") != F.col("p_cid")) & _sized("n", "p_n", percent) & _placed(percent))
    return kept.select(F.least("cid", "p_cid").alias("a"), F.greatest("cid", "p_cid").alias("b")).distinct()


def _star(live: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Every posting beside the least one of its list."""
    least = live.groupBy(*keys).agg(F.min_by(F.struct("cid", "n", "pos"), order).alias("p"))
    return live.join(least, keys).select("cid", "n", "pos", F.col("p.cid").alias("p_cid"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"))


#: Four longs of bits: which of 256 classes of the middle's shingles a class lacks.
LACKS = [f"lacks{i}" for i in range(4)]
#: A posting of a long list carries so many of its class's postings before it.
BEFORE = 8


def _preceded(rest: DataFrame) -> DataFrame:
    """rest with the tokens that stand just before a posting's in its class's prefix."""
    return rest.withColumn("before", F.collect_list("token").over(Window.partitionBy("cid").orderBy("pos").rowsBetween(-BEFORE, -1)))


def _meetings(rest: DataFrame, percent: int) -> DataFrame:
    """Postings of classes of different components in one list, whose bounds let them be similar.

    core: what a class shares with its list's middle, of `whole` shingles, and lacks the others;
    extra: what else it may share. before: tokens of earlier lists; two classes that share one of
    them have met there, under bounds that hold for every list, so they meet here no more. The
    first list that two share under the common order is never passed over.
    """
    held = ["cid", "n", "pos", "c", "core", "extra", "before", *LACKS]
    other = rest.select("token", *[F.col(c).alias(f"p_{c}") for c in held])
    lacking = sum((F.bit_count(F.col(c).bitwiseOR(F.col(f"p_{c}"))) for c in LACKS), F.lit(0))
    most = F.least("core", "p_core", F.col("whole") - lacking) + F.least("extra", "p_extra")
    enough = most * (100 + percent) >= (F.col("n") + F.col("p_n")) * percent
    return rest.join(other, "token").where("c < p_c").where(enough).where(~F.arrays_overlap("before", "p_before"))


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that meet in a list."""
    return _pairs(_meetings(rest, percent), percent)


def _viable(docs: DataFrame, rest: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Shorter postings, with core and extra, of the classes of long lists; and the links (src, dst) met on the way.

    Only classes that share a list can be similar, so shingles are counted anew, exactly, over
    the classes of these lists: what only one of them has matches nothing. A class of n
    shingles overlaps another of its lists, of at least `least` shingles, in
    t / (1 + t) * (n + least) or isn't similar; that shortens its prefix. Two classes of a list
    overlap at most in what both share with a third, and in what else each shares.
    """
    sets = staged(_sets(docs, rest.select("cid"), size), "long-list-sets")
    tokens = sets.select("cid", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    tokens = staged(tokens.join(common, "token"), "common-shingles")
    classes = rest.join(tokens.groupBy("cid").agg(F.count("*").cast("int").alias("shared")), "cid").where(F.col("shared") * 100 >= F.col("n") * percent)
    classes = classes.join(classes.groupBy("token").agg(F.min("n").alias("least")), "token").groupBy("cid", "n", "shared").agg(F.min("least").alias("least"))
    need = F.ceil((F.col("n") + F.col("least")) * percent / F.lit(100 + percent))
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("times", "token"))
    ranked = tokens.join(classes.where(F.col("shared") >= need), "cid").withColumn("pos", F.col("n") - F.col("shared") + nth - 1)
    kept = staged(ranked.where(F.col("pos") <= F.col("n") - need).select("token", "cid", "n", "pos", "shared"), "viable")
    # The class of the fewest shingles of its own is nearest to what the others are copies of.
    tops = kept.groupBy("token").agg(F.min(F.struct(F.col("n") - F.col("shared"), F.col("cid"))).getField("cid").alias("top"), F.count("*").alias("m")).where("m > 1").drop("m")
    kept = kept.join(tops, "token")
    x = sets.select("cid", F.col("tokens").alias("x"))
    y = sets.select(F.col("cid").alias("top"), F.col("tokens").alias("y"))
    met = kept.select("cid", "top").distinct().join(x, "cid").join(y, "top")
    bits = lambda q: f"aggregate(array_except(y, x), 0L, (a, t) -> CASE WHEN (shiftright(t, 6) & 3) = {q} THEN a | shiftleft(1L, cast(t & 63 as int)) ELSE a END)"
    cores = met.select("cid", "top", F.size(F.array_intersect("x", "y")).alias("core"), (F.size("x") + F.size("y")).alias("both"), F.size("y").alias("whole"), *[F.expr(bits(q)).alias(c) for q, c in enumerate(LACKS)])
    cores = staged(cores, "cores")
    links = cores.where((F.col("core") * (100 + percent) >= F.col("both") * percent) & (F.col("cid") != F.col("top"))).select(F.col("cid").alias("src"), F.col("top").alias("dst"))
    return kept.join(cores.drop("both"), ["cid", "top"]).withColumn("extra", F.greatest(F.lit(0), F.col("shared") - F.col("core"))), links


def _of_several(postings: DataFrame, parts: DataFrame) -> DataFrame:
    """Postings with the component c of their class, of the lists that hold several."""
    named = postings.join(parts, postings["cid"] == parts["node"], "left").withColumn("c", F.coalesce("component", "cid")).drop("node", "component")
    several = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("token", "m")
    return named.join(several, "token")


def _sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """cid, tokens (ascending) of the classes. A bitmap of fixed size keeps most other texts out of the join."""
    cell = F.pmod("cid", F.lit(BITMAP))
    wanted = staged(classes.distinct(), "wanted")
    words = wanted.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(cid, {BITMAP}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP >> 6, np.uint64)
    bitmap[words["w"].to_numpy().astype(np.int64)] = words["bits"].to_numpy().view(np.uint64)

    def rows(seen, doc_id, text):
        ids = class_ids(text)
        keep = []
        for i, c in enumerate(ids):
            if c is not None and c not in seen and int(bitmap[c % BITMAP >> 6]) >> (c % 64) & 1:
                seen.add(c)
                keep.append(i)
        sets = shingle_sets([text[i] for i in keep], size)
        return {"cid": [ids[i] for i in keep], "tokens": [np.sort(x.view(np.int64)) for x in sets]}

    read = map_arrow(docs.select("doc_id", "text"), rows, "cid long, tokens array<long>", setup=set)
    return read.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.first("tokens").alias("tokens"))


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar by the heads of the second and third order; classes: cid, n, head."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    known = classes.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.first(F.struct("n", "head")).alias("s"))
    a = known.select(F.col("cid").alias("a"), F.col("s.n").alias("n"), F.col("s.head").alias("head"))
    b = known.select(F.col("cid").alias("b"), F.col("s.n").alias("p_n"), F.col("s.head").alias("p_head"))

    def rows(_, a, b, *both):
        able = [most_shared(n, h, m, g, percent) * (100 + percent) >= (n + m) * percent for n, m, h, g in zip(*both, strict=True)]
        return {"a": [x for x, ok in zip(a, able, strict=True) if ok], "b": [x for x, ok in zip(b, able, strict=True) if ok]}

    return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "n", "p_n", "head", "p_head"), rows, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (src, dst): pairs that agree under the second and third order and whose whole sets are similar."""
    sets = staged(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("cid")), size), "sets")
    a = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    prefix = lambda c: f"(size({c}) - cast(ceil(size({c}) * {percent} / 100.0) as int) + 1)"
    up = f"arrays_overlap(slice(x, 1, {prefix('x')}), slice(y, 1, {prefix('y')}))"
    down = f"arrays_overlap(slice(x, -{prefix('x')}, {prefix('x')}), slice(y, -{prefix('y')}, {prefix('y')}))"
    both = f"size(array_intersect(x, y)) * {100 + percent}L >= (size(x) + size(y)) * {percent}L"
    similar = pairs.join(a, "a").join(b, "b").where(F.expr(f"CASE WHEN NOT {up} THEN false WHEN NOT {down} THEN false ELSE {both} END"))
    links = staged(similar.select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    unstage(sets)
    return links


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    first = staged(_signatures(docs, size, percent), "signatures")
    cells = first.where("cells is not null").select("cells")
    counts = _summed(cells, cells.count())
    sigs = first.where("cells is null").select("doc_id", "cid", "n")
    heads_of = first.where("head is not null").select("cid", "n", "head")

    keys = ["token", "salt"]
    spans = Window.partitionBy(*keys)
    posts = _postings(docs, counts, size, percent)
    ranged = posts.withColumns({"lo": F.min("cid").over(spans), "hi": F.max("cid").over(spans)})
    live = staged(ranged.where("lo <> hi or salt > 0").select("token", "salt", "cid", "n", "pos").distinct(), "postings")
    least = F.struct("pos", "n", "cid")
    stars = _pairs(_star(live, keys, least), percent)
    tops = live.where("salt > 0").groupBy(*keys).agg(F.min_by(F.struct("cid", "n", "pos"), least).alias("p")).select("token", "p.*")
    stars = staged(stars.unionByName(_pairs(_star(tops, ["token"], least), percent)).distinct(), "stars")
    links = _verified(docs, staged(_promising(stars, heads_of, percent), "promising"), size, percent)
    parts = staged(connected_components(links), "parts")

    # Lists that still hold several components: every pair across them that may be similar.
    rest = staged(_of_several(live.select("token", "cid", "n", "pos"), parts).distinct(), "rest")
    across = _across(rest.where(f"m < {LONG_LIST}").withColumns({"core": F.col("n"), "extra": F.lit(0), "whole": F.col("n"), "before": F.array().cast("array<long>"), **dict.fromkeys(LACKS, F.lit(0).cast("long"))}), percent)
    long, met = _viable(docs, rest.where(f"m >= {LONG_LIST}").drop("c", "m"), size, percent)
    links = staged(links.unionByName(met), "links")
    long = _of_several(staged(long, "long"), staged(connected_components(links), "parts"))
    across = across.unionByName(_across(_preceded(long), percent))
    across = staged(across.distinct().join(stars, ["a", "b"], "left_anti"), "across")
    more = _verified(docs, staged(_promising(across, heads_of, percent), "promising"), size, percent)
    parts = staged(connected_components(links.unionByName(more)), "parts")

    classes = sigs.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"))
    linked = parts.withColumnRenamed("node", "cid").join(classes, "cid")
    names = linked.groupBy("component").agg(F.min("rep").alias("name"))
    linked = linked.join(names, "component").select("cid", "name")
    classes = classes.join(linked, "cid", "left").select("cid", F.coalesce("name", "rep").alias("component_id"))
    out = sigs.join(classes, "cid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """docs with one document of each component, that of the least doc_id, once; documents without words all stay.

    Of rows with that same doc_id one stays, the least by text. Rows travel as one struct, so
    that no column of theirs meets one of this stage's.
    """
    named = staged(similar_documents(docs, size, percent).where("doc_id is not null"), "components")
    gone = named.where("component_id <> doc_id").select("doc_id").distinct()
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("doc"))
    kept = packed.join(gone, "doc_id", "left_anti")
    again = named.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept.select("doc.*")
    again = staged(again, "repeated-ids")
    first = Window.partitionBy("doc_id").orderBy("doc.text")
    once = kept.join(again, "doc_id").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc_id", "doc")
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select("doc.*")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 5-word shingle similarity 0.75."""
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}

#: All pairs that share a shingle, and reachability by recursion.
_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.y, c.r FROM c JOIN e ON e.x = c.doc_id)
SELECT c.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY 1
"""
ORACLES = {"op3_ngram_jaccard": _SQL}
