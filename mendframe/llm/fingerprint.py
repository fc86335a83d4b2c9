"""Document fingerprints by randomised edit embedding.

A pointer walks over a text's characters; at each step it emits the character it stands on and
moves on if a random bit, shared by all texts and drawn from the step and the character, says
so. Texts of few edits fall back into step soon after each edit, so edit distance becomes
Hamming distance of the walks. A fingerprint keeps 4 bits of the emitted character at sampled
steps: steps are ranked by a fixed hash, and a text of n characters keeps those of level L and
above, which leaves at most KEEP. Samples of a higher level are a subset of a lower one's, so
texts of different lengths compare at the higher level.

Likeness is the share of equal samples, of the longer's. Banding joins texts one of whose BANDS
bands of WIDTH sampled steps agrees: at likeness 0.75 that is 94 in 100, more above. Pairs are
verified by likeness. Each text is first linked to the least one that it shares most bands with,
links are contracted, and lists that still hold several components are joined with themselves
across them, on condition that few samples differ, which their bits tell: no similar pair of a
list is left out.

Nulls: a null text is empty, its fingerprint "0:", like another empty text 1 and any other 0. Rows
of equal doc_id are ordered by text. Null doc_ids come first; a component of them alone has the
id null. A single row is its own next. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import among, cells, map_arrow, mix, staged, table
from .graph import connected_components

KEEP = 256
WIDTH, BANDS = 7, 20
BLOCK = 1 << 12
#: Longs that hold the four bits of each sample, one bit after the other; those of the first.
PLANES = [f"q{i}" for i in range(16)]
PLANE = PLANES[:4]
_CLASS = (mix(np.arange(1, 1 << 16, dtype=np.uint64)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def _classes(text: str) -> np.ndarray:
    """A class from 1 to 255 of each character; equal characters, equal classes."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _CLASS[codes % np.uint32(65521)]


@functools.lru_cache(maxsize=24)
def _moves(block: int) -> np.ndarray:
    """For each step of a block, whether each class moves the pointer on. Class 0, the end, never does."""
    bits = np.random.Generator(np.random.PCG64([20240917, block])).integers(0, 2, (BLOCK, 256), np.uint8)
    bits[:, 0] = 0
    return bits


@functools.lru_cache(maxsize=24)
def _levels(block: int) -> np.ndarray:
    """The level of each step: trailing zero bits of its hash."""
    h = mix(np.arange(block * BLOCK + 1, (block + 1) * BLOCK + 1, dtype=np.uint64))
    low = h & (~h + np.uint64(1))
    return np.where(h == 0, 63, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64)


def level_of(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, 2 * n) / KEEP))))


@functools.lru_cache(maxsize=64)
def _sampled_levels(level: int, blocks: int) -> np.ndarray:
    """Levels of the steps of at least that level, in order."""
    all_levels = np.concatenate([_levels(b) for b in range(blocks)])
    return all_levels[all_levels >= level]


def walk(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(level, samples) of each text. All texts step together; longer ones stand first, so that the rest drop out from the end."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out: list[tuple[int, np.ndarray]] = [(0, np.empty(0, np.uint8))] * len(texts)
    order = [i for i in order if texts[i]]
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    classes = np.concatenate([x for i in order for x in (_classes(texts[i]), np.zeros(1, np.uint8))])
    pos = np.cumsum(sizes + 1) - sizes - 1
    levels = np.array([level_of(n) for n in sizes])
    groups = [(int(v), int(np.searchsorted(-levels, -v)), int(np.searchsorted(-levels, -v, side="right"))) for v in np.unique(levels)]
    kept: dict[int, list[np.ndarray]] = {v: [] for v, _, _ in groups}
    active, step = len(order), 0
    while active:
        block, at = divmod(step, BLOCK)
        if at == 0:
            moves, step_levels = _moves(block), _levels(block).tolist()
        here = classes[pos[:active]]
        for v, lo, hi in groups:
            if v > step_levels[at]:
                break
            if lo < active:
                kept[v].append(here[lo:hi])
        pos[:active] += moves[at][here]
        step += 1
        if step % 64 == 0:
            left = np.flatnonzero(classes[pos[:active]])
            active = int(left[-1]) + 1 if len(left) else 0
    for v, lo, hi in groups:
        rows = kept[v]
        grid = np.zeros((len(rows), hi - lo), np.uint8)
        for k, r in enumerate(rows):
            grid[k, : len(r)] = r
        for d in range(lo, hi):
            samples = grid[:, d - lo]
            n = int(np.flatnonzero(samples)[-1]) + 1 if samples.any() else 0
            out[order[d]] = (v, samples[:n] & 15)
    return out


def text_of(fp: tuple[int, np.ndarray]) -> str:
    return f"{fp[0]}:" + "".join(map("0123456789abcdef".__getitem__, fp[1].tolist()))


def parse(fp: str) -> tuple[int, np.ndarray]:
    level, _, digits = fp.partition(":")
    return int(level), np.array([int(c, 16) for c in digits], np.uint8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of equal samples at the higher of both levels."""
    level = max(a[0], b[0])
    x, y = (s if v == level else s[_at_level(v, level, len(s))] for v, s in (a, b))
    most = max(len(x), len(y))
    if not most:
        return 1.0 if len(a[1]) == len(b[1]) else 0.0
    m = min(len(x), len(y))
    return float(np.count_nonzero(x[:m] == y[:m]) / most)


def packed(samples: np.ndarray) -> bytes:
    """Two samples a byte."""
    even = np.append(samples, np.zeros(len(samples) % 2, np.uint8))
    return (even[::2] | even[1::2] << 4).astype(np.uint8).tobytes()


def unpacked(data: bytes, m: int) -> np.ndarray:
    both = np.frombuffer(data, np.uint8)
    return np.stack([both & 15, both >> 4], axis=1).ravel()[:m]


def _at_level(own: int, level: int, n: int) -> np.ndarray:
    blocks = 1
    while len(_sampled_levels(own, blocks)) < n:
        blocks *= 2
    return _sampled_levels(own, blocks)[:n] >= level


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the start of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _facts(doc_id: list, texts: list[str], following: list[str]) -> dict:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # A text's follower is mostly the next text of the list: walk each distinct text once.
    distinct = list(dict.fromkeys([*texts, *changed, *following]))
    fps = dict(zip(distinct, walk(distinct), strict=True))
    return {
        "doc_id": doc_id, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in changed],
        "fingerprint": [text_of(fps[t]) for t in texts], "edited_fingerprint": [text_of(fps[c]) for c in changed],
        "near_edited": [likeness(fps[t], fps[c]) for t, c in zip(texts, changed, strict=True)],
        "near_next": [likeness(fps[t], fps[f]) for t, f in zip(texts, following, strict=True)],
    }


def fingerprints_with_next(docs: DataFrame, together: int = 4_000_000) -> DataFrame:
    """Fingerprint of every text, of its edited form, and their likeness.

    Documents are range-partitioned by doc_id and sorted, so a document's next is the next row;
    a partition's last document meets the first of the next partition in a table that has one
    row a partition.
    """

    schema = docs.sparkSession.createDataFrame([], _ROW + ", part int, first_text string, last_text string").schema

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        part = TaskContext.get().partitionId()

        def batch(facts: dict, **edge) -> pa.RecordBatch:
            n = len(facts["doc_id"])
            return pa.RecordBatch.from_arrays([pa.array(facts.get(f.name, edge.get(f.name, [None] * n)), type=f.type) for f in arrow], schema=arrow)

        ids: list = []
        texts: list[str] = []
        held, started = 0, False
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or ""
                if not started:
                    started = True
                    yield batch({"doc_id": [None]}, part=[part], first_text=[t])
                ids.append(d)
                texts.append(t)
                held += len(t) + 1
                if held > together and len(ids) > 1:
                    yield batch(_facts(ids[:-1], texts[:-1], texts[1:]))
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield batch(_facts(ids[:-1], texts[:-1], texts[1:]))
        if ids:
            yield batch({"doc_id": ids[-1:]}, part=[part], last_text=texts[-1:])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = staged(ordered.mapInArrow(run, schema), "fingerprints")
    whole = found.where("part is null").drop("part", "first_text", "last_text")
    edges = found.where("part is not null")
    ends = edges.where("last_text is not null").select("part", "doc_id", F.col("last_text").alias("text"))
    # Which partition comes next: a row of numbers for each; texts then meet by a join.
    by_part = Window.orderBy("part")
    least = F.min("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = ends.select("part").withColumn("next", F.coalesce(F.lead("part").over(by_part), least))
    firsts = edges.where("first_text is not null").select(F.col("part").alias("next"), F.col("first_text").alias("following"))
    pairs = ends.join(following, "part").join(firsts, "next").select("doc_id", "following", "text")
    return whole.unionByName(staged(map_arrow(pairs, lambda _, i, following, text: _facts(i, text, following), _ROW), "fingerprints-at-edges"))


@functools.lru_cache(maxsize=64)
def _band_steps(level: int) -> np.ndarray:
    """For each band which samples of that level it takes."""
    return np.random.Generator(np.random.PCG64([7, level])).integers(0, KEEP // 2, (BANDS, WIDTH))


def band_keys(fp: tuple[int, np.ndarray]) -> list[int]:
    """A 64-bit key of level, band and samples for each band; also of the next higher level, if texts a third longer are there."""
    out, (own, samples) = [], fp
    for level in (own, own + 1) if 3 * KEEP < 5 * len(samples) else (own,):
        s = samples if level == own else samples[_at_level(own, level, len(samples))]
        if len(s) <= KEEP // 4:  # short texts have bands of what is there
            steps = _band_steps(level) % max(1, len(s))
            bands = s[steps] if len(s) else np.empty((0, WIDTH), np.uint8)
            out += [_key(len(s) // 8 + up, level, k, b) for k, b in enumerate(bands) for up in (0, 1)]
            continue
        steps = _band_steps(level)
        for k in np.flatnonzero((steps < len(s)).all(axis=1)).tolist():
            out.append(_key(0, level, k, s[steps[k]]))
    return out


def _key(group: int, level: int, band: int, samples: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(bytes([group & 255, level, band]) + samples.tobytes())).view(np.int64))


def similar_by_fingerprint(fps: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, fingerprint, component_id of rows (doc_id, fingerprint): the least doc_id of those linked. Linked are equal fingerprints, and those of a common band key whose likeness is enough."""
    named = fps.select("doc_id", "fingerprint", F.xxhash64("fingerprint").alias("cid"))
    classes = named.groupBy("cid").agg(F.min("doc_id").alias("rep"))

    def keys_of(seen, cid, fp):
        out = {"key": [], "cid": []}
        for c, f in zip(cid, fp, strict=True):
            if c not in seen and f != "0:":
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                got = set(band_keys(parse(f)))
                out["key"] += got
                out["cid"] += [c] * len(got)
        return out

    keys = map_arrow(named.select("cid", F.col("fingerprint").alias("fp")), keys_of, "key long, cid long", setup=set)
    span = Window.partitionBy("key")
    live = staged(keys.withColumns({"lo": F.min("cid").over(span), "hi": F.max("cid").over(span)}).where("lo <> hi").select("key", "cid", "lo").distinct(), "bands")

    def bits_of(_, cid, fp):
        out = {"cid": cid, "level": [], "m": [], **{q: [] for q in PLANES}, "samples": []}
        for f in fp:
            level, s = parse(f)
            out["level"].append(level)
            out["m"].append(len(s))
            first = np.zeros(KEEP, np.uint8)
            first[: min(len(s), KEEP)] = s[:KEEP]
            for q, bits in zip(PLANES, np.packbits(np.concatenate([first >> k & 1 for k in range(4)])).view("<i8").tolist(), strict=True):
                out[q].append(bits)
            out["samples"].append(packed(s))
        return out

    distinct = named.join(live.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.first("fingerprint").alias("fp"))
    known = staged(map_arrow(distinct, bits_of, f"cid long, level int, m int, {', '.join(f'{q} long' for q in PLANES)}, samples binary"), "band-texts")

    def able(planes: list[str]) -> Column:
        """Whether so many samples agree as far as these bits tell. Of different levels, they say nothing."""
        apart = [F.col(q).bitwiseXOR(F.col(f"p_{q}")) for q in planes]
        differ = sum((F.bit_count(functools.reduce(Column.bitwiseOR, apart[i::4])) for i in range(4)), F.lit(0))
        return (F.col("level") != F.col("p_level")) | (differ <= (1 - least) * F.greatest("m", "p_m"))

    def promising(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose first bits agree enough."""
        planes = known.select("cid", "level", "m", *PLANE)
        b = planes.select(F.col("cid").alias("b"), *[F.col(c).alias(f"p_{c}") for c in ("level", "m", *PLANE)])
        return pairs.join(planes.withColumnRenamed("cid", "a"), "a").join(b, "b").where(able(PLANE)).select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        """Links (src, dst) of staged pairs that are alike. A bitmap of fixed size keeps most other texts out of the joins."""
        bitmap = cells(pairs.select(F.explode(F.array("a", "b")).alias("cid")), "cid")

        def wanted(batches):
            for batch in batches:
                yield batch.filter(among(bitmap, batch.column(0).to_numpy()))

        texts = known.select("cid", "level", "m", "samples")
        texts = texts.mapInArrow(wanted, texts.schema)
        side = lambda c: texts.select(F.col("cid").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("level", "m", "samples")])
        both = pairs.join(side("a"), "a").join(side("b"), "b")

        def verify(_, a, b, *sides):
            ok = [i for i, (u, m, x, v, n, y) in enumerate(zip(*sides, strict=True)) if likeness((u, unpacked(x, m)), (v, unpacked(y, n))) >= least]
            return {"src": [a[i] for i in ok], "dst": [b[i] for i in ok]}

        return map_arrow(both.select("a", "b", *[f"{k}_{c}" for c in "ab" for k in ("level", "m", "samples")]), verify, "src long, dst long")

    shared = live.where("cid <> lo").groupBy("cid", "lo").agg(F.count("*").alias("n"))
    stars = staged(shared.groupBy("cid").agg(F.max_by("lo", F.struct("n", "lo")).alias("a")).select("a", F.col("cid").alias("b")), "band-stars")
    links = staged(linked(staged(promising(stars), "band-pairs")), "band-links")
    parts = staged(connected_components(links), "band-parts")

    def of_several(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = live.join(parts, live["cid"] == parts["node"], "left").select("key", "cid", F.coalesce("component", "cid").alias("c"))
        return held, held.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.min(F.struct("c", "cid")).alias("p")).where("least <> most").select("key", "p")

    # A second star, around the least component of each list that holds several: most lists are of one then.
    held, several = of_several(parts)
    again = held.join(several, "key").where("c <> p.c").select(F.col("p.cid").alias("a"), F.col("cid").alias("b")).distinct()
    links = staged(links.unionByName(linked(staged(promising(again), "band-pairs"))), "band-links")
    held, several = of_several(staged(connected_components(links), "band-parts"))
    # Dealt once for both sides.
    rest = staged(held.join(several, "key", "left_semi").join(known.drop("samples"), "cid"), "band-rest").repartition("key")
    other = rest.select("key", *[F.col(c).alias(f"p_{c}") for c in ("cid", "c", "level", "m", *PLANES)])
    across = rest.join(other, "key").where("c < p_c").where(able(PLANES)).select(F.least("cid", "p_cid").alias("a"), F.greatest("cid", "p_cid").alias("b"))
    across = staged(across.distinct().join(stars, ["a", "b"], "left_anti"), "band-pairs")
    parts = connected_components(links.unionByName(linked(across)))
    members = parts.join(classes, parts["node"] == classes["cid"]).select("cid", "component", "rep")
    names = members.groupBy("component").agg(F.min("rep").alias("name"))
    own = classes.join(members.join(names, "component").select("cid", "name"), "cid", "left").select("cid", F.coalesce("name", "rep").alias("component_id"))
    return named.join(own, "cid").select("doc_id", "fingerprint", "component_id")


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the component of documents that bands and verification link."""
    found = fingerprints_with_next(table(spark, sf_dir, "documents"))
    groups = similar_by_fingerprint(found.select("doc_id", "fingerprint")).select(F.xxhash64("fingerprint").alias("_cid"), "component_id").distinct()
    return found.join(groups, F.xxhash64("fingerprint") == F.col("_cid")).drop("_cid")


QUERIES = {"op9_edit_fingerprints": op9_edit_fingerprints}
ORACLES: dict[str, str] = {}
