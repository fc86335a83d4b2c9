"""Best-fit packing of token pieces into sequences by bin completion.

Documents are encoded, an end id is appended, and only what exceeds a sequence is cut. A
packing depends on the pieces' lengths alone, so the search runs over the histogram of
lengths (at most `capacity` numbers, whatever the corpus): the largest remaining length is
completed by an undominated filling of what is left around it, and the filling is repeated
as often as its lengths last. Best-fit decreasing gives the incumbent; branch and bound looks
for fewer sequences only, from the lower bound up, and backtracks where the waste exceeds what
that number allows. The plan is a few thousand slots, and Spark gives each piece its slot by
its rank among the pieces of its length.

Nulls: a null text is an empty document, a piece of the end id alone. Repeated rows and null
doc_ids are documents of their own. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, staged, table
from .tokens import encoder, tokenizer_path

CAPACITY = 2048

#: Bytes of runs that a worker remembers, and of texts that it encodes at once.
MEMO, SLICE = 64 << 20, 300_000


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by lengths that can't share with larger ones."""
    k = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[x] for x in k.tolist()], dtype=np.int64)
    best = max(-(-int((k * n).sum()) // capacity), int(n[2 * k > capacity].sum()))
    for t in k[2 * k <= capacity]:
        high, small = 2 * k > capacity, (k >= t) & (2 * k <= capacity)
        near = high & (k <= capacity - t)  # share with a small one perhaps
        rest = int((k * n)[small].sum() - (n * (capacity - k))[near].sum())
        best = max(best, int(n[high].sum()) + max(0, -(-rest // capacity)))
    return best


class _Left:
    """Pieces left by length, and the lengths of which there are any, ascending."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = [0] * (capacity + 1)
        for k, n in counts.items():
            self.counts[k] = n
        self.lengths = sorted(counts)

    def take(self, k: int, n: int) -> None:
        was = self.counts[k]
        self.counts[k] = was - n
        if was and was == n:
            del self.lengths[bisect_left(self.lengths, k)]
        elif not was:
            insort(self.lengths, k)


def _pair(room: int, lengths: list[int], held: Callable[[int], int], hi: int) -> tuple[int, int] | None:
    """Two lengths of that sum, the larger as large as can be."""
    lo = 0
    while lo <= hi:
        both = lengths[lo] + lengths[hi]
        if both == room and held(lengths[hi]) > (lo == hi) and held(lengths[lo]):
            return lengths[hi], lengths[lo]
        if both >= room:
            hi -= 1
        else:
            lo += 1
    return None


def _closest(room: int, lengths: list[int], held: Callable[[int], int], steps: list[int]) -> tuple[int, ...]:
    """A filling of least waste: one, two or three lengths that fit exactly, else by the sums that can be reached."""
    steps[0] -= 1
    end = bisect_right(lengths, room)
    if not end:
        return ()
    if lengths[end - 1] == room and held(room):
        return (room,)
    found = _pair(room, lengths, held, end - 1)
    if found:
        return found
    for i in range(end - 1, max(-1, end - 33), -1):
        k = lengths[i]
        if held(k):
            pair = _pair(room - k, lengths, lambda x, k=k: held(x) - (x == k), bisect_right(lengths, room - k) - 1)
            if pair:
                return (k, *pair)
    steps[0] -= 20
    reach, made = 1, []  # bit s: the lengths so far can sum to s
    for k in lengths[:end]:
        for _ in range(min(held(k), room // k)):
            made.append((k, reach))
            reach |= reach << k & (1 << room + 1) - 1
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for k, before in reversed(made):
        if total >= k and before >> total - k & 1:
            out.append(k)
            total -= k
    return tuple(out)


def _fillings(top: int, capacity: int, left: _Left, most_waste: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Sequences around the length `top` of at most that waste: the closest filling first, then all others that no larger unused length dominates.

    It reads what is left anew at each turn; the search has put that back by then.
    """
    held, room = lambda k: left.counts[k] - (k == top), capacity - top
    first = _closest(room, left.lengths, held, steps)
    if room - sum(first) > most_waste:
        return  # no filling wastes less
    yield (top, *first)
    lengths = [k for k in reversed(left.lengths) if k <= room and held(k)]

    def grow(at: int, rest: int, used: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if rest <= most_waste and used != first:
            if not any(held(x) > used.count(x) for y in {0, *used} for x in range(y + 1, min(y + rest, capacity) + 1)):
                yield (top, *used)
        for i in range(at, len(lengths)):
            k, steps[0] = lengths[i], steps[0] - 1
            if steps[0] < 0:
                return
            if k <= rest and held(k) > used.count(k):
                yield from grow(i, rest - k, (*used, k))

    yield from grow(0, room, ())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each length, from the largest, goes where it leaves the least room. Equal sequences are one entry with their number."""
    made: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by room left
    for k in sorted(counts, reverse=True):
        left, room = counts[k], k
        while left:
            while room < capacity and not made[room]:
                room += 1
            if room == capacity:
                made[capacity] = [((), left)]
            held, n = made[room].pop()
            each = min(room // k, left)  # the next pieces go to the same sequence as long as they fit
            m = min(n, left // each)
            left -= m * each
            made[room - each * k].append((held + (k,) * each, m))
            if n > m and room < capacity:
                made[room].append((held, n - m))
            made[capacity] = []
    return [x for same in made for x in same]


def plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = 50_000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): as few sequences as the search finds, best fit's at most.

    It is optimal where the count meets the lower bound or the search ends within `steps`.
    """
    counts = {k: n for k, n in counts.items() if n}
    total, bound = sum(k * n for k, n in counts.items()), lower_bound(counts, capacity)
    best, budget = best_fit(counts, capacity), [steps]
    for target in range(bound, sum(m for _, m in best)):
        found = _search(_Left(counts, capacity), capacity, target * capacity - total, budget)
        if found is not None:
            return found
        if budget[0] < 0:
            break
    return best


def _search(left: _Left, capacity: int, waste: int, steps: list[int]) -> list[tuple[tuple[int, ...], int]] | None:
    """A packing within that waste, or None. Depth first; each level holds the fillings not yet tried."""
    made: list[tuple[tuple[int, ...], int]] = []
    levels: list[Iterator] = []
    while steps[0] >= 0:
        if len(levels) == len(made):
            if not left.lengths:
                return made
            levels.append(_fillings(left.lengths[-1], capacity, left, waste, steps))
        picked = next(levels[-1], None)
        if picked is None:
            levels.pop()
            if not made:
                return None
            back, m = made.pop()
            waste += m * (capacity - sum(back))
            for k in back:
                left.take(k, -m)
            continue
        lost = capacity - sum(picked)
        m = min(left.counts[k] // picked.count(k) for k in set(picked))
        m = min(m, waste // lost) if lost else m
        waste -= m * lost
        for k in picked:
            left.take(k, m)
        made.append((picked, m))
    return None


def slots(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, offset) sorted by length and rank: the slot of each piece of a length."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, m in made:
        at = 0
        for k in lengths:
            out.append((k, used.get(k, 0), sequence, at))
            used[k] = used.get(k, 0) + m
            at += k
        sequence += m
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def encode_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 and, if kept, ids (little-endian 32-bit) of every piece."""

    def setup():
        from pyspark import TaskContext

        return {"e": encoder(path, MEMO), "row": TaskContext.get().partitionId() << 36}

    def rows(s, doc_id, text):
        ids, counts = s["e"].encode(text)
        out = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32", "ids")}
        at = 0
        for d, n in zip(doc_id, counts.tolist(), strict=True):
            raw = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4").tobytes()
            at += n
            for piece, lo in enumerate(range(0, n + 1, capacity)):
                part = raw[4 * lo : 4 * (lo + capacity)]
                for k, v in zip(out, (d, s["row"], piece, lo, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                    out[k].append(v)
            s["row"] += 1
        return out

    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema, setup=setup, limit=SLICE)


def pack(pieces: DataFrame, capacity: int = CAPACITY, each: int = 100_000) -> DataFrame:
    """pieces (row, piece, length and more) with sequence_id and offset.

    pieces is read several times and must give the same rows each time: stage it first.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan_slots = slots(plan(counts, capacity))
    parts = 1 + sum(counts.values()) // each
    split = pieces.withColumn("_part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy("length", "_part").agg(F.count("*").alias("n")).select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_part").orderBy("row", "piece")
    ranked = split.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_part", "_first")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    names = pieces.columns

    def place(batches):
        import pyarrow as pa

        key = plan_slots[:, 0] << 44 | plan_slots[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(plan_slots[at, 2] + rank - plan_slots[at, 1]), pa.array(plan_slots[at, 3])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, length, ids: the sequences themselves, from pieces that kept their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("length"), parts.alias("parts"))
    return grouped.select("sequence_id", "n_pieces", "length", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = staged(encode_pieces(docs, tokenizer_path("word_bpe_49k.json")), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
