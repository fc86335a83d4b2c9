"""Token-ID output as a content-addressed store.

Documents are encoded whole, an end id is appended, and a rolling hash over the last 16 ids
cuts each id stream into chunks. A chunk is stored once under its digest; a document is a
recipe, the ordered digests of its chunks. Merkle roots (chunk -> document -> groups of
documents) are written with the store: the root of each document in its recipe, those of groups
in the manifest. A reader makes them anew from the stored chunks and compares.

Nulls: a null text is an empty document (its end id alone); null doc_ids come first in the
order and keep their own recipes, as do repeated rows. Empty tables give empty stores. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, prefix_sums, staged, table, unstage
from .tokens import encoder, tokenizer_path

#: One random 64-bit number an id, from a fixed seed: every writer must cut alike.
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 1 << 16, dtype=np.uint64)
WINDOW = 16
LONGEST = 4096


def cuts(ids: np.ndarray, lengths: np.ndarray, bits: int = 9, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(ends, counts) of the chunks of id streams that stand one after the other: where the hash of a stream's last 16 ids has `bits` leading zeros, and chunks of each stream."""
    last = np.cumsum(lengths)
    h = _GEAR.take(ids & 0xFFFF)
    # The first places of each stream, less what precedes it there.
    place = np.arange(WINDOW - 1)
    inside = place < np.asarray(lengths)[:, None]
    at = ((last - lengths)[:, None] + place)[inside]
    heads = np.zeros(inside.shape, np.uint64)
    heads[inside] = h[at]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint64(step)
        heads[:, step:] += heads[:, :-step] << np.uint64(step)
    h[at] = heads[inside]
    ends = np.union1d(np.flatnonzero(h < np.uint64(1 << 64 - bits)) + 1, last)
    gaps = np.diff(ends, prepend=0)
    if gaps.max(initial=0) > longest:
        ends = np.concatenate([np.append(np.arange(e - g + longest, e, longest), e) for e, g in zip(ends, gaps, strict=True)])
    return ends, np.diff(np.searchsorted(ends, last, side="right"), prepend=0)


def encode_chunks(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, row, seq, digest, n_ids, root (with a document's last chunk), payload of every chunk; a task sends a chunk's bytes once."""

    def setup():
        from pyspark import TaskContext

        e = encoder(path)
        width = np.dtype("<u2") if e.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        return {"e": e, "width": width, "row": TaskContext.get().partitionId() << 36, "seen": set()}

    def rows(s, doc_id, text):
        ids, counts = s["e"].encode(text)
        n = len(doc_id)
        stream = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype(s["width"])
        ends, chunks = cuts(stream, counts + 1)
        raw, w = stream.tobytes(), s["width"].itemsize
        starts = np.append(0, ends[:-1])
        pieces = [raw[a:b] for a, b in zip((starts * w).tolist(), (ends * w).tolist(), strict=True)]
        digests = [hashlib.blake2b(p, digest_size=16).digest() for p in pieces]
        seen = s["seen"]
        for i, d in enumerate(digests):
            if d in seen:
                pieces[i] = None
            else:
                seen.add(d)
        if len(seen) > 500_000:
            seen.clear()
        own = np.repeat(np.arange(n), chunks)
        after = np.cumsum(chunks)
        roots = [None] * len(digests)
        for lo, hi in zip((after - chunks).tolist(), after.tolist(), strict=True):
            roots[hi - 1] = merkle(digests[lo:hi])
        s["row"] += n
        return {
            "doc_id": pa.array(doc_id, pa.int64()).take(pa.array(own)), "row": s["row"] - n + own, "seq": (np.arange(len(own)) - (after - chunks)[own]).astype(np.int32),
            "digest": digests, "n_ids": (ends - starts).astype(np.int32), "root": roots, "payload": pieces,
        }

    schema = "doc_id long, row long, seq int, digest binary, n_ids int, root binary, payload binary"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema, setup=setup)


def write_store(docs: DataFrame, path: str, end_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chunks, recipes) as read back from the store's files.

    chunks: digest, payload, each digest once. recipes: doc_id, row, seq, digest, n_ids, root, in
    files and rows of ascending doc_id.
    """
    raw = staged(encode_chunks(docs, path, end_id), "chunks-raw")
    first = raw.where("payload is not null").groupBy("digest").agg(F.first("payload").alias("payload"))
    chunks = staged(first, "chunks")
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "row", "seq")]
    recipes = staged(raw.drop("payload").repartitionByRange(*order).sortWithinPartitions(*order), "recipes")
    unstage(raw)
    return chunks, recipes


def read_chunks(chunks: DataFrame, width: int) -> DataFrame:
    """digest, n_ids, crc (of the ids as little-endian 32-bit numbers) from stored bytes; a chunk that isn't what its digest says fails the read."""

    def rows(_, digest, payload):
        got = [hashlib.blake2b(p, digest_size=16).digest() for p in payload]
        if got != digest:
            raise ValueError("a stored chunk doesn't match its digest")
        ids = [np.frombuffer(p, dtype=f"<u{width}") for p in payload]
        return {"digest": digest, "n": [len(x) for x in ids], "crc": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}

    return map_arrow(chunks.select("digest", "payload"), rows, "digest binary, n int, crc long")


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo CRC-32's, bits reflected."""
    p, one = np.zeros(np.broadcast(a, b).shape, np.uint64), np.uint64(1)
    for i in range(31, -1, -1):
        p ^= b * (a >> np.uint64(i) & one)
        b = b >> one ^ _POLY * (b & one)
    return p


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What crc32 values of parts are in a whole that has so many bytes after them; the whole's crc32 is their exclusive or."""
    base, out = np.array([1 << 23], np.uint64), crc.astype(np.uint64)
    left = n_bytes.astype(np.int64)
    while left.any():
        odd = left & 1 == 1
        out[odd] = _times(base, out[odd])
        base, left = _times(base, base), left >> 1
    return out


def merkle(leaves: list[bytes]) -> bytes:
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def read_documents(chunks: DataFrame, recipes: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n_tokens, ids_crc32, merkle_root of every document, from the stored bytes.

    Stored chunks are read and checked once each; documents take their sizes and checksums
    along the recipes, so no payload is shuffled. A document that isn't what its stored root
    says fails the read.
    """
    facts = read_chunks(chunks, width)
    part = F.struct("seq", "n", "crc", "digest", "root")
    whole = recipes.join(facts, "digest").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum("n_ids").alias("told"))
    column = lambda name: F.transform("parts", lambda p: p[name]).alias(name)
    whole = whole.select("doc_id", "row", "told", F.element_at("parts", -1)["root"].alias("root"), column("seq"), column("n"), column("crc"), column("digest"))

    def rows(_, doc_id, row, told, root, seq, n, crc, digest):
        chunks = np.array([len(x) for x in seq], np.int64)
        flat_seq, flat_n, flat_crc = (np.fromiter(chain.from_iterable(x), np.int64, int(chunks.sum())) for x in (seq, n, crc))
        first = np.cumsum(chunks) - chunks
        ends = np.cumsum(flat_n)
        total = ends[first + chunks - 1] - (ends - flat_n)[first]
        whole = (flat_seq == np.arange(len(flat_seq)) - np.repeat(first, chunks)).all() and total.tolist() == told
        if not whole or [merkle(d) for d in digest] != root:
            raise ValueError("a document isn't what its stored root says")
        after = np.repeat(ends[first + chunks - 1], chunks) - ends
        return {"doc_id": doc_id, "row": row, "n_tokens": told, "ids_crc32": np.bitwise_xor.reduceat(shifted(flat_crc, 4 * after), first).astype(np.int64), "merkle_root": [x.hex() for x in root]}

    return map_arrow(whole, rows, "doc_id long, row long, n_tokens long, ids_crc32 long, merkle_root string", limit=100_000)


def reconstruct(chunks: DataFrame, recipes: DataFrame, width: int) -> DataFrame:
    """doc_id, row, ids: the id arrays themselves, by joining recipes with payloads."""
    whole = recipes.join(chunks, "digest").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("parts"))

    def rows(_, doc_id, row, parts):
        return {"doc_id": doc_id, "row": row, "ids": [np.frombuffer(b"".join(p["payload"] for p in ps), dtype=f"<u{width}").astype(np.int64) for ps in parts]}

    return map_arrow(whole, rows, "doc_id long, row long, ids array<long>")


def manifest(documents: DataFrame, fanout: int = 1024) -> DataFrame:
    """level, node, root, n: roots over groups of some `fanout` documents (doc_id, row, merkle_root), dealt by a hash of both ids and in their order, then over groups of those, up to one."""
    groups = -(-documents.count() // fanout)
    member = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "row", F.col("merkle_root").alias("root"))
    level = documents.select(F.pmod(F.xxhash64("doc_id", "row"), F.lit(max(1, groups))).cast("long").alias("node"), member.alias("m"))
    out, depth = None, 0
    while True:
        depth += 1
        joined = F.concat_ws("", F.transform(F.sort_array(F.collect_list("m")), lambda x: x["root"]))
        level = staged(level.groupBy("node").agg(F.sha2(joined, 256).alias("root"), F.count("*").alias("n")), "manifest")
        done = level.select(F.lit(depth).alias("level"), "node", "root", "n")
        out = done if out is None else out.unionByName(done)
        if groups <= 1:
            return out
        groups = -(-groups // fanout)
        level = level.select(F.floor(F.col("node") / fanout).alias("node"), F.struct("node", "root").alias("m"))


def verified(read: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents as read, if they give the stored manifest."""
    if not manifest(read).exceptAll(stored).isEmpty():
        raise ValueError("the documents aren't what the stored manifest says")
    return read


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, read back from its content-addressed files."""
    path = tokenizer_path("byte_bpe_50k.json")
    chunks, recipes = write_store(table(spark, sf_dir, "documents"), path)
    stored = manifest(recipes.where("root is not null").select("doc_id", "row", F.lower(F.hex("root")).alias("merkle_root")))
    read = verified(staged(read_documents(chunks, recipes, 2), "documents-read"), stored)
    placed = prefix_sums(read, ["doc_id", "row"], {"start": "n_tokens"})
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", "merkle_root")


QUERIES = {"op10_token_store": op10_token_store}
ORACLES: dict[str, str] = {}
