"""Toxicity scores by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic documents are the positives; all other text is unlabelled, toxic or not. With
class prior p the risk of a classifier g is

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

whose second part estimates the loss on clean text and is kept from going negative. l is the
logistic loss, so sigmoid(g) is a probability. The model is linear in log(1 + count) of words
and of beginnings of words (languages that inflect and compound vary the rest) that are
commoner in positives than in unlabelled text, learned in numpy on a sample bounded by
MOST_POSITIVE and MOST_UNLABELLED documents; every document is scored. Hidden positives make
nnPU scores low, so the bias is set last: the cut that parts confirmed toxic from at most
MOST_POSITIVE confirmed clean documents best (F1) gets the score THRESHOLD.

Labels, language, source and id are never inputs of a score. Rows whose crc32(doc_id) mod 3
is 1 are held out: neither their labels nor their texts are learned from. Nulls: a null text
scores as an empty one; a null doc_id isn't held out; labels with null or unknown ids or null
toxic are ignored; without any confirmed document (or an empty table of labels) the model
scores 0. Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import map_arrow, release, slices, table
from .tokens import forget

MOST_POSITIVE, MOST_UNLABELLED = 8_000, 24_000
THRESHOLD = 0.7
#: Entries of the sample's rows that are worked on at a time.
SLICE = 1 << 20
#: Words are runs of letters, lower-cased; their beginnings have so many letters.
_WORDS = re.compile(r"[^\W\d_]+")
STEMS = range(3, 8)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a sign that no word has."""
    return [word, *(f"<{word[:k]}" for k in STEMS if k < len(word))]


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def counts_of(texts: list[str | None], index: dict[str, int], known: dict[str, list[int]] | None = None) -> Rows:
    """(text, feature, log(1 + count)) of the model's features in texts. known: features of words met before."""
    known = {} if known is None else known
    row, column = [], []
    for i, t in enumerate(texts):
        for w, n in Counter(_WORDS.findall((t or "").lower())).items():
            own = known.get(w)
            if own is None:
                if len(known) > 200_000:
                    known.clear()
                own = known[w] = [index[f] for f in features(w) if f in index]
            for k in own:
                row += [i] * n
                column += [k] * n
    if not row:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    key, count = np.unique(np.array(row, np.int64) * len(index) + np.array(column, np.int64), return_counts=True)
    return key // len(index), key % len(index), np.log1p(count).astype(np.float32)


def _sums(at: np.ndarray, by: np.ndarray, x: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Sums of x * w[by] by at, a slice of the entries at a time, so that working arrays stay small."""
    out = np.zeros(n)
    for lo in range(0, len(x), SLICE):
        cut = slice(lo, lo + SLICE)
        out += np.bincount(at[cut], x[cut] * w[by[cut]], n)
    return out


def values(x: Rows, w: np.ndarray, n: int) -> np.ndarray:
    """The products of n sparse rows with the weights."""
    return _sums(x[0], x[1], x[2], w, n)


def learn_nnpu(x: Rows, size: int, width: int, n: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier of least nnPU risk on `size` rows of `width` features, by Adam on whole batches. The first n rows are the positives."""
    w, rest = np.zeros(width + 1), size - n
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = values(x, w[:-1], size) + w[-1]
        s = 1 / (1 + np.exp(-g))
        # d/dg of softplus(-g) is s - 1, of softplus(g) is s
        clean = np.logaddexp(0, g[n:]).mean() - prior * np.logaddexp(0, g[:n]).mean()
        grad = np.zeros(len(g))
        if clean >= 0:
            grad[:n] = prior * (s[:n] - 1) / n - prior * s[:n] / n
            grad[n:] = s[n:] / rest
        else:  # step back from overfitting: raise the negative part again
            grad[:n] = prior * s[:n] / n
            grad[n:] = -s[n:] / rest
        d = np.append(_sums(x[1], x[0], x[2], grad, width), grad.sum())
        d[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * d, 0.999 * second + 0.001 * d * d
        w -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def shift(pos: np.ndarray, clean: np.ndarray) -> float:
    """What to add to classifier values so that the cut of best F1 lies at THRESHOLD."""
    g, y = np.concatenate([pos, clean]), np.repeat([1, 0], [len(pos), len(clean)])
    order = np.argsort(-g, kind="stable")
    g, hits = g[order], np.cumsum(y[order])
    f1 = np.where(np.append(g[:-1] > g[1:], True), 2 * hits / (np.arange(1, len(g) + 1) + len(pos)), -1)
    at = int(np.argmax(f1))
    cut = (g[at] + g[at + 1]) / 2 if at + 1 < len(g) else g[at] - 1
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def _bytes_of(column: pa.BinaryArray, dtype: str) -> np.ndarray:
    """All values of a column of bytes, one after the other, as they lie."""
    if not len(column):
        return np.empty(0, dtype)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """(words, weights, bias) from the documents that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior, n = known.agg(F.avg("toxic"), F.count("*")).first()
    if not n or not prior:
        return [], np.empty(0), -30.0
    order = F.xxhash64("doc_id")
    # kind 1: confirmed toxic, 0: unlabelled, 2: confirmed clean (for the cut only)
    toxic = known.where("toxic = 1").orderBy(order).limit(MOST_POSITIVE).select("doc_id", F.lit(1).alias("kind"))
    clean = known.where("toxic = 0").orderBy(order).limit(MOST_POSITIVE).select("doc_id", F.lit(2).alias("kind"))
    other = docs.select("doc_id").where("doc_id is not null").where(~held_out()).distinct().orderBy(order).limit(MOST_UNLABELLED).select("doc_id", F.lit(0).alias("kind"))
    ids = [tuple(r) for r in toxic.unionByName(clean).unionByName(other).collect()]  # bounded above
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, kind int")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("kind", "text")

    def words(_, kind, text):
        forget()
        out = {"pos": [], "word": []}
        for k, t in zip(kind, text, strict=True):
            own = {f for w in set(_WORDS.findall((t or "").lower())) for f in features(w)} if k < 2 else ()
            out["pos"] += [k == 1] * len(own)
            out["word"] += own
        return out

    n_pos, n_unl = sum(k == 1 for _, k in ids), sum(k == 0 for _, k in ids)
    df = map_arrow(sample, words, "pos boolean, word string").groupBy("word").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("u"))
    share_p, share_u = (F.col("p") / n_pos), (F.col("u") + 1) / (n_unl + 2)
    excess = (share_p - share_u) / F.sqrt(share_u * (1 - share_u) / n_pos)
    # What a hundredth of the positives hold (three at least), far oftener than other text; of a bounded sample, so bounded.
    chosen = sorted(r["word"] for r in df.where(F.col("p") >= max(3, n_pos / 100)).withColumn("z", excess).where("z > 4").select("word").collect())
    if not chosen:
        return [], np.empty(0), float(np.log(prior / (1 - prior)))
    index = {w: i for i, w in enumerate(chosen)}

    def vectors(_, kind, text):
        row, column, value = counts_of(text, index)
        ends = np.searchsorted(row, np.arange(len(text) + 1))
        return {"kind": kind, "columns": [column[a:b].astype("<i4").tobytes() for a, b in zip(ends, ends[1:])], "x": [value[a:b].tobytes() for a, b in zip(ends, ends[1:])]}

    rows = map_arrow(sample, vectors, "kind int, columns binary, x binary").toArrow()
    # Positives, unlabelled, confirmed clean, in this order.
    kind = rows["kind"].to_numpy()
    order = np.argsort(np.array([1, 0, 2])[kind], kind="stable")
    columns, xs = (rows[c].take(order).combine_chunks() for c in ("columns", "x"))
    del rows
    size = pc.binary_length(columns).to_numpy(zero_copy_only=False) // 4
    x = np.repeat(np.arange(len(kind), dtype=np.int32), size), _bytes_of(columns, "<i4"), _bytes_of(xs, "<f4")
    n, m = int((kind == 1).sum()), int((kind < 2).sum())
    held = int(np.searchsorted(x[0], m))
    weights, bias = learn_nnpu((x[0][:held], x[1][:held], x[2][:held]), m, len(chosen), n, float(prior))
    if m < len(kind):
        g = values(x, weights, len(kind)) + bias
        bias += shift(g[:n], g[m:])
    return chosen, weights, bias


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, float]) -> DataFrame:
    """doc, a struct of the row, with score and predicted; docs must have text. A row goes to the task once and comes back as it lies."""
    chosen, weights, bias = model
    index = {w: i for i, w in enumerate(chosen)}
    packed = docs.select(F.struct("*").alias("doc"))
    target = StructType([*packed.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[str, list[int]] = {}
        for batch in batches:
            doc = batch.column(0)
            texts = doc.field(at)  # no doc is null
            for lo, hi in slices(texts, 1_000_000):
                text = texts.slice(lo, hi - lo).to_pylist()
                g = values(counts_of(text, index, known), weights, len(text)) + bias if chosen else np.full(len(text), bias)
                s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=target.names)
        known.clear()
        release()

    return packed.mapInArrow(run, target)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).select("doc.doc_id", "score", "predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    model = learn(docs.select(F.col("doc_id").cast("long"), "text"), labels)
    return score(docs, model).where("predicted = 0").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
