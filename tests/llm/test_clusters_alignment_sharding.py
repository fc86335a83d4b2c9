"""Clustering, tokenizer alignment and sharding against brute force, with nulls, ties, repeats, empties and clashing columns."""

import collections
import glob
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendframe.llm import alignment, clusters, sharding
from mendframe.llm.tokens import tokenizer_path
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, block long, place int, _row long, shard int, pair long, key string"


def k_means(rows, k, rounds, size):
    """Plain loops over Python integers."""
    kept = [(i, [math.floor(1024 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    c = [x for _, x in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for n in range(rounds + 1):
        at = [min(range(len(c)), key=lambda q: (far(x, c[q]), q)) for _, x in kept]
        for q in range(len(c)) if n < rounds else ():
            own = [x for (_, x), p in zip(kept, at, strict=True) if p == q]
            if own:
                c[q] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    d = [far(x, c[p]) for (_, x), p in zip(kept, at, strict=True)]
    inertia = collections.Counter()
    for p, v in zip(at, d, strict=True):
        inertia[p] += v
    return sorted(((i, p, v, inertia[p], sum(d), hashlib.sha256(",".join(map(str, c[p])).encode()).hexdigest()) for (i, _), p, v in zip(kept, at, d, strict=True)), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(clusters.op11_hamerly_clusters(spark, SF)) == k_means(rows, 8, 10, 64)


def test_clusters_odd(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 7)
    r = random.Random(2)
    rows = [(i, [r.choice([-2.0, -0.0005, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(120)]  # ties and many equal vectors
    rows += [(500 + i, [1.0, 1.0, 1.0]) for i in range(60)] + [(3, [0.25, 0.0, 1.0])] * 2 + [(None, [0.5, 0.5, 0.5])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 1.0]), (904, [1.0, float("nan"), 0.0]), (905, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1, 2, 3.0) for i, x in rows], "vec_id long, embedding array<double>, block int, cluster int, x double")
    for k in (1, 2, 6):
        assert rows_of(clusters.clustered(df, k=k, rounds=5, size=3)) == k_means(rows, k, 5, 3), k
    few = df.where("vec_id in (0, 1)")
    assert rows_of(clusters.clustered(few, k=6, rounds=2, size=3)) == k_means(rows[:2], 6, 2, 3)
    assert clusters.clustered(df.limit(0), size=3).count() == 0 == clusters.clustered(df.where("vec_id >= 900"), size=3).count()
    with pytest.raises(Exception, match="64 bits"):
        clusters.clustered(spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>"), size=3).count()


def test_bounds_never_miss():
    """After any drift the bounds give the same nearest centroid as a scan, and spare some scans."""
    r = np.random.Generator(np.random.PCG64(1))
    spared = 0
    for _ in range(40):
        x, c = r.integers(-50, 50, (200, 4)), r.integers(-50, 50, (5, 4))
        at, upper, lower = clusters.scanned(x, c)
        for _ in range(4):
            moved = c + r.integers(-6, 7, c.shape)
            at, upper, lower, many = clusters.rebounded(x, moved, at, upper, lower, clusters._root(((moved - c) ** 2).sum(1), 1))
            c, spared = moved, spared + 200 - many
            assert (at == clusters.distances(x, c).argmin(1)).all()
    assert spared > 4000


def test_rounds_join_without_a_shuffle(spark):
    blocks = spark.createDataFrame([(i, [i], b"\0" * 8) for i in range(20)], "block long, ids array<long>, vectors binary")
    state = blocks.select("block", *[F.col("vectors").alias(c) for c in ("nearest", "upper", "lower")])
    a, b = (clusters._Bucketed(df.repartition(4, "block"), 4, "test") for df in (blocks, state))
    plan = clusters._round(a.df, b.df, np.zeros((1, 2), np.int64), np.zeros(1))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    a.drop(), b.drop()


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {}
    n = 0
    for x in range(256):
        plain = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x
        byte_of[chr(x if plain else 256 + n)] = x
        n += not plain
    said_b = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    docs = []
    for i, t in rows:
        e = a.encode(" " + (t or ""), add_special_tokens=False)
        ids_b = b.encode(t or "")
        parts = [bytes(byte_of[c] for c in x) for x in e.tokens], [said_b(b.id_to_piece(x)) for x in ids_b]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            docs.append((i, None))
            continue
        ends = [list(itertools.accumulate(map(len, p))) for p in parts]
        cuts = set(ends[0]) & set(ends[1])
        halves = []
        for ids, own in zip((e.ids, ids_b), ends, strict=True):
            cut, group = [], []
            for x, end in zip(ids, own, strict=True):
                group.append(x)
                if end in cuts:
                    cut.append(group)
                    group = []
            halves.append(cut)
        docs.append((i, (len(e.ids), len(ids_b), list(zip(*halves, strict=True)))))
    links = lambda d: [(x, y) for left, right in d[2] for x in left for y in right]
    count = collections.Counter(p for _, d in docs if d for p in set(links(d)))
    best_a, best_b = collections.Counter(), collections.Counter()
    for (x, y), n in count.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        own = links(d)
        said = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in d[2])
        out.append((i, d[0], d[1], len(d[2]), len(own), sum(count[p] == best_a[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(said.encode()).hexdigest(), sum(count[p] == best_b[p[1]] for p in own)))
    return sorted(out, key=repr)


def test_alignment_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(alignment.op12_tokenizer_alignment(spark, SF)) == brute_alignment(rows)


ODD = [
    None, "", " ", "  ", "a▁b", "</s> <|endoftext|> 's", "x\x00y  z", "\n\n  foo \t bar\r\n (;\r\n a", "日本語テキスト 한국어 ﬁ①", "word " * 50, "é́ à b\x1c c  d\n\n e", " lead", "trail  ", "a b　c d", "🙂🙂‍👩 🙂", "x" * 3000,
    "a\x1c b \x1d c\x85 d   e", "tab\t after  \t x", "Word, word; \"word\"! (a$) 1,234.5 b%%% c***", "word one\nword two", "ab" * 40 + " " + "ab" * 40,
]


@pytest.mark.parametrize("bound", [None, 40])
def test_alignment_odd(spark, monkeypatch, bound):
    if bound:  # many small blocks, a memo that starts anew all the time
        monkeypatch.setattr(alignment, "BLOCK", bound)
        monkeypatch.setattr(alignment, "MOST", 5000)
    rows = [*enumerate(ODD), (3, "same text"), (3, "same text"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "k") for i, t in rows], DOCS)
    assert rows_of(alignment.align_tokenizers(df, A, B)) == brute_alignment(rows)
    assert alignment.align_tokenizers(df.limit(0), A, B).count() == 0
    assert rows_of(alignment.align_tokenizers(df.where("text = ''"), A, B)) == brute_alignment([(1, "")])


def test_alignment_holds_few_blocks_at_once(spark, monkeypatch):
    import pyarrow.parquet as pq

    asked = []
    real = alignment.staged
    monkeypatch.setattr(alignment, "staged", lambda df, name, *more: asked.append(out := real(df, name, *more)) or out)
    monkeypatch.setattr(alignment, "BLOCK", 40)
    rows = [(i, f"word {i} and some more words, each in a block") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert rows_of(alignment.align_tokenizers(df, A, B)) == brute_alignment(rows)
    groups = [m.row_group(i).num_rows for f in glob.glob(f"{asked[0].staged_at.removeprefix('file:')}/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == 30 and max(groups) <= 4


def test_alignment_memo_keeps_what_is_asked_for_again(monkeypatch):
    texts = [t for t in ODD if t] + [f"often said {i} w{i * 7919}" for i in range(400)]
    whole, small = (alignment.Aligner(A, B) for _ in range(2))
    wanted = [x for t in texts for x in whole.documents([t])[0]]
    monkeypatch.setattr(alignment, "MOST", 20_000)
    found, sizes, added, add = [], [], [], small._add
    monkeypatch.setattr(small, "_add", lambda runs: added.extend(runs) or add(runs))
    for t in texts:
        found += small.documents([t])[0]
        sizes.append(small.held)
    assert found == wanted
    assert added.count(" said") == 1 and any(b < a for a, b in itertools.pairwise(sizes)) and max(sizes) < 40_000


def shards(spark, keys, root):
    df = sharding.placed(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", root, "s")
    return dict(map(tuple, df.collect()))


def test_hash_tree_equals_sql(spark):
    assert difference(sharding.op13_hash_tree(spark, SF), connect(SF), sharding.ORACLES["op13_hash_tree"]) is None


def test_growth_takes_rows_into_the_new_shard_only(spark):
    keys = range(6000)
    root = sharding.tree()
    was = shards(spark, keys, root)
    for _ in range(3):
        root = sharding.grown(root)
        now, new = shards(spark, keys, root), max(s.shard for s in root.shards())
        moved = [k for k in keys if now[k] != was[k]]
        assert {now[k] for k in moved} == {new} and abs(len(moved) - 6000 / (new + 1)) < 60
        was = now


def test_a_weight_moves_rows_in_its_subtrees_only(spark):
    keys = range(8000)
    was, more, less = (shards(spark, keys, sharding.tree(weights=w)) for w in ({}, {13: 3.0}, {13: 0.25}))
    region, rack = (lambda s: s // 10), (lambda s: s // 5)
    for now, inwards in ((more, True), (less, False)):
        for k in keys:
            a, b = (was[k], now[k]) if inwards else (now[k], was[k])
            # Shard 13 is in rack 2 of region 1: rows come into its region, its rack or itself, and nowhere else.
            assert a == b or region(b) == 1 and (region(a) != 1 or rack(b) == 2 and (rack(a) != 2 or b == 13))
    sizes = collections.Counter(more.values())
    assert abs(sizes[13] / (3 * 8000 / 42) - 1) < 0.15 and abs(sum(n for s, n in sizes.items() if s != 13) / 39 / (8000 / 42) - 1) < 0.05


def test_sharding_odd(spark):
    texts = [None, "", "é", "x" * 5000, "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "r")] * 30 + [(None, "n")] * 9
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "k") for i, t in rows], DOCS)
    got = sharding.shard_documents(df, sharding.tree()).collect()
    assert sorted((x.doc_id is None, x.doc_id, x.size, x.text_crc32) for x in got if x.doc_id is not None) == sorted((False, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    slots = collections.defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
        assert x.law == "key" and (x.grown_shard in (x.shard, 40))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == len(rows)
    assert len({x.shard for x in got if x.doc_id == 7}) == 1 == len({x.shard for x in got if x.doc_id is None})
    assert sharding.shard_documents(df.limit(0), sharding.tree()).count() == 0
