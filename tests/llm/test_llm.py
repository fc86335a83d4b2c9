"""Every corpus operator against brute force, and its defined results for nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mendframe.llm import attribution, fingerprint, html_extract, line_dedup, media, mixing, ngram_join, packing, token_store, toxicity
from mendframe.llm.graph import connected_components
from mendframe.llm.tokens import Encoder, tokenizer_path
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, key string, token int"
ODD = [None, "", " \n\t ", "one", "a b c d", "word " * 3000, "x" * 5000, "é́ à b\x1c c  d\n\n e", "<|endoftext|> 's don't"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows, and columns that clash with internal names."""
    rows = [(i, t, "en", None if i % 2 else "s", 1, 5, "r", "k", 9) for i, t in enumerate(ODD)]
    rows += [(3, "one", None, "s", None, None, None, None, None)] * 2 + [(None, "a b c d e f g", "en", "é", 1, 1, "x", "y", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_pairs(sets):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)]
    edges += [(7, 7)]
    want = components({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ngram_join_equals_brute_force(spark, docs):
    base = {r.doc_id: r.text for r in docs.collect()}
    r = random.Random(1)
    extra, words = {}, [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(words) for _ in range(60))
    seed = [r.choice(words) for _ in range(120)]
    for i in range(1000, 1060):  # a large group of near copies, each with its own edits
        w = list(seed)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(120)] = f"e{i}"
        extra[i] = " ".join(w)
    for i in range(2000, 2030):  # one passage in texts that differ
        extra[i] = passage + " " + " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))
    texts = base | extra | {3000: None, 3001: "", 3002: "Ab c", 3003: "aB  c"}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets, near_pairs(sets))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_heads_bound_what_sets_share():
    r = np.random.Generator(np.random.PCG64(6))
    for k in range(300):
        pool = r.integers(0, 1 << 64, 400, dtype=np.uint64, endpoint=False)
        if k % 3 == 0:  # many equal 16-bit cuts
            pool = (pool >> np.uint64(60) << np.uint64(60)) + (pool & np.uint64(0xFFFF))
        x, y = (np.unique(r.choice(pool, r.integers(0, 300))) for _ in range(2))
        if k % 2:  # near copies
            y = np.union1d(x[r.random(len(x)) < 0.9], y[: len(x) // 9])
        if not len(x) or not len(y):
            continue
        most = ngram_join.most_shared(len(x), ngram_join.heads(x), len(y), ngram_join.heads(y))
        both = len(np.intersect1d(x, y))
        assert most <= min(len(x), len(y)) or k % 3 == 0
        assert both <= most or 7 * both < 3 * (len(x) + len(y))  # 0 says: not similar


def test_classes_of_long_lists_meet_once(spark):
    """Classes that share most of their prefix meet in one list or few, not in each; none that meets is lost."""
    rng, rows = random.Random(11), []
    for c in range(12):
        prefix = range(60) if c < 4 else sorted(rng.sample(range(200), 30))
        rows += [(t, c, 240, i, c, 240, 0, 240, 0, 0, 0, 0) for i, t in enumerate(prefix)]
    bits = [f"{name} long" for name in ngram_join.LACKS]
    rest = spark.createDataFrame(rows, ", ".join(["token long", "cid long", "n int", "pos int", "c long", "core int", "extra int", "whole int", *bits]))
    met = [(r.cid, r.p_cid) for r in ngram_join._meetings(ngram_join._preceded(rest), 75).select("cid", F.col("p_c").alias("p_cid")).collect()]
    held = collections.defaultdict(set)
    for t, c, *_ in rows:
        held[c].add(t)
    assert set(met) == {(a, b) for a in held for b in held if a < b and held[a] & held[b]}
    assert all(met.count((a, b)) == 1 for a in range(4) for b in range(a + 1, 4))


def test_ngram_join_odd(odd, none):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(odd).collect())
    assert got[(0, 0, 0)] == 1 and got[(1, 0, 1)] == 1 and got[(3, 1, 3)] == 3 and sum(got.values()) == odd.count()
    kept = ngram_join.distinct_documents(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.count() == odd.count() - 2
    assert ngram_join.similar_documents(none).count() == 0


def test_token_runs_are_whole_encodings(docs):
    texts = [r.text for r in docs.select("text").limit(60).collect()] + [t or "" for t in ODD]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(tokenizer_path(name), most=500)
        for lo in range(0, len(texts), 13):
            ids, counts = e.encode(texts[lo : lo + 13])
            at = 0
            for t, n in zip(texts[lo : lo + 13], counts.tolist(), strict=True):
                assert ids[at : at + n].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
                at += n


def test_a_full_memo_keeps_what_is_asked_for_again():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(tokenizer_path(name), most=60_000)
        for k in range(40):
            text = " ".join(w for i in range(40) for w in ("often", f"zq{k}x{i}", "again")) + " " + "y" * 70
            ids, counts = e.encode([text, None, text])
            want = e.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]
            assert any("often" in r for r in e.index) and e.held <= e.most + 300 * 60  # what a slice adds
        assert len(e.index) < 400 and e.index.made == len(e.starts) == len(e.lengths) == len(e.asked)
        e._thin()
        kept = {r.strip() for r in e.index}
        assert {"often", "again"} <= kept and e.held <= e.most // 2


def test_words_are_given_to_the_library_together(monkeypatch):
    words = ["".join(random.Random(i).choices("abcdeèÉßÿÅZ", k=9)) for i in range(600)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(tokenizer_path(name))
        given, apart = [], e._apart
        monkeypatch.setattr(e, "_apart", lambda runs: given.extend(runs) or apart(runs))  # noqa: B023
        text = " " + " ".join(words) + " it's <|endoftext|> x1 ٣ Ǆ日本 end</w> a.</w>b"
        ids, _ = e.encode([text])
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids and len(given) < 30


def encoded(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_store_round_trip(spark, docs, odd, none):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want, start = {}, 0
    for (i, _), ids in zip(rows, encoded("byte_bpe_50k.json", [t for _, t in rows]), strict=True):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.op10_token_store(spark, SF).collect()}
    assert got == want
    chunks, recipes = token_store.write_store(odd, tokenizer_path("byte_bpe_50k.json"))
    assert chunks.count() == chunks.select("digest").distinct().count()
    back = sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in token_store.reconstruct(chunks, recipes, 2).collect())
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert back == sorted((i is not None, i or 0, ids) for (i, _), ids in zip(texts, encoded("byte_bpe_50k.json", [t for _, t in texts]), strict=True))
    read = token_store.read_documents(chunks, recipes, 2)
    m = token_store.manifest(read, fanout=4).collect()
    assert max(r.level for r in m) == 2 and sum(r.n for r in m if r.level == 1) == odd.count() and [r.n for r in m if r.level == 2] == [sum(r.level == 1 for r in m)]
    order = [r.doc_id for r in recipes.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    a, b = [r.digest for r in recipes.where("doc_id in (5, 6) and seq = 0").orderBy("doc_id").collect()]
    swapped = recipes.withColumn("digest", F.when(F.col("digest") == F.lit(a), F.lit(b)).otherwise(F.col("digest")))
    with pytest.raises(Exception, match="stored root"):
        token_store.read_documents(chunks, swapped, 2).collect()
    with pytest.raises(ValueError, match="manifest"):
        token_store.verified(read.withColumn("merkle_root", F.reverse("merkle_root")), token_store.manifest(read))
    chunks, recipes = token_store.write_store(none, tokenizer_path("byte_bpe_50k.json"))
    assert chunks.count() == recipes.count() == token_store.read_documents(chunks, recipes, 2).count() == 0


def test_chunks_and_checksums():
    r = np.random.Generator(np.random.PCG64(4))
    ids = r.integers(0, 50000, 30000).astype(np.uint32)
    ends, _ = token_store.cuts(ids, np.array([len(ids)]))
    assert ends[-1] == len(ids) and np.diff(ends, prepend=0).max() <= token_store.LONGEST and 20 < len(ends) < 150
    assert token_store.cuts(np.zeros(10000, np.uint32), np.array([10000]))[0].tolist() == [4096, 8192, 10000]
    # Streams are cut alike whatever stands before them.
    lengths = np.array([1, 5, 17, 4000, 1, 25976])
    got, n = token_store.cuts(ids, lengths)
    alone = [(token_store.cuts(ids[e - k : e], np.array([k]))[0] + e - k).tolist() for e, k in zip(np.cumsum(lengths), lengths, strict=True)]
    assert got.tolist() == sum(alone, []) and n.tolist() == list(map(len, alone))
    raw = ids.tobytes()
    crcs = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)])
    assert np.bitwise_xor.reduce(token_store.shifted(crcs, 4 * (len(ids) - ends))) == zlib.crc32(raw)


def brute_attribution(text, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    raw = text.encode()
    sizes = Encoder(tokenizer_path("byte_bpe_50k.json")).byte_lengths()
    spans = [(s["start"], s["end"]) for s in attribution.line_sections(text)]
    got, at = [0] * len(spans), 0
    for i in t.encode(text, add_special_tokens=False).ids:
        lo, hi = len(raw[:at].decode(errors="ignore")), len(raw[: at + sizes[i]].decode(errors="ignore"))
        at += sizes[i]
        share = [min(b, max(hi, lo + 1)) - max(a, lo) for a, b in spans]
        k = next(k for k, (a, b) in enumerate(spans) if a <= lo < b) if rule == "first" else max(range(len(spans)), key=lambda k: (share[k], -k))
        got[k] += 1
    return got


@pytest.mark.parametrize("rule", ["first", "most"])
def test_attribution(spark, docs, rule):
    texts = [r.text for r in docs.limit(15).collect()] + ["a\n\n\nb\n  c\n", "é\nü", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(dict)
    for r in attribution.attribute_tokens(df, tokenizer_path("byte_bpe_50k.json"), rule=rule).collect():
        got[r.doc_id][r.section] = r.n_tokens
    for i, t in enumerate(texts):
        assert [got[i][k] for k in sorted(got[i])] == brute_attribution(t, rule), t[:40]


def test_attribution_odd(spark, odd, none):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = attribution.attribute_tokens(odd, path).collect()
    assert all(r.n_tokens >= 0 for r in rows) and not [r for r in rows if r.doc_id in (0, 1)] and attribution.attribute_tokens(none, path).count() == 0
    given = spark.createDataFrame([(1, [(0, 3)], "abc def"), (2, None, "abc")], "doc_id long, spans array<struct<start:int,end:int>>, text string")
    assert sorted((r.doc_id, r.section) for r in attribution.attribute_tokens(given, path, "spans").collect()) == [(1, -1), (1, 0), (2, -1)]


def test_mixing(spark, odd, none):
    con = connect("/root/testdata/sf0.01")
    df = mixing.op1_source_mix(spark, "/root/testdata/sf0.01")
    assert difference(df, con, mixing.ORACLES["op1_source_mix"]) is None
    sums = df.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.g) < 1 and r.over <= 0 for r in sums)
    sized = odd.select("doc_id", "source", mixing.n_words().alias("size"), mixing.quality().alias("weight"))
    out = mixing.mix(sized, mixing.WEIGHTS)
    assert out.count() == odd.count() and out.where("taken > 3 * size or taken < 0").count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.select(F.sum(mixing.n_words())).first()[0] == out.agg(F.sum("taken")).first()[0]
    assert mixing.mix(none.select("doc_id", "source", F.lit(1).alias("size"), F.lit(1.0).alias("weight")), mixing.WEIGHTS).count() == 0


def test_targets_fill_by_weight(spark):
    rows = [("a", 100), ("b", 1000), ("c", 500), (None, 10), ("é", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long"), [5.0, 2.0, 1.0], 3).collect()}
    sizes = dict(rows)
    weights = dict(zip(["a", "b", "c", "é", None], [5, 2, 1, 5, 2], strict=True))
    want, left = {}, set(sizes)
    while True:  # share again until nothing is above its cap
        free = sum(sizes.values()) - sum(want.values())
        share = {s: free * weights[s] / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        left -= over
    assert got == pytest.approx(want | share)


def test_nnpu_learns_from_positives_only():
    r = np.random.Generator(np.random.PCG64(2))
    y = r.random(4000) < 0.2
    x = (r.random((4000, 12)) < np.where(y[:, None], [0.6] * 3 + [0.1] * 9, 0.1)).astype(np.float32)
    known = y & (r.random(4000) < 0.4)
    both = np.vstack([x[known], x[~known]])
    row, column = np.nonzero(both)
    w, b = toxicity.learn_nnpu((row, column, both[row, column]), len(x), 12, int(known.sum()), 0.2)
    g = x @ w + b
    order = np.argsort(g)
    rank = np.empty(4000)
    rank[order] = np.arange(4000)
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.85


def test_toxicity_sends_a_text_once(spark, odd):
    model = ["good", "bad"], np.array([-1.0, 2.0]), 0.5
    node = toxicity.score(odd, model)._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    assert node.children().head().output().length() == 1
    key = lambda r: repr(tuple(r))
    assert sorted((r.doc for r in toxicity.score(odd, model).collect()), key=key) == sorted(odd.collect(), key=key)


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op6_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = out.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[(1, 1)] / (n[(1, 1)] + n[(1, 0)]) >= 0.9 and n.get((0, 1), 0) <= 0.01 * n[(0, 0)]
    assert out.where("score < 0 or score > 1 or (score >= 0.7) <> (predicted = 1)").count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    clash = odd.withColumnsRenamed({"size": "score", "row": "predicted", "token": "doc"})
    assert toxicity.accepted_documents(clash, empty).columns == clash.columns
    some = spark.createDataFrame([(i, f"bad{i % 3} word {'bad' * (i % 2)}" if i % 2 else f"good {i} words") for i in range(60)] + [(None, None), (4, None)], "doc_id long, text string")
    model = toxicity.learn(some, spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc.text: r.score for r in toxicity.score(some, model).collect()}
    assert all((v >= 0.7) == ("bad" in (t or "")) for t, v in got.items()) and len(got) == 34
    kept = toxicity.accepted_documents(odd, empty)
    assert kept.columns == odd.columns and kept.count() == odd.count() and toxicity.accepted_documents(none, empty).count() == 0


def test_edit_distance_and_probes():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(3)
    for _ in range(6000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            p = r.randint(0, len(b))
            if r.random() < 0.4:
                b.insert(p, r.choice("abc"))
            elif p < len(b):
                b[p : p + 1] = r.choice(["", "a", "b"])
        b, k = "".join(b), r.randint(0, 3)
        near = distance(a, b) <= k
        assert line_dedup.within(a, b, k) == near
        flips = [((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(line_dedup.parities(a), line_dedup.parities(b), strict=True)]
        assert not near or flips[0] <= 2 * k and flips[1] + flips[2] <= 4 * k
        if near and min(len(a), len(b)) >= 4:
            short, long = sorted((a, b), key=len)
            held = {(len(short), i, short[x:y]) for i, (x, y) in enumerate(line_dedup.segments(len(short), k))}
            assert any((o, i, long[x:y]) in held for o, i, x, y in line_dedup.probes(len(long), k, 4))


def test_line_links_equal_brute_force(spark, docs):
    lines = sorted({s for r in docs.limit(40).collect() for _, s in line_dedup.long_lines(r.text, 40)})[:150]
    r = random.Random(9)
    for base in lines[:40]:
        for _ in range(3):
            w = list(base)
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice("xyz")
            lines.append("".join(w))
    lines = sorted({s.strip() for s in lines})
    near = [(line_dedup.line_id(a), line_dedup.line_id(b)) for i, a in enumerate(lines) for b in lines[i + 1 :] if line_dedup.within(a, b, 2)]
    want = components({x for p in near for x in p}, near)
    df = spark.createDataFrame([(i, "\n".join(lines[i::7])) for i in range(7)], "doc_id long, text string")
    assert dict(map(tuple, line_dedup.line_links(df).collect())) == want


def test_line_dedup(spark, odd, none):
    a, b, c, d = (ch * 50 for ch in "abcd")
    rows = [(1, f"{a}\n{b}\nshort\n{a}"), (2, f"{c}\n{a[:-1]}x\n{d}{d}"), (3, f"{a}\n{b}"), (4, f"{c}y\nshort"), (5, None)]
    out = {r.doc.doc_id: (r.doc.text, tuple(r.lines)) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (f"{a}\n{b}\nshort", (4, 1, 0, False, 3))
    assert out[2] == (f"{c}\n{d}{d}", (3, 0, 1, False, 2))
    assert out[3] == (f"{a}\n{b}", (2, 0, 2, True, 2)) and out[4][1][3] and out[5] == (None, (0, 0, 0, False, 0))
    kept = line_dedup.deduplicated_documents(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and line_dedup.deduplicated_documents(none).count() == 0


def test_short_lines_equal_brute_force(spark):
    r = random.Random(4)
    lines = []
    for n in [3, 12, 18, 19, 20, 21, 22, 30, 38, 39, 40, 41, 42, 43] * 4:
        base = [r.choice("abcdefg") for _ in range(n)]
        for _ in range(4):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice(["", "x", w[at] + "y"])
            lines.append("".join(w) or "z")
    lines = sorted(set(lines))
    near = [(line_dedup.line_id(a), line_dedup.line_id(b)) for i, a in enumerate(lines) for b in lines[i + 1 :] if line_dedup.within(a, b, (0 if (n := min(len(a), len(b))) < 20 else 1 if n < 40 else 2))]
    df = spark.createDataFrame([(i, "\n".join(lines[i::7])) for i in range(7)], "doc_id long, text string")
    assert dict(map(tuple, line_dedup.line_links(df).collect())) == components({x for p in near for x in p}, near)
    own = [" ".join(f"{d}w{i}" for i in range(30)) for d in "abc"]
    rows = [(1, f"{own[0]}\nAll rights reserved.\nOf."), (2, f"{own[1]}\nOf.\nAll rights reserved!\nNo.\n\nNo.\n"), (3, f"{own[2]}\nof.\n Of. ")]
    out = {x.doc.doc_id: (x.doc.text, x.lines.n_repeated, x.lines.n_copied) for x in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (rows[0][1], 0, 0), 2: (f"{own[1]}\nNo.\n\n", 1, 2), 3: (f"{own[2]}\nof.", 0, 1)}


def test_copied_lines_go_from_all_but_near_copies(spark):
    a, b, c, d, e, f = (ch * 50 for ch in "abcdef")
    rows = [(1, f"{a}\n{b}"), (2, f"{c}\n{d}"), (3, f"{a}\n{c}\n{e}"), (4, f"{a}\n{b}"), (5, f"{a}\n{f}\n{b}\n{f}"), (6, f"{a}\n{c}"), (None, f)]
    out = {r.doc.doc_id: (r.doc.text, r.lines.is_copy, r.lines.n_kept) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (f"{a}\n{b}", False, 2) and out[2] == (f"{c}\n{d}", False, 2) and out[4] == (f"{a}\n{b}", True, 2) and out[None] == (f, False, 1)
    assert out[3] == (e, True, 1) and out[5] == ("", True, 0) and out[6] == ("", True, 0)


def best_count(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_plans_are_optimal_where_brute_force_can_tell():
    for s in range(200):
        r = random.Random(s)
        capacity = r.choice([10, 20, 37])
        counts = collections.Counter(r.randint(1, capacity) for _ in range(r.randint(0, 10)))
        made = packing.plan(dict(counts), capacity)
        used = collections.Counter()
        for lengths, m in made:
            assert sum(lengths) <= capacity
            used.update({k: m * n for k, n in collections.Counter(lengths).items()})
        assert used == counts and sum(m for _, m in made) == best_count(list(counts.elements()), capacity)


def test_best_fit_is_one_piece_at_a_time():
    for s in range(100):
        r = random.Random(s)
        capacity = r.choice([12, 30, 64])
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 60))), reverse=True)
        bins = []
        for k in items:
            fits = [b for b in range(len(bins)) if bins[b] >= k]
            if not fits:
                bins.append(capacity)
                fits = [len(bins) - 1]
            bins[min(fits, key=lambda b: bins[b])] -= k
        made = packing.best_fit(dict(collections.Counter(items)), capacity)
        assert sum(m for _, m in made) == len(bins)
        assert sorted((x for lengths, m in made for x in lengths * m), reverse=True) == items
        assert len(packing.plan(dict(collections.Counter(items)), capacity)) <= len(items)


def test_packing(spark, docs, odd, none):
    for df in (docs, odd):
        rows = packing.pack_documents(df).collect()
        texts = [(r.doc_id, r.text) for r in df.collect()]
        want = collections.Counter()
        for (i, _), ids in zip(texts, encoded("word_bpe_49k.json", [t for _, t in texts]), strict=True):
            for k, lo in enumerate(range(0, len(ids), 2048)):
                part = ids[lo : lo + 2048]
                want[(i, k, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 2048
        assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(none).count() == 0
    whole = packing.packed_sequences(packing.pack(packing.encode_pieces(odd, tokenizer_path("word_bpe_49k.json"), keep_ids=True).cache()))
    assert whole.where("length * 4 <> octet_length(ids)").count() == 0


def test_media(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = media.op2_media_sequences(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count()
    texts = collections.defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text or "")
    for r in rows:
        (text,) = texts[r.doc_id]
        raw = text.encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        stored = media.encode_image(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.decode_image(stored).tobytes() == padded
    assert media.media_facts(media.store_texts(none)).count() == 0


def test_sequences_keep_positions_and_captions(spark):
    html = "<body><p>one <b>two</b><img src='sha256:%s' alt='x'>three<figure><img src=u.png><figcaption>cap &amp; t</figcaption></figure><script>no</script>" % ("a" * 64)
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    facts = spark.createDataFrame([("a" * 64, 7)], "digest string, bytes int")
    got = sorted((r.key, r.position, r.kind, r.text, r.caption, r.bytes) for r in media.resolve(media.parse_pages(pages, "page_id"), facts).collect())
    assert got == [(1, 0, "text", "one two", None, None), (1, 1, "media", None, "x", 7), (1, 2, "text", "three", None, None), (1, 3, "media", None, "cap & t", None)]


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><header>h</header><nav>n</nav><div class='cookie-notice'>c</div><article><header><h1>T &amp; u</h1></header><p>a  b<b>c</b><p>d<br>e<aside>s</aside><form>f</form><section class='comments'>r</section></article><footer>z"
    assert html_extract.blocks_of(page) == (True, ["T & u", "a bc", "d", "e"])
    assert html_extract.blocks_of("<main><p>text<article class='comment reply'>reader</article></main><article class=teaser>more</article><p>body") == (True, ["text", "body"])
    assert html_extract.blocks_of(None) == (False, []) and html_extract.blocks_of("<body><div id=sidebar>x</div><p>y") == (False, ["y"])
    menu, tail = "home news sport weather travel money shop help about us", "all rights are kept by the owner of this fine site"
    rows = [(i, f"https://h.example/{i}", f"<body><div>{menu}</div><p>own text {i} of the page</p><div>{tail}</div>") for i in range(6)]
    rows += [(9, "https://other.example/", f"<body><div>{menu}</div><p>alone</p>"), (10, None, None), (11, "https://h.example/0", page)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"own text {i} of the page" for i in range(6)]
    assert got[9] == f"{menu}\nalone" and got[10] == "" and got[11] == "T & u\na bc\nd\ne"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_recurring_runs_equal_brute_force():
    r = random.Random(8)
    for _ in range(60):
        runs = [[r.choice("abcd") for _ in range(10)] for _ in range(2)]
        streams = [sum((r.choice([*runs, [r.choice("xyzw")]]) for _ in range(r.randint(0, 4))), []) for _ in range(r.randint(0, 6))]
        kinds = len({tuple(s) for s in streams})
        need = max(3, int(np.ceil(0.2 * kinds)))
        on = collections.defaultdict(set)
        for s in streams:
            for i in range(len(s) - 7):
                on[tuple(s[i : i + 8])].add(tuple(s))
        want = []
        for s in streams:
            c = [False] * len(s)
            for i in range(len(s) - 7):
                if len(on[tuple(s[i : i + 8])]) >= need:
                    c[i : i + 8] = [True] * 8
            want.append(c)
        assert [list(map(bool, x)) for x in html_extract.recurring([html_extract.stream_of([" ".join(x)] if x else []) for x in streams])] == want


def brute_pages(rows):
    """Texts of (page_id, url, html), with each host's runs counted in dictionaries."""
    parts = [(i, (u or "").split("/")[2] if u else "", *html_extract.parts_of(h)) for i, u, h in rows]
    hosts = collections.defaultdict(set)
    for _, host, blocks, _ in parts:
        hosts[host].add(tuple(w for b in blocks for w in b.split(" ")))
    often = {}
    for host, streams in hosts.items():
        n = collections.Counter(run for s in streams for run in {s[i : i + 8] for i in range(len(s) - 7)})
        often[host] = {run for run, k in n.items() if k >= max(3, int(np.ceil(0.2 * len(streams))))}
    out = []
    for i, host, blocks, inside in parts:
        words, cut = [w for b in blocks for w in b.split(" ")], set()
        for at in range(len(words) - 7):
            if tuple(words[at : at + 8]) in often[host]:
                cut |= set(range(at, at + 8))
        held = [k for b, m in zip(blocks, inside) for k in [m] * len(b.split(" "))]
        if 2 * sum(held[k] for k in cut) > sum(held):
            cut = {k for k in cut if not held[k]}
        kept, at = [], 0
        for b in blocks:
            own = b.split(" ")
            flags = "".join("x" if at + k in cut else "." for k in range(len(own)))
            at += len(own)
            if "." not in flags:
                continue
            for m in re.finditer("x+", flags):
                if m.end() - m.start() >= 8:
                    own[m.start() : m.end()] = [None] * (m.end() - m.start())
            if any(own):
                kept.append(" ".join(filter(None, own)))
        out.append((i, "\n".join(kept)))
    return out


def test_pages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    notice, r = "this site keeps your choices for a year unless you say otherwise", random.Random(3)
    for i in range(40):  # pages of two hosts, some without marks, with a notice that structure doesn't mark
        body = " ".join(r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(r.randrange(0, 60)))
        inner = f"<p>{body}</p><p>{notice if i % 3 else ''} {i}</p>"
        rows.append((1000 + i, f"https://x{i % 2}.example/{i}", inner if i % 4 else f"<article>{inner}<article class='comment'>no</article></article>"))
    rows += [(None, None, None), (1, rows[0][1], "")]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "page_id long, url string, html string, host string, runs int")
    want = sorted(brute_pages(rows), key=repr)
    assert sum(notice in t for _, t in want) < 3
    for size in (html_extract.SHARD, 300):
        assert sorted(((x.page_id, x.text) for x in html_extract.extract(df, size).collect()), key=repr) == want


def test_host_runs_reach_marked_pages(spark):
    menu = "home news sport weather travel money shop help about us"
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    rows = [(i, f"https://h.example/{i}", f"<main><p>before {i}</p><article><p>{own[i]}</p><div>{menu}</div></article></main>") for i in range(12)]
    copy = " ".join(f"c{j}" for j in range(40))
    rows += [(20 + i, f"https://c.example/{i}", f"<article><p>{copy}</p><p>note {i}</p></article>") for i in range(4)]
    # A run on 4 of 24 pages is under a fifth of the host, however the pages fall into shards.
    few = "one run of ten words that few pages here hold"
    rows += [(100 + i, f"https://f.example/{i}", f"<article><p>{' '.join(f'v{i}x{j}' for j in range(30))}</p><div>{few if i < 4 else menu}</div></article>") for i in range(24)]
    want = {i: f"before {i}\n{own[i]}" for i in range(12)} | {20 + i: f"{copy}\nnote {i}" for i in range(4)}
    want |= {100 + i: " ".join(f"v{i}x{j}" for j in range(30)) + (f"\n{few}" if i < 4 else "") for i in range(24)}
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    for size in (html_extract.SHARD, 120):
        got = [(r.page_id, r.text) for r in html_extract.extract(df, size).collect()]
        assert len(got) == len(rows) + 1 and dict(got) == want


def test_pages_are_staged_without_tokens(spark, monkeypatch):
    """Shards read 16 bits a token: runs that only those hold alike aren't counted together, and no table but the shuffled one holds tokens."""
    seen, alike = {}, None
    for i in range(5000):
        h = int(html_extract.stream_of([f"word{i}"])[0]) >> 16
        if h in seen:
            alike = (seen[h], f"word{i}")
            break
        seen[h] = f"word{i}"
    menu = "home news sport weather travel money shop %s help about us"
    rows = [(i, f"https://h.example/{i}", f"<p>own text {i}</p><div>{menu % alike[i % 2]}</div>") for i in range(4)]
    rows += [(10 + i, f"https://k.example/{i}", f"<p>own text {i}</p><div>{menu % alike[0]}</div>") for i in range(4)]
    tables, staged = {}, html_extract.staged
    monkeypatch.setattr(html_extract, "staged", lambda df, name: tables.setdefault(name, staged(df, name)))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own text {i}" + (f"\n{menu % alike[i % 2]}" if i < 10 else "") for i in (0, 1, 2, 3)} | {10 + i: f"own text {i}" for i in range(4)}
    assert "tokens" not in tables["blocks"].columns
    texts = ["", "a b\nc", "x", "\u00e9 a"]
    assert [s.tolist() for s in html_extract.streams_of(pa.array(texts))] == [html_extract.stream_of(t.split("\n") if t else []).tolist() for t in texts]


def slow_walk(text):
    level, pos, out, step = fingerprint.level_of(len(text)), 0, [], 0
    classes = [*fingerprint._classes(text).tolist(), 0] if text else [0]
    while classes[pos]:
        block, at = divmod(step, fingerprint.BLOCK)
        if fingerprint._levels(block)[at] >= level:
            out.append(classes[pos] & 15)
        pos += int(fingerprint._moves(block)[at][classes[pos]])
        step += 1
    return level if text else 0, out


def test_walks_equal_one_at_a_time(docs):
    texts = ["", "a", "abc" * 200, *[r.text for r in docs.limit(25).collect()]]
    for t, (level, samples) in zip(texts, fingerprint.walk(texts), strict=True):
        assert (level, samples.tolist()) == slow_walk(t)


def test_fingerprints(spark, docs, odd, none):
    rows = fingerprint.fingerprints_with_next(docs).orderBy("doc_id").collect()
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert len(rows) == len(texts)
    for k, r in enumerate(rows):
        following = texts[(k + 1) % len(texts)]
        changed = fingerprint.edited(texts[k], following)
        fps = fingerprint.walk([texts[k], changed, following])
        assert (r.n_chars, r.edited_sha256) == (len(texts[k]), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(map(fingerprint.text_of, fps[:2]))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(fps[0], fps[1]), fingerprint.likeness(fps[0], fps[2]))
    far = [r for r in rows if r.n_chars >= 200]
    assert np.mean([r.near_edited > r.near_next for r in far]) > 0.95
    assert fingerprint.fingerprints_with_next(odd).count() == odd.count() and fingerprint.fingerprints_with_next(none).count() == 0
    assert fingerprint.similar_by_fingerprint(none.select("doc_id", F.lit("0:").alias("fingerprint"))).count() == 0


def test_bands_find_similar_fingerprints(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    r = random.Random(2)
    texts = {x.doc_id: x.text or "" for x in rows[:300]}
    base = r.sample([t for t in texts.values() if len(t) > 100], 30)
    for i in range(240):  # copies with edits, eight of each: many lists hold texts that are unlike their least
        t = list(base[i % 30])
        for _ in range(r.randrange(1, max(2, len(t) // 60))):
            t[r.randrange(len(t))] = r.choice("xyz")
        texts[10_000 + i] = "".join(t)
    ids = sorted(texts)
    fps = dict(zip(ids, fingerprint.walk([texts[i] for i in ids]), strict=True))
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if fingerprint.likeness(fps[a], fps[b]) >= 0.75]
    want = components(ids, pairs)
    df = spark.createDataFrame([(i, fingerprint.text_of(f)) for i, f in fps.items()] + [(None, "0:")], "doc_id long, fingerprint string")
    got = {x.doc_id: x.component_id for x in fingerprint.similar_by_fingerprint(df).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.97 * len(pairs) and all(want[i] == want[got[i]] for i in ids)


def test_pairs_of_lists_are_tried_by_bits(spark, monkeypatch):
    """Chance meets in band lists cost a bit a sample before whole samples are fetched."""
    r = random.Random(4)
    fps = fingerprint.walk(["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (0, 1, 7, 90, 300, 3000)])
    assert all(fingerprint.unpacked(fingerprint.packed(s), len(s)).tolist() == s.tolist() for _, s in fps)
    base = "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = [base, base[:150] + "x" + base[150:], *["".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(20)]]
    df = spark.createDataFrame([(i, fingerprint.text_of(f)) for i, f in enumerate(fingerprint.walk(texts))], "doc_id long, fingerprint string")
    tables, staged = collections.defaultdict(list), fingerprint.staged
    monkeypatch.setattr(fingerprint, "staged", lambda df, name: tables[name].append(staged(df, name)) or tables[name][-1])
    got = {x.doc_id: x.component_id for x in fingerprint.similar_by_fingerprint(df).collect()}
    assert got == {0: 0, 1: 0} | {i: i for i in range(2, 22)}
    assert [t.count() for t in tables["band-pairs"]] == [1, 0, 0] and "fp" not in tables["band-texts"][0].columns


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, rows = docs, docs.count()
    for name, stage in p.STAGES[:3]:
        new = stage(spark, at, SF).cache()
        assert new.columns == docs.columns, name
        assert new.count() <= rows
        at, rows = new, new.count()
    sets = {r.doc_id: shingles(r.text) for r in at.collect()}
    assert near_pairs(sets) == []
    mixed = p.STAGES[3][1](spark, at, SF).cache()
    assert mixed.columns == docs.columns
    packed = p.STAGES[4][1](spark, mixed, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()
