"""Alignment of two tokenizers' tokens by the bytes they cover.

Both token sequences of a text cover space+text. Two pointers run over the cumulative ends of
both; where they meet, a group ends. Links are all pairs of occurrences in a group. A text that is
null, empty or whose tokens of either side don't spell space+text (a tokenizer has normalised
it) has no tokens: zeros and an empty digest.

A cut before a space that follows something else than white space is a token end for both
tokenizers, so texts are encoded by runs between such cuts, and equal runs are encoded,
aligned and kept once, in a bounded memo. Documents are put together in blocks of some
megabytes: a block lists its distinct id pairs and, for each document, which of them it holds
how often. Spark counts pairs over all blocks, takes the maxima of both sides and joins the
counts back to blocks; a pair comes once a block, so that the most common pair is a small part
of any partition, and blocks are bounded whatever the corpus.

Repeated rows count each by itself; doc_id is carried, not used. Other columns are ignored. A
text is never cut; within a group pairs are made of distinct ids, with how often they stand there.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, staged, table
from .tokens import tokenizer_path

#: Characters of text in a block, and of those encoded at once; bytes of runs and their tables in the memo; the longest run that is kept; what a run takes besides its characters and links.
BLOCK, SLICE, MOST, LONGEST, EACH = 3 << 20, 300_000, 64 << 20, 64, 300
#: Blocks that a task which writes or reads them holds at once: a block takes some 4 MB.
AT_ONCE = 4
#: Runs that are encoded in one text: those that begin with their only white space.
TOGETHER = 512
_JOINS = re.compile(r" [^\s\x1c-\x1f]+").fullmatch
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A letter before one of these is a token end of byte-level vocabularies; of the other side's too where no piece holds the two together.
_MARKS = ".,;:!?$&%#*"


def groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """How many tokens of each side stand before each common end."""
    out, i, j = [], 0, 0
    while i < len(ends_a) and j < len(ends_b):
        if ends_a[i] == ends_b[j]:
            i, j = i + 1, j + 1
            out.append((i, j))
        elif ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> tuple[str, Counter, int]:
    """(groups as text, occurrences of linked id pairs, number of groups)."""
    said, links, i, j = [], Counter(), 0, 0
    for m, n in groups(ends_a, ends_b):
        left, right = a[i:m], b[j:n]
        said.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
        if len(left) == len(right) == 1:
            links[left[0] << 32 | right[0]] += 1
        else:
            right_times = Counter(right).items()
            for x, k in Counter(left).items():
                for y, q in right_times:
                    links[x << 32 | y] += k * q
        i, j = m, n
    return ";".join(said), links, len(said)


class Aligner:
    """Both encoders with a memo of aligned runs."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(p) for p in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        marks = "".join(m for m in _MARKS if not any(re.search(f"[{_LETTER}]{re.escape(m)}", p) for p in pieces))
        self.cut = re.compile(rf"(?<=[^\s\x1c-\x1f])(?= )" + (rf"|(?<=[{_LETTER}])(?=[{re.escape(marks)}])" if marks else ""))
        # A run by itself is encoded after this letter, whose piece is then left out.
        self.lead = self.b.encode("a")
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.said: list[str] = []
        #: For each run: tokens of A, of B, groups, links, and whether it is spelt as the text.
        self.rows = np.empty((0, 5), np.int64)
        self.codes, self.times, self.starts = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        self.asked = np.empty(0, np.int64)  # how often, since the memo was last thinned
        self.held = 0

    def _thin(self) -> None:
        """Keep the runs asked for again since the last time, the most asked for first, up to half of the memo, and give the memory of the others back."""
        size = np.diff(self.starts)
        kept = np.argsort(-self.asked, kind="stable")
        kept = kept[: np.count_nonzero(self.asked > 1)]
        held = EACH + np.fromiter(map(len, self.said), np.int64, len(self.said)) + 16 * size
        kept = np.sort(kept[np.cumsum(held[kept]) <= MOST // 2])
        number = np.full(len(self.said), -1)
        number[kept] = np.arange(len(kept))
        number = number.tolist()
        self.memo = {run: number[i] for run, i in self.memo.items() if number[i] >= 0}
        self.said = [self.said[i] for i in kept.tolist()]
        take = _spans(self.starts[kept], size[kept])
        self.rows, self.codes, self.times = self.rows[kept], self.codes[take], self.times[take]
        self.starts = np.concatenate([[0], np.cumsum(size[kept])])
        self.asked = np.zeros(len(kept), np.int64)
        self.held = int(held[kept].sum())
        del number
        release()

    def _add(self, runs: list[str]) -> None:
        """Put runs into the tables, in order."""
        rows, said, sizes, codes, times = [], [], [], [], []

        def one(run: str) -> None:
            b = self.b.encode("a" + run)[len(self.lead) :]
            text, links, n, fine = self.compare(run.encode(), a := self.a.encode(run, add_special_tokens=False).ids, b)
            rows.append(np.array([[len(a), len(b), n, sum(links.values()), fine]], np.int64))
            said.append(text)
            sizes.append([len(links)])
            codes.append(np.fromiter(links, np.int64, len(links)))
            times.append(np.fromiter(links.values(), np.int64, len(links)))

        def many(some: list[str]) -> None:
            got = self._together(some)
            if got is None:
                for run in some:
                    one(run)
                return
            rows.append(got[0])
            said.extend(got[1])
            sizes.append(got[2])
            codes.append(got[3])
            times.append(np.ones(len(got[3]), np.int64))

        joined: list[str] = []
        for run in runs:
            if len(run) <= LONGEST and _JOINS(run):
                joined.append(run)
                if len(joined) < TOGETHER:
                    continue
                run = None
            if joined:
                many(joined)
                joined = []
            if run is not None:
                one(run)
        if joined:
            many(joined)
        self.said += said
        for held, new in ((self.rows, rows), (self.starts, [self.starts[-1] + np.cumsum(np.concatenate(sizes))]), (self.codes, codes), (self.times, times), (self.asked, [np.zeros(len(runs), np.int64)])):
            n = len(held)
            held.resize((n + sum(map(len, new)), *held.shape[1:]), refcheck=False)  # grows in its place where it can
            np.concatenate(new, out=held[n:])
        self.held += EACH * len(runs) + sum(map(len, said)) + 16 * sum(map(len, codes))

    def _together(self, runs: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray] | None:
        """The same for runs that can be encoded as one text: the merge of both sides' ends over all of them at once; None if they can't be told apart."""
        text = "".join(runs)
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        if b"".join([self.bytes_b[i] for i in b.tolist()]) != text.encode():
            return None
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        run_ends = np.cumsum(np.fromiter((len(r.encode()) for r in runs), np.int64, len(runs)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last = np.searchsorted(common, run_ends)
        if last[-1] >= len(common) or (common[last] != run_ends).any() or ends_a[-1] != run_ends[-1]:
            return None
        upto_a, upto_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        from_a, from_b = upto_a - n_a, upto_b - n_b
        # Each token of A meets all of its group's tokens of B.
        group = np.repeat(np.arange(len(common)), n_a)
        meets = n_b[group]
        at = np.cumsum(meets)
        b_of = np.arange(at[-1]) - np.repeat(at - meets, meets) + np.repeat(from_b[group], meets)
        codes = np.repeat(a, meets) << 32 | b[b_of]
        said = [f"{x}|{y}" for x, y in zip(a[from_a].tolist(), b[from_b].tolist(), strict=True)]
        for g in np.flatnonzero((n_a > 1) | (n_b > 1)).tolist():
            said[g] = f"{','.join(map(str, a[from_a[g] : upto_a[g]].tolist()))}|{','.join(map(str, b[from_b[g] : upto_b[g]].tolist()))}"
        bounds = np.concatenate([[0], last + 1])
        by_run = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        links = by_run(n_a * n_b)
        rows = np.stack([by_run(n_a), by_run(n_b), np.diff(bounds), links, np.ones(len(runs), np.int64)], 1)
        cut = bounds.tolist()
        return rows, [";".join(said[i:j]) for i, j in zip(cut, cut[1:])], links, codes

    def compare(self, raw: bytes, a: list[int], b: list[int]) -> tuple[str, Counter, int, bool]:
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        fine = b"".join(parts_a) == raw == b"".join(parts_b)
        if not fine:
            return "", Counter(), 0, False
        return (*aligned(a, b, np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()), True)

    def documents(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, digest) of each text; document number, pair and occurrences of what its runs link."""
        if self.held > MOST:
            self._thin()
        split = self.cut.split
        runs = [split(" " + t) if t else [] for t in texts]
        fresh = [r for r in dict.fromkeys(chain.from_iterable(runs)) if r not in self.memo]
        if fresh:
            # Short runs that can be encoded together come first.
            fresh.sort(key=lambda r: len(r) > LONGEST or not _JOINS(r))
            self.memo.update(zip(fresh, range(len(self.said), len(self.said) + len(fresh)), strict=True))
            self._add(fresh)
        count = np.array([len(r) for r in runs], np.int64)
        where = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(runs)), np.int64, int(count.sum()))
        np.add.at(self.asked, where, 1)
        bounds = np.concatenate([[0], np.cumsum(count)])
        by_doc = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:]), np.int64), np.cumsum(x, 0)])[bounds], axis=0)
        rows = by_doc(self.rows[where])
        good = (rows[:, 4] == count) & (count > 0)
        rows = np.where(good[:, None], rows, 0)[:, :4]
        said, places = self.said, where.tolist()
        digests = [hashlib.sha256(";".join([said[i] for i in places[lo:hi]]).encode()).hexdigest() if fine else "" for lo, hi, fine in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist(), strict=True)]
        doc = np.repeat(np.arange(len(texts)), count)
        kept = good[doc]
        where, doc = where[kept], doc[kept]
        size = self.starts[where + 1] - self.starts[where]
        take = _spans(self.starts[where], size)
        codes, times, doc = self.codes[take], self.times[take], np.repeat(doc, size)
        for r in fresh:
            if len(r) > LONGEST:
                self.asked[self.memo.pop(r)] = 0
        return [(*r, d) for r, d in zip(rows.tolist(), digests, strict=True)], doc, codes, times


def _spans(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, ... of so many entries each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(starts - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One memo for all tasks that a Python worker runs."""
    return Aligner(path_a, path_b)


_BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, pair array<long>, holders array<long>, entries array<long>, place array<int>, times array<long>"


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a block: its documents' figures; its distinct pairs and how many documents hold each; each document's number of entries, and the entries' places among the pairs and occurrences."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        both, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32

        def block(ids: list, parts: list) -> pd.DataFrame:
            rows = list(chain.from_iterable(p[0] for p in parts))
            base = np.cumsum([0, *[len(p[0]) for p in parts]])
            doc, code, times = (np.concatenate([p[i] + (base[k] if i == 1 else 0) for k, p in enumerate(parts)]) for i in (1, 2, 3))
            pair, place = np.unique(code, return_inverse=True)
            key, back = np.unique(doc * max(len(pair), 1) + place, return_inverse=True)  # an entry for each document and pair
            place = key % max(len(pair), 1)
            columns = zip(*rows, strict=True)
            return pd.DataFrame({
                "block": [number], "doc_id": [ids], **{k: [list(c)] for k, c in zip(("n_a", "n_b", "n_groups", "n_links", "digest"), columns, strict=True)}, "pair": [pair], "holders": [np.bincount(place, minlength=len(pair))],
                "entries": [np.bincount(key // max(len(pair), 1), minlength=len(rows))], "place": [place.astype(np.int32)], "times": [np.bincount(back, times, len(key)).astype(np.int64)],
            })

        ids, parts, held = [], [], 0
        for frame in frames:
            sizes = [len(t or "") for t in frame["text"]]
            lo = 0
            while lo < len(frame):
                hi, held_now = lo, held
                while hi < len(frame) and (hi == lo or held_now + sizes[hi] <= min(BLOCK, held + SLICE)):
                    held_now += sizes[hi]
                    hi += 1
                ids += [None if pd.isna(i) else int(i) for i in frame["doc_id"].iloc[lo:hi]]
                parts.append(both.documents(frame["text"].iloc[lo:hi].tolist()))
                held, lo = held_now, hi
                if held >= BLOCK or lo < len(frame) and held + sizes[lo] > BLOCK:
                    yield block(ids, parts)
                    ids, parts, held, number = [], [], 0, number + 1
        if parts:
            yield block(ids, parts)
        del ids, parts
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, _BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best_a, best_b (whether no other pair of its A or B id has more)."""
    each = blocks.select(F.explode(F.arrays_zip("pair", "holders")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.holders").alias("n"))
    counts = staged(each.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))}), "pairs")
    for side in "ab":
        most = counts.groupBy(side).agg(F.max("n").alias(f"most_{side}"))  # a row an id at most
        counts = counts.join(most, side)
    return counts.select("pair", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_b long"


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a document: tokens of both sides, groups, links, how many of these are an id's most common, the sum of their counts, and a digest of the groups."""
    blocks = staged(aligned_blocks(docs, path_a, path_b), "aligned", AT_ONCE)
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pair").alias("place", "pair"))
    known = asked.join(pair_counts(blocks), "pair").select("of", "place", "n", "best_a", "best_b")
    held = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "entries", F.col("place").alias("at"), "times")

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        """One block and its distinct pairs, which its size bounds."""
        if aligner.cache_info().currsize:  # the memo of the stage before
            aligner.cache_clear()
            release()
        whole = lambda c: block.column(c).combine_chunks().flatten()
        entries, at, times = (whole(c).to_numpy(zero_copy_only=False) for c in ("entries", "at", "times"))
        starts, where = np.concatenate([[0], np.cumsum(entries)]), told.column("place").to_numpy()

        def summed(name: str) -> pa.Array:
            x = np.zeros(told.num_rows, np.int64)
            x[where] = told.column(name).to_numpy()
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(times * x[at])])[starts]).astype(np.int64))

        columns = [*[whole(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], summed("best_a"), summed("n"), whole("digest"), summed("best_b")]
        return pa.Table.from_arrays(columns, names=[f.split(" ")[0] for f in _RESULT.split(", ")])

    return held.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, _RESULT)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a piece tokenizer over all documents."""
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
ORACLES: dict[str, str] = {}
