"""Token ids of whole texts from a public tokenizer file, memoised by pre-token run."""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain, pairwise

import numpy as np

from .common import release

#: Runs whose ends are token boundaries for both tokenizers used here: a letter run before
#: white space or plain punctuation, else everything up to white space, else white space itself.
_RUNS = {
    True: re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,;:!?*$%&#]|$)| ?\S+|\s+(?!\S)|\s+"),
    False: re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,;:!?*$%&#]|$)|\S+"),
}
#: Python takes these for white space and the tokenizers don't.
_ODD = re.compile(r"[\x1c-\x1f]")


#: Longer runs aren't remembered. EACH: bytes that a run takes in the memo, its characters and the tables' places.
LONGEST, EACH = 64, 220
#: Runs that are encoded in one text, and what such a run is.
TOGETHER = 512
#: Characters of runs that the library is given at once.
CHARACTERS = 1 << 16
_JOINS = {True: re.compile(r" \S+\Z").match, False: re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z").match}


class _Memo(dict):
    """Numbers runs in the order in which they are first asked for; fresh holds those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.made = 0

    def __missing__(self, run: str) -> int:
        self[run] = i = self.made
        self.made += 1
        self.fresh.append(run)
        return i


class Encoder:
    """encode(texts) -> (ids, counts): the same ids as encoding each whole text.

    Equal runs are encoded once. Beyond `most` bytes the memo keeps only runs that were asked for
    again, up to half of that; it keeps no run of over LONGEST characters. Texts in which runs
    can't be told apart safely are encoded whole.
    """

    def __init__(self, path: str, most: int = 128 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = self.tokenizer.normalizer is None
        self.bytes_of = self.byte_lengths() if self.spaced else None
        self.ends_word = None if self.spaced else self.word_ends()
        self.most = most
        self.index = _Memo()
        self.held = 0
        self.pool, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.asked = np.empty(0, np.int64)  # how often, since the memo was last thinned

    def _thin(self) -> None:
        """Keep the runs asked for again since the last time, the most asked for first, and give the memory of the others back."""
        kept = np.argsort(-self.asked, kind="stable")
        kept = kept[: np.count_nonzero(self.asked > 1)]
        kept = np.sort(kept[np.cumsum(EACH + 4 * self.lengths[kept]) <= self.most // 2])
        number = np.full(len(self.asked), -1)
        number[kept] = np.arange(len(kept))
        old, self.index = self.index, _Memo()
        for run, i in old.items():
            if number[i] >= 0:
                self.index[run] = int(number[i])
        self.index.made = len(kept)
        size = self.lengths[kept]
        ends = np.cumsum(size)
        self.pool = self.pool[np.repeat(self.starts[kept] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        self.starts, self.lengths, self.asked = ends - size, size, np.zeros(len(kept), np.int64)
        self.held = EACH * len(kept) + 4 * len(self.pool)
        del old
        release()

    def _add(self, runs: list[str]) -> None:
        alike = _JOINS[self.spaced] if self.spaced or self.ends_word is not None else lambda _: None
        joins = np.array([alike(r) is not None for r in runs], bool)
        lengths = np.zeros(len(runs), np.int64)
        starts, pool = np.zeros(len(runs), np.int64), []
        first = at = len(self.pool)
        for chosen, encoded in ((joins, self._together), (~joins, self._apart)):
            if not chosen.any():
                continue
            own, flat = encoded([r for r, c in zip(runs, chosen.tolist(), strict=True) if c])
            lengths[chosen], starts[chosen] = own, at + np.cumsum(own) - own
            pool.append(flat)
            at += len(flat)
        for held, new in ((self.pool, np.concatenate(pool)), (self.starts, starts), (self.lengths, lengths), (self.asked, np.zeros(len(runs), np.int64))):
            n = len(held)
            held.resize(n + len(new), refcheck=False)  # grows in its place where it can
            held[n:] = new
        self.held += EACH * len(runs) + 4 * (at - first)

    def _apart(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each run, all ids), run by run; some CHARACTERS at once, as the library holds far more than the ids of each."""
        lengths, flat = [], []
        ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs))) // CHARACTERS
        bounds = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(runs)]
        for lo, hi in pairwise(bounds):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(runs[lo:hi], add_special_tokens=False)]
            own = np.fromiter(map(len, ids), np.int64, len(ids))
            lengths.append(own)
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(own.sum())))
        return np.concatenate(lengths), np.concatenate(flat)

    def _together(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs that begin with their only space, hence at a token boundary, or are words of letters: many in one text, told apart by the bytes that ids stand for, or by the ids that end words."""
        texts = [("" if self.spaced else " ").join(runs[i : i + TOGETHER]) for i in range(0, len(runs), TOGETHER)]
        _, flat = self._apart(texts)
        if not self.spaced:
            last = np.flatnonzero(self.ends_word[flat])
            if len(last) != len(runs) or last[-1] + 1 != len(flat):
                return self._apart(runs)
            return np.diff(last, prepend=-1), flat
        ends = np.cumsum(self.bytes_of[flat])
        wanted = np.cumsum(np.fromiter(map(len, map(str.encode, runs)), np.int64, len(runs)))
        last = np.searchsorted(ends, wanted)
        if last[-1] + 1 != len(ends) or (ends[last] != wanted).any():
            return self._apart(runs)
        return np.diff(last, prepend=-1), flat

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        find = _RUNS[self.spaced].findall
        if self.held > self.most:
            self._thin()
        runs = [[t] if _ODD.search(t) else find(t) for t in (t or "" for t in texts)]
        bounds = np.cumsum([len(d) for d in runs])
        where = np.fromiter(map(self.index.__getitem__, chain.from_iterable(runs)), np.int64, int(bounds[-1]) if runs else 0)
        fresh = self.index.fresh
        if fresh:
            self._add(fresh)
            self.index.fresh = []
        np.add.at(self.asked, where, 1)
        size = self.lengths[where]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.starts[where] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])[bounds]
        for r in fresh:
            if len(r) > LONGEST:
                self.asked[self.index.pop(r)] = 0
        return ids, np.diff(total, prepend=0)

    def byte_lengths(self) -> np.ndarray:
        """Bytes that each id of a byte-level vocabulary stands for."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token)
        return out

    def word_ends(self) -> np.ndarray | None:
        """Whether each id ends a word; None for a vocabulary that doesn't mark words' ends."""
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not mark:
            return None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            out[i] = token.endswith(mark)
        return out


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def forget() -> None:
    """Give back what memos of stages before hold, in a stage that encodes nothing."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        release()


@functools.cache
def encoder(path: str, most: int = 128 << 20) -> Encoder:
    """One memo for all tasks that a Python worker runs."""
    return Encoder(path, most)
