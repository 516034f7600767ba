"""Encoding with a public byte-level BPE vocabulary, by speculation and verification.

Texts are cut into words by array arithmetic over the classes of their characters (no regular expression runs over the
text), equal words of a batch are found by hashing and compared character by character, and each different word is
encoded once per worker:

1. speculate: greedy longest match over the vocabulary proposes tokens
2. verify: a tokenisation is the one that merging by rank gives if and only if every adjacent pair of tokens, merged by
   itself, stays that pair; the pairs of all new words of a batch are tested together against a table of known pairs
3. only words with an incompatible pair are merged exactly

Defined results: null and empty texts have the empty list of ids; strings that look like special tokens are ordinary
text; texts of any length are encoded whole (memory grows with the longest text).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters worked on at once.
BLOCK = 1 << 20
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Endings that are words of their own after an apostrophe; fixed by the vocabulary's pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, other."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if a < 0xD800 <= b:
                table[a:0xD800], table[0xE000 : b + 1] = kind, kind
            else:
                table[a : b + 1] = kind
    return table


def word_starts(cp: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where words start: cp are the code points of texts laid end to end, doc_start marks each text's first."""
    k = char_classes()[cp]
    n = len(cp)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, k[:-1]
    before[doc_start] = 9
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, doc_start[1:]
    after_is_text = np.empty(n, bool)
    after_is_text[-1], after_is_text[:-1] = False, k[1:] != SPACE
    after_is_text &= ~last
    blank_before = np.empty(n, bool)
    blank_before[0], blank_before[1:] = False, cp[:-1] == 32
    blank_before[doc_start] = False
    space = k == SPACE
    start = np.where(space, (before != SPACE) | after_is_text, (before != k) & ~blank_before)
    marks = np.flatnonzero((cp == 39) & start)
    if len(marks):  # 's and its like
        for m in marks:
            for c in CONTRACTIONS:
                e = m + 1 + len(c)
                if e <= n and not doc_start[m + 1 : e].any() and "".join(map(chr, cp[m + 1 : e])) == c:
                    start[m + 1 : e] = False
                    if e < n and k[e] == LETTER:
                        start[e] = True
                    break
    return start


class Encoder:
    """Word encoder with what it has learnt so far; one for each worker process and vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.width = max(self.ranks.values()) + 1
        longest: dict[bytes, int] = {}
        for t in self.ranks:
            longest[t[:2]] = max(longest.get(t[:2], 0), len(t))
        self.longest = longest
        self.words: dict[str, int] = {}
        self.good: dict[int, bool] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.at = np.empty(1 << 14, np.int64)
        self.length = np.empty(1 << 14, np.int64)

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ranks = [], 0, len(word), self.ranks
        while i < n:
            j = min(n, i + self.longest.get(word[i : i + 2], 1))
            while j > i + 1 and word[i:j] not in ranks:
                j -= 1
            out.append(ranks[word[i:j]])
            i = j
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank: the pair of lowest rank, leftmost first, until none is left."""
        import heapq

        ranks, n = self.ranks, len(word)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, e = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or end[j] != e:  # one of the two has grown since
                continue
            alive[j] = False
            end[i] = e
            if e < n:
                prev[e] = i
                if (q := ranks.get(word[i : end[e]])) is not None:
                    heapq.heappush(heap, (q, i, end[e]))
            if (p := prev[i]) >= 0 and (q := ranks.get(word[p:e])) is not None:
                heapq.heappush(heap, (q, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def _add(self, word: str, ids: list[int]) -> None:
        k, n = len(self.words), len(ids)
        if k == len(self.at):
            self.at, self.length = np.resize(self.at, 2 * k), np.resize(self.length, 2 * k)
        while self.used + n > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + n] = ids
        self.at[k], self.length[k] = self.used, n
        self.used += n
        self.words[word] = k

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before."""
        raw = [w.encode() for w in words]
        tried = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, tried), np.int64, len(tried))
        flat = np.fromiter((t for x in tried for t in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(tried)), sizes)
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            pair = (flat[:-1] * self.width + flat[1:])[inside]
            own = owner[1:][inside]
            keys, where = np.unique(pair, return_inverse=True)
            ok = np.fromiter(map(self._compatible, keys.tolist()), bool, len(keys))
            failed = set(own[~ok[where]].tolist())
        else:
            failed = set()
        for i, w in enumerate(words):
            self._add(w, self.exact(raw[i]) if i in failed else tried[i])

    def _compatible(self, pair: int) -> bool:
        known = self.good.get(pair)
        if known is None:
            a, b = divmod(pair, self.width)
            known = self.good[pair] = self.exact(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of texts laid end to end: index of each word, its text, and per text the number of ids."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(cp)
        first = np.zeros(n, bool)
        begins = np.cumsum(sizes) - sizes
        first[begins[sizes > 0]] = True
        starts = np.flatnonzero(word_starts(cp, first))
        ends = np.append(starts[1:], n)
        up, down = _powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        key = (total[ends] - total[starts]) * down[starts]
        _, rep, inverse = np.unique(key, return_index=True, return_inverse=True)
        length = ends - starts
        # Words of one hash must be the same word; where they are not (never seen), each is looked up by itself.
        same = length == length[rep][inverse]
        if same.all():
            idx = np.arange(n) - np.repeat(starts, length) + np.repeat(starts[rep][inverse], length)
            same = np.logical_and.reduceat(cp == cp[idx], starts)
        words = [joined[a:b] for a, b in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)]
        new = [w for w in words if w not in self.words]
        if new:
            self.learn(new)
        index = np.fromiter((self.words[w] for w in words), np.int64, len(words))[inverse]
        for i in np.flatnonzero(~same).tolist():
            w = joined[starts[i] : ends[i]]
            if w not in self.words:
                self.learn([w])
            index[i] = self.words[w]
        doc = np.searchsorted(begins, starts, side="right") - 1 if (sizes > 0).all() else np.repeat(np.arange(len(texts)), sizes)[starts]
        count = np.bincount(doc, self.length[index], len(texts)).astype(np.int64)
        return index, doc, count

    def ids(self, index: np.ndarray) -> np.ndarray:
        size = self.length[index]
        base = np.cumsum(size) - size
        return self.flat[np.repeat(self.at[index] - base, size) + np.arange(int(size.sum()))]


_power_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power_cache or len(_power_cache[0]) < n:
        m = max(n, BLOCK)
        _power_cache[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE)]
    return _power_cache[0], _power_cache[1]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[list[str]]:
    """texts in order, in lists of at most ``most`` characters (one text may be longer); null becomes empty."""
    own, n = [], 0
    for t in texts:
        t = t or ""
        if own and n + len(t) > most:
            yield own
            own, n = [], 0
        own.append(t)
        n += len(t)
    if own:
        yield own


#: Words kept by a worker; beyond that the store is started afresh, so that memory stays bounded.
MOST_WORDS = 600_000


def _fresh(path: str) -> Encoder:
    e = encoder(path)
    if len(e.words) > MOST_WORDS:
        encoder.cache_clear()
        e = encoder(path)
    return e


def encode(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids) of every row; vocabulary is the path of a ``.tiktoken`` file of ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for own in blocks(b.column(1).to_pylist()):
                e = _fresh(vocabulary)
                index, _, count = e.encode(own)
                offsets = np.zeros(len(own) + 1, np.int32)
                np.cumsum(count, out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(e.ids(index)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(own)), ids], names=[key, "ids"])
                at += len(own)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = [_fresh(vocabulary).encode(own)[2] for own in blocks(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(count) if count else np.empty(0, np.int64))], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, n_tokens long")
