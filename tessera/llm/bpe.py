"""Encoding of a whole corpus by a public byte-level BPE tokenizer.

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves: whole
arrays of them at a time, each slot verified by its bytes. What is left is merged by rank, with a heap of
candidate merges over a linked list of the pre-token's bytes, in time n log n however long it is. Pre-tokens are
looked up once for each batch in which they occur. Documents are independent: nothing is shuffled, and the
only thing broadcast is the vocabulary, whose size does not depend on the data.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARIES = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Steps modulo a prime reach every slot; modulo the number of keys some keys would have only a few slots to try.
PRIME = 2**31 - 1


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by hash and displace: each key's bucket has a displacement
    that sends its keys to free slots; buckets of one key name their slot outright."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.size = len(keys)
        self.buckets = max(1, n // 4)
        hashes = self.hashes(keys)
        bucket, a, b = self._parts(hashes)
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        slot = np.zeros(n, np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        tries = np.arange(256)[:, None]
        singles = []
        for g in np.argsort(-np.diff(edges), kind="stable"):
            of = order[edges[g] : edges[g + 1]]
            if len(of) == 1:
                singles.append((g, of[0]))
            if len(of) < 2:
                continue
            start = 0
            while True:
                places = (a[of] + (tries + start) * b[of]) % PRIME % n
                ordered = np.sort(places, axis=1)
                good = free[places].all(axis=1) & (np.diff(ordered, axis=1) != 0).all(axis=1)
                if good.any():
                    d = int(np.argmax(good))
                    self.shift[g], slot[of] = start + d, places[d]
                    free[places[d]] = False
                    break
                start += 256
        for (g, k), place in zip(singles, np.flatnonzero(free), strict=False):
            self.shift[g], slot[k] = -place - 1, place
        self.key_at = np.zeros(n, np.int64)
        self.key_at[slot] = np.arange(n)

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _parts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)
        return (low ^ (high >> 7)) % self.buckets, low % PRIME, 1 + high % (PRIME - 1)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Number of the only key of the set that each of keys may be."""
        bucket, a, b = self._parts(self.hashes(keys))
        d = self.shift[bucket]
        return self.key_at[np.where(d < 0, -d - 1, (a + d * b) % PRIME % self.size)]


class Encoder:
    """ranks: bytes of each token to its id; merges go by falling priority of the merged token's id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 200_000) -> None:
        self.tokens = list(ranks)
        self.ids = np.array([ranks[t] for t in self.tokens], np.int32)
        self.hash = PerfectHash(self.tokens)
        self.array = pa.array(self.tokens, pa.large_binary())
        self.pattern, self.remember = pattern, remember
        self.known: dict[bytes, list[int]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "tokens": None}

    @property
    def ranks(self) -> dict[bytes, int]:
        if getattr(self, "_ranks", None) is None:
            self._ranks = dict(zip(self.array.to_pylist(), self.ids.tolist(), strict=True))
        return self._ranks

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the pair of neighbours with the lowest rank, the leftmost
        first, becomes one until none is left."""
        ranks = self.ranks
        n = len(word)
        end = list(range(1, n + 1))  # of the part that begins at each place
        before = list(range(-1, n - 1))
        alive = bytearray(b"\x01" * n)
        heap = []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                r = ranks.get(word[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0:
                r = ranks.get(word[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens one after the other, and where each begins, with the end."""
        raw = words.cast(pa.large_binary())
        listed = raw.to_pylist()
        at = self.hash.find(listed)
        whole = pc.equal(self.array.take(pa.array(at)), raw).to_numpy(zero_copy_only=False)
        sizes = np.ones(len(listed), np.int64)
        missed = np.flatnonzero(~whole)
        merged = []
        for k in missed:
            word = listed[k]
            ids = self.known.get(word)
            if ids is None:
                ids = self.merge(word)
                if len(word) <= 64:
                    if len(self.known) >= self.remember:
                        self.known.clear()
                    self.known[word] = ids
            merged.append(ids)
            sizes[k] = len(ids)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(starts[-1], np.int32)
        flat[starts[:-1][whole]] = self.ids[at[whole]]
        for k, ids in zip(missed, merged, strict=True):
            flat[starts[k] : starts[k + 1]] = ids
        return flat, starts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each begins, with the end. None has no ids, as has ""."""
        find = _pattern(self.pattern).findall
        words: list[str] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                words += find(text)
            counts[k + 1] = len(words)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        flat, starts = self._words(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(starts)[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(starts[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[counts]


@lru_cache(8)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def load(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def _pieces(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about most characters together at most, or of one text."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, keep: list[str], text: str, vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    """The columns keep of all rows of docs with ids, the token ids of the text as an array of int, or n_tokens.

    vocabulary is the path of a rank file. There are no special tokens: their strings in a text are ordinary
    text. Empty and null texts have an empty array, so every row of docs gives one row; texts are taken whole.
    Other columns of docs are not read.
    """
    encoder = docs.sparkSession.sparkContext.broadcast(load(vocabulary or f"{VOCABULARIES}/{BYTE_BPE_50K}"))
    result = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*[docs.schema[k] for k in keep], result])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder.value
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for start, stop in _pieces(texts):
                ids, ends = own.encode(texts[start:stop])
                made = pa.array(np.diff(ends)) if counts_only else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(start, stop - start) for k in range(len(keep))], made], [*keep, result.name])

    return docs.select(*keep, text).mapInArrow(run, schema)


def token_counts(docs: DataFrame, keep: list[str], text: str, vocabulary: str | None = None) -> DataFrame:
    return encode(docs, keep, text, vocabulary, counts_only=True)
