"""Byte-level BPE with a minimal perfect hash for whole pre-tokens and a heap for the others."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import count
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

# Letters and numbers that the regex module knows but the tokenizer's own Unicode tables (version 16) do
# not; there they are neither letter nor number.
LATE = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)
_ROWS = 500  # documents that a task turns at once
_MEMO = 1 << 19  # pre-tokens that a task remembers; the memo starts anew when full


class PerfectHash:
    """Minimal perfect hash over a fixed set of byte strings (hash, displace, compare).

    Keys fall into buckets; the largest buckets first look for a displacement that sends all their keys to free
    slots, buckets of one key take the free slots that are left. Each key has one of exactly ``len(keys)`` slots.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.size = len(keys)
        self.buckets = max(1, self.size // 2)
        self.shift = array("q", bytes(8 * self.buckets))
        self.keys: list[bytes | None] = [None] * self.size
        taken = bytearray(self.size)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_128_intdigest(key)
            groups.setdefault((h & 0xFFFFFFFF) % self.buckets, []).append((h >> 32, key))
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                break
            for d in count():
                slots = {self._slot(h, d) for h, _ in members}
                if len(slots) == len(members) and not any(map(taken.__getitem__, slots)):
                    break
            self.shift[bucket] = d
            for h, key in members:
                s = self._slot(h, d)
                self.keys[s], taken[s] = key, 1
        free = (s for s, key in enumerate(self.keys) if key is None)
        for bucket, members in groups.items():
            if len(members) == 1:
                s = next(free)
                self.shift[bucket] = -s - 1
                self.keys[s] = members[0][1]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD1B54A32D192ED03 >> 17) % self.size

    def find(self, key: bytes) -> int:
        """Slot of the key, or -1 if it is none of the set."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h & 0xFFFFFFFF) % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h >> 32, d)
        return s if self.keys[s] == key else -1


class Vocabulary:
    """Ranks of byte strings; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        self.hash = PerfectHash(list(ranks))
        self.ids = array("l", (ranks[key] for key in self.hash.keys))
        self.pieces = dict(zip(self.ids, self.hash.keys))
        self.ranks = ranks  # neighbours in a merge are looked up here

    def rank(self, piece: bytes) -> int:
        s = self.hash.find(piece)
        return -1 if s < 0 else self.ids[s]

    def merge(self, piece: bytes) -> list[int]:
        """Merge neighbours by lowest rank, leftmost first: a heap of pairs over a doubly linked list of bytes."""
        n, get, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = pop(heap)
            j = after[i]
            # A pair is out of date when its left part is merged away (0) or the pair has another rank by now.
            if not j or j >= n or get(piece[i : after[j]]) != r:
                continue
            end = after[i] = after[j]
            after[j] = 0
            if end < n:
                before[end] = i
                if (r := get(piece[i : after[end]])) is not None:
                    push(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := get(piece[h:end])) is not None:
                push(heap, (r, h))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out


class Encoder(dict):
    """Pre-token to the little-endian bytes of its ids; a miss is resolved by the hash, then by merging."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        older = regex.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--[{LATE}]]", vocabulary.pattern)
        self.older = regex.compile(older, regex.V1).findall
        self.late = regex.compile(f"[{LATE}]").search

    def ids(self, token: str) -> bytes:
        piece = token.encode()
        r = self.vocabulary.rank(piece)
        return np.array([r] if r >= 0 else self.vocabulary.merge(piece), "<u4").tobytes()

    def __missing__(self, token: str) -> bytes:
        if not token.isascii() and self.late(token):
            raise LookupError(token)
        ids = self[token] = self.ids(token)
        return ids

    def __call__(self, text: str | None) -> bytes:
        if len(self) > _MEMO:
            self.clear()
        if not text:
            return b""
        try:
            return b"".join(map(self.__getitem__, self.split(text)))
        except LookupError:  # a late letter: split by the older tables
            return b"".join(map(self.ids, self.older(text)))


@cache
def load(path: str, pattern: str) -> Vocabulary:
    """Read a rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}, pattern)


_ENCODERS: WeakKeyDictionary[Broadcast, Encoder] = WeakKeyDictionary()


def _encoder(shared: Broadcast) -> Encoder:
    """One per Python worker, so that its memo outlives a task. It goes with its vocabulary, which Spark takes from a worker
    with the first task that doesn't use it; a worker that later stages reuse keeps none of it."""
    if shared not in _ENCODERS:
        _ENCODERS[shared] = Encoder(shared.value)
    return _ENCODERS[shared]


def share(spark: SparkSession, vocabulary: Vocabulary | Broadcast) -> Broadcast:
    """The vocabulary for all tasks: a fixed file of some 50,000 pieces. Who encodes and decodes shares it once, as a worker
    that turns from one to the other would else read it anew."""
    return vocabulary if isinstance(vocabulary, Broadcast) else spark.sparkContext.broadcast(vocabulary)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def encode(docs: DataFrame, vocabulary: Vocabulary | Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids``: the token ids of the whole text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids (an empty value). A column already named ``ids`` is replaced, all others stay.
    """
    shared = share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in _short(batches):
            out = pa.array([encoder(x) for x in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, ids])

    kept = docs.drop(ids)
    return kept.mapInArrow(run, StructType([*kept.schema, StructField(ids, BinaryType())]))


def decode(docs: DataFrame, vocabulary: Vocabulary | Broadcast, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with a binary column ``decoded``: the bytes that the ids stand for; null ids give an empty value."""
    shared = share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value.pieces.__getitem__
        for batch in _short(batches):
            out = [b"".join(map(piece, memoryview(x.as_py() or b"").cast("I"))) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, decoded])

    kept = docs.drop(decoded)
    return kept.mapInArrow(run, StructType([*kept.schema, StructField(decoded, BinaryType())]))
