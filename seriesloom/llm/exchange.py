"""Exchange of 64-bit keys in packed form: one row per task slice and key range instead of one row per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.text import mixed

PER_RANGE = 1 << 20  # keys that one task sorts at once


def ranges_for(docs: DataFrame, text: str, bytes_per_key: float) -> int:
    """A power of two: into how many ranges the keys of all texts are dealt. It follows the input, without a bound."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    need = total / bytes_per_key / PER_RANGE
    return max(8, 1 << int(np.ceil(np.log2(max(1.0, need)))))


def pack48(x: np.ndarray) -> bytes:
    """The upper 48 bits of each value."""
    return np.ascontiguousarray((x >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    """The packed values, as the lower 48 bits."""
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def cut(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, keys in order without their range bits, bounds of the ranges): range r holds order[bounds[r]:bounds[r + 1]]."""
    bits = int(ranges).bit_length() - 1
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - bits)
    return order, keys << np.uint64(bits), np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


BLOOM_BITS = 26


def _places(ids: np.ndarray) -> np.ndarray:
    h = mixed(ids.astype(np.int64).view(np.uint64))
    return np.stack([h, mixed(h)]) & np.uint64((1 << BLOOM_BITS) - 1)


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size (8 MB) over the keys: it may let strangers through but misses none.

    Tasks set bits in a map of their own, the maps are combined by word, and the driver gets at most 2^20 words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
        for batch in batches:
            at = _places(batch.column(0).to_numpy()).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        w = np.flatnonzero(bits)
        yield pa.RecordBatch.from_pydict({"w": w.astype(np.int32), "m": bits[w].view(np.int64)})

    words = keys.select(column).mapInArrow(run, "w int, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    out[words["w"].to_numpy("int64")] = words["m"].to_numpy("int64").view(np.uint64)
    return out


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(0)
