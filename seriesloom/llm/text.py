"""Vectorised views of Arrow text batches: words, byte grams, rolling hashes and window minima.

A batch is handled in slices of about ``SLICE`` bytes (one longer document is one slice), so the scratch arrays
stay small whatever the batch holds. Words are runs of bytes other than the ASCII white space 0x20 and 0x09-0x0D;
null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of consecutive rows of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spaces(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (one entry more at the end).
    ``inside`` says which bytes belong to words, if not all but white space do."""
    inside = ~spaces(data) if inside is None else inside
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    firsts, lasts = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    opens[firsts] = inside[firsts]
    closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.reach(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each pair, the length included."""
    _, down = _POWERS.reach(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values."""
    _, down = _POWERS.reach(len(prefix))
    n = max(0, len(prefix) - k)
    return mixed((prefix[k : k + n] - prefix[:n]) * down[:n])


def window_best(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every run of ``width`` values."""
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = best(x[: len(x) - (width - size)], x[width - size :])
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the index of each document's first word."""
    starts, ends, first = words(data, offsets)
    return range_hash(prefix_hash(LOWER[data] if lower else data), starts, ends), first
