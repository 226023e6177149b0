"""Substring dedup over bytes: bounded common prefixes from a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.exchange import cut
from seriesloom.llm.repeats import LAST, REPEATED, VERDICTS, Windows, covered, find_repeats, matched, pack_verdicts, verdict_table, windows_of
from seriesloom.llm.text import gram_hash, prefix_hash, slices

GRAM = 16
_PIECES = pa.schema([("part", pa.int32()), *[(n, pa.binary()) for n in ("bytes", "lengths", "ids", "starts")]])
_KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
])


def suffix_order(data: np.ndarray, left: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Suffixes of many pieces in order, by prefix doubling; a piece's end is lower than any byte, ends go by piece.

    Bytes are the values 1 to 256, 0 is the end mark. ``left`` counts the values from each position to the end of its
    piece, the end mark included.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(7, data.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(7):  # values of 9 bits
        key = key << np.uint64(9) | np.where(left > i, padded[i : i + n], 0).astype(np.uint64)
    length = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        if length >= left.max(initial=0):
            return order[np.argsort(rank[order].astype(np.uint64) << np.uint64(32) | piece[order].astype(np.uint64), kind="stable")]
        after = np.zeros(n, np.int64)
        more = np.flatnonzero(left > length)
        after[more] = rank[more + length]
        key = rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        length *= 2


def boundaries(data: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix has fewer than ``least`` bytes in common with the one before it in order.

    Intervals of the transform expand breadth first: a boundary between suffixes with a common prefix of length l is
    carried backwards over each byte c that precedes suffixes on both of its sides, and bounds there two suffixes with
    l + 1 bytes in common, unless they are known to have fewer. So common prefixes are found by increasing value, and
    the expansion stops before ``least``: what is left without a boundary is as long or longer.
    """
    n = len(data)
    before = np.where(order > 0, data[order - 1], 0)  # the transform; 0 where a piece begins
    head = data[order]
    known = np.ones(n, bool)
    known[1:] = (head[1:] != head[:-1]) | (head[1:] == 0)
    by_byte = np.argsort(before, kind="stable")
    by_byte = by_byte[before[by_byte] > 0]
    # Suffixes that begin with a byte follow each other as the suffixes after it do: the j-th of those preceded by c
    # leads to the j-th that begins with c.
    target = np.flatnonzero(head > 0)
    if len(by_byte) != len(target):
        raise ValueError("pieces must not hold the end mark")
    same = np.zeros(len(by_byte), bool)
    same[1:] = before[by_byte[1:]] == before[by_byte[:-1]]
    last, here, target = by_byte[:-1][same[1:]], by_byte[1:][same[1:]], target[1:][same[1:]]
    new = known.copy()
    for _ in range(1, least):
        open_ = ~known[target]
        last, here, target = last[open_], here[open_], target[open_]
        if not len(target):
            break
        total = np.concatenate([[0], np.cumsum(new)])
        hit = total[here + 1] > total[last + 1]  # a new boundary after ``last`` up to ``here``
        new = np.zeros(n, bool)
        new[target[hit]] = True
        known |= new
        if not hit.any():
            break
    return known


def repeated_masks(pieces: np.ndarray, lengths: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Of each piece, a mask of its windows of ``width`` bytes that are also in a piece of a smaller document."""
    ends = np.cumsum(lengths + 1)
    data = np.zeros(int(ends[-1]), np.uint16)
    at = np.repeat(ends - lengths - 1 - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    data[at] = pieces
    data[at] += 1  # bytes are 1 to 256, so that 0 is free for the end mark
    piece = np.repeat(np.arange(len(lengths)), lengths + 1)
    place = np.arange(len(data))
    left = ends[piece] - place
    order = suffix_order(data, left, piece)
    edges = np.flatnonzero(boundaries(data, order, width))
    owner = doc[piece[order]]
    full = left[order] > width  # a whole window before the end mark
    least = np.minimum.reduceat(np.where(full, owner, LAST), edges)
    least = np.repeat(least, np.diff(np.append(edges, len(order))))
    gone = order[full & (owner > least)]
    masks = np.zeros(len(lengths), np.uint64)
    offset = gone - (ends - lengths - 1)[piece[gone]]
    np.bitwise_or.at(masks, piece[gone], np.uint64(1) << offset.astype(np.uint64))
    return masks


def cut_repeated_bytes(docs: DataFrame, width: int = 50, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of ``docs`` (doc_id, text) without the bytes that a string
    of ``width`` bytes covers which also starts in a document of smaller id; ``kept`` is null unless ``with_text``.
    Columns named in ``carry`` stay.

    Texts are UTF-8 bytes; matches never cross documents and are judged on the input. Runs of windows with a common
    anchor meet by anchor; copies of equal content are combined first, so a passage in very many documents is one
    piece. The distinct contents of an anchor meet in one block of pieces, whose Burrows-Wheeler transform gives by
    interval expansion which windows have ``width`` bytes in common; the smallest id of each keeps its own. An anchor
    with very many contents is dealt by single windows instead, so that no block grows with it.

    Null and empty texts have no bytes, texts shorter than ``width`` stay whole. Repeats within a document and between
    rows of one id don't count; a null id sorts last. The byte 0 is a byte like any other. Other columns are not read.
    """

    def ask(texts: pa.Table, usual: list[np.ndarray], hot: list[np.ndarray], ranges: int) -> pa.Table:
        tid, start, count, anchor = (np.concatenate(x) for x in zip(usual, hot))
        single = np.repeat([False, True], [len(usual[0]), len(hot[0])])
        order = np.argsort(tid, kind="stable")
        tid, start, count, anchor, single = tid[order], start[order].astype(np.int64), count[order].astype(np.int64), anchor[order], single[order]
        ids, doc = texts["tid"].to_numpy(), texts["doc_id"].fill_null(LAST).to_numpy()
        held: dict[str, list] = {n: [] for n in ("key", "bytes", "lengths", "ids", "starts")}
        for lo, hi, data, offsets in slices(texts["text"]):
            row, at = matched(ids[lo:hi], tid)
            if not len(row):
                continue
            begin, n, key, alone = offsets[row] + start[at], count[at], anchor[at], single[at]
            if alone.any():  # one piece for each window
                m = np.where(alone, n, 1)
                shift = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                row, begin, n, key, alone = np.repeat(row, m), np.repeat(begin, m) + shift, np.where(np.repeat(alone, m), 1, np.repeat(n, m)), np.repeat(key, m), np.repeat(alone, m)
                key = np.where(alone, gram_hash(prefix_hash(data), width)[np.minimum(begin, max(0, len(data) - width))], key)
            length = n + width - 1
            where = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
            for name, x in (("key", key), ("bytes", data[where]), ("lengths", length), ("ids", np.stack([doc[lo + row], ids[lo + row]], 1)), ("starts", begin - offsets[row])):
                held[name].append(x)
        if not held["key"]:
            return _PIECES.empty_table()
        key, data, length, ids, start = (np.concatenate(held[n]) for n in ("key", "bytes", "lengths", "ids", "starts"))
        order, _, bounds = cut(key, ranges)
        begin = np.cumsum(length) - length
        rows = []
        for r in range(ranges):
            mine = order[bounds[r] : bounds[r + 1]]
            if len(mine):
                size = length[mine]
                where = np.repeat(begin[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
                rows.append((r, data[where].tobytes(), size.astype(np.uint8).tobytes(), ids[mine].tobytes(), start[mine].astype(np.uint32).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    def resolve(asked: DataFrame, buckets: int) -> DataFrame:
        def block(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            data = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows])
            length = np.concatenate([np.frombuffer(r["lengths"], np.uint8) for r in rows]).astype(np.int64)
            ids = np.concatenate([np.frombuffer(r["ids"], np.int64).reshape(-1, 2) for r in rows])
            start = np.concatenate([np.frombuffer(r["starts"], np.uint32) for r in rows])
            masks = repeated_masks(data, length, ids[:, 0], width)
            hit = masks > 0
            return verdict_table([(*r, None) for r in pack_verdicts(buckets, REPEATED, ids[hit, 1], start[hit], masks[hit])])

        return asked.groupBy("part").applyInArrow(block, VERDICTS)

    def finish(texts: pa.Table, tid: np.ndarray, start: np.ndarray, mask: np.ndarray) -> pa.Table:
        ids = texts["tid"].to_numpy()
        n_bytes, n_removed, n_spans, digest, kept = [], [], [], [], []
        for lo, hi, data, offsets in slices(texts["text"]):
            row, at = matched(ids[lo:hi], tid)
            gone = covered(len(data), windows_of(offsets[row] + start[at].astype(np.int64), mask[at]), width)
            total = np.concatenate([[0], np.cumsum(gone)])[offsets]
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = offsets[1:-1][(offsets[1:-1] < len(data)) & (offsets[1:-1] > 0)]
            opens[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(opens)])[offsets]
            out, size = data[~gone].tobytes(), offsets - total
            for a, b in zip(size[:-1], size[1:]):
                digest.append(hashlib.sha256(out[a:b]).hexdigest())
                kept.append(out[a:b] if with_text else None)
            n_bytes += np.diff(offsets).tolist()
            n_removed += np.diff(total).tolist()
            n_spans += np.diff(spans).tolist()
        columns = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
        return pa.table([texts["doc_id"], *columns, pa.array(digest, pa.string()), pa.array(kept, pa.binary())], schema=_KEPT)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return find_repeats(docs, Windows(width, GRAM, False, False), ask, "part int, bytes binary, lengths binary, ids binary, starts binary", resolve, finish, schema, carry)
