"""Substring dedup over words by De Bruijn compaction."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.exchange import cut, pack48, unpack48
from seriesloom.llm.repeats import (
    LAST, REPEATED, VERDICTS, Windows, covered, find_repeats, matched, pack_verdicts, units, verdict_table, windows_of,
)
from seriesloom.llm.text import gram_hash, prefix_hash, slices, words

GRAM = 8
_EDGES = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def cut_repeated_words(docs: DataFrame, width: int = 20, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of ``docs`` (doc_id, text) without the words that a repeated
    window of ``width`` words covers; ``kept`` is null unless ``with_text``.
    Columns named in ``carry`` stay.

    Token k-mers (k = ``width`` words) are the edges of a De Bruijn graph over all texts. Edges that follow each other
    and share their minimal gram are a path piece; where the gram has but one surrounding content everywhere, no node
    of the piece branches, and the whole piece is one compacted edge: its copies meet in one join by gram and content,
    and all but the earliest source coordinate are repeats. Pieces around a branch come apart into their edges, one set
    per distinct content, which meet in a second join by their own hash. The coordinates (id, start) then mark, text by
    text, the windows that also start earlier; windows are judged on the input, not on what is left.

    Null and empty texts have no words. Texts shorter than ``width`` words stay whole. A repeat inside a document counts.
    Rows that repeat id and text are one document; a null id sorts last. Words are runs of anything but ASCII white
    space, unchanged; kept words are joined by one space. Other columns are not read. Hot passages are no group: their
    copies are combined by content in each range, and what branches is compared edge by edge.
    """

    def ask(texts: pa.Table, usual: list[np.ndarray], hot: list[np.ndarray], ranges: int) -> pa.Table:
        tid, start, count, _ = (np.concatenate(x) for x in zip(usual, hot))
        order = np.argsort(tid, kind="stable")
        tid, start, count = tid[order], start[order].astype(np.int64), count[order].astype(np.int64)
        ids, doc = texts["tid"].to_numpy(), texts["doc_id"].fill_null(LAST).to_numpy()
        held = []
        for lo, hi, data, offsets in slices(texts["text"]):
            row, at = matched(ids[lo:hi], tid)
            if len(row):
                values, first = units(data, offsets, True)
                n = count[at]
                place = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                row = np.repeat(row, n)
                held.append((gram_hash(prefix_hash(values), width)[first[row] + place], doc[lo + row], ids[lo + row], place))
        if not held:
            return _EDGES.empty_table()
        edge, doc, text, place = map(np.concatenate, zip(*held))
        order, keys, bounds = cut(edge, ranges)
        rows = []
        for r in range(ranges):
            a, b = bounds[r], bounds[r + 1]
            if a < b:
                mine = order[a:b]
                rows.append((r, pack48(keys[a:b]), np.stack([doc[mine], text[mine]], 1).tobytes(), place[mine].astype(np.uint32).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDGES)], schema=_EDGES)

    def resolve(asked: DataFrame, buckets: int) -> DataFrame:
        def earliest(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            keys = np.concatenate([unpack48(r["keys"]) for r in rows])
            ids = np.concatenate([np.frombuffer(r["ids"], np.int64).reshape(-1, 2) for r in rows])
            place = np.concatenate([np.frombuffer(r["starts"], np.uint32) for r in rows])
            order = np.lexsort((place, ids[:, 1], ids[:, 0], keys))
            keys, ids, place = keys[order], ids[order], place[order]
            later = np.zeros(len(keys), bool)
            later[1:] = keys[1:] == keys[:-1]
            # Rows that repeat id and text ask twice for the same window.
            same = np.zeros(len(keys), bool)
            same[1:] = later[1:] & (ids[1:] == ids[:-1]).all(1) & (place[1:] == place[:-1])
            first = np.maximum.accumulate(np.where(later, 0, np.arange(len(keys))))
            later &= ~(same & (ids == ids[first]).all(1) & (place == place[first]))
            mask = np.ones(later.sum(), np.uint64)
            return verdict_table([(*r, None) for r in pack_verdicts(buckets, REPEATED, ids[later, 1], place[later], mask)])

        return asked.groupBy("part").applyInArrow(earliest, VERDICTS)

    def finish(texts: pa.Table, tid: np.ndarray, start: np.ndarray, mask: np.ndarray) -> pa.Table:
        ids = texts["tid"].to_numpy()
        n_words, n_removed, digest, kept = [], [], [], []
        for lo, hi, data, offsets in slices(texts["text"]):
            starts, ends, first = words(data, offsets)
            row, at = matched(ids[lo:hi], tid)
            begin = first[row] + start[at].astype(np.int64)
            gone = covered(len(starts), windows_of(begin, mask[at]), width)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            stay = np.flatnonzero(~gone)
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, starts[stay], 1)
            np.add.at(edge, ends[stay], -1)
            keep = np.cumsum(edge[:-1]) > 0
            out = data.copy()
            joint = ends[stay[:-1]][doc[stay[1:]] == doc[stay[:-1]]]  # the byte after a kept word becomes the space
            keep[joint], out[joint] = True, 32
            out, size = out[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[offsets]
            for a, b in zip(size[:-1], size[1:]):
                digest.append(hashlib.sha256(out[a:b]).hexdigest())
                kept.append(out[a:b].decode("utf-8", "replace") if with_text else None)
            n_words += np.diff(first).tolist()
            n_removed += np.bincount(doc[gone], minlength=hi - lo).tolist()
        return pa.table([texts["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], schema=_KEPT)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return find_repeats(docs, Windows(width, GRAM, True, True), ask, "part int, keys binary, ids binary, starts binary", resolve, finish, schema, carry)
