"""Where texts repeat: windows of a fixed length, grouped by their minimal k-gram, compared across all documents.

Windows of ``width`` units (words or bytes) that follow each other and share the position of their minimal k-gram form
one run, the k-gram being its anchor. Equal windows have equal anchors at equal offsets, so an anchor that occurs once
clears all windows of its run; and runs of equal content are decided as one. Only where an anchor has several contents
(the text branches before or after it) do single windows have to be compared, once for each distinct content.

A text is addressed by ``tid``, a hash of id and text: rows that repeat both are one document, rows that share only the
id are documents of that id. A null id sorts last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.exchange import cut, pack48, ranges_for, unpack48
from seriesloom.llm.text import gram_hash, mixed, prefix_hash, range_hash, slices, window_best, word_hashes

LAST = np.iinfo(np.int64).max
HOT = 1 << 15  # contents of one anchor from which on windows are dealt by their own hash
FINER = 32  # blocks of open questions for each range of anchors
_PLACE = 28  # low bits of a key that hold a position; the rest orders the grams
_FLUSH = 1 << 19


@dataclass(frozen=True)
class Windows:
    """``width`` units a window, anchored by grams of ``gram`` units; units are words or else bytes."""

    width: int
    gram: int
    words: bool
    within: bool  # whether a repeat inside one document counts


def units(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values to be hashed and the first unit of each document."""
    return word_hashes(data, offsets) if words else (data, offsets)


def _runs(prefix: np.ndarray, first: np.ndarray, kind: Windows) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor hash, content hash, sides) of every run; the start counts from the document's
    first unit. ``sides`` has a byte that stands for the anchor with half of a window's other units before it, and one
    for the other half after it: runs that share a window share one of the two."""
    n, width = len(prefix) - 1, kind.width
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), np.zeros((0, 2), np.uint8)
    grams = gram_hash(prefix, kind.gram)
    key = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_best(key, width - kind.gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    size = np.diff(first)
    full = size >= width
    valid = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(valid, first[:-1][full], 1)
    np.add.at(valid, (first[1:] - width + 1)[full], -1)
    valid = np.cumsum(valid[:-1]) > 0
    opens = valid.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    # Documents of exactly ``width`` units follow each other without a gap between their windows only if width is 1.
    start = np.flatnonzero(opens)
    stops = valid.copy()
    stops[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    end = np.flatnonzero(stops)
    doc = np.searchsorted(first, start, "right") - 1
    content = range_hash(prefix, start, end + width)
    at, half = anchor[start], (width - kind.gram + 1) // 2
    before = range_hash(prefix, np.maximum(at - half, 0), at + kind.gram)
    after = range_hash(prefix, at, np.minimum(at + width - half, n))
    sides = np.stack([before, after], 1).astype(np.uint8)
    # The hashes of anchors are minima; mixed anew they spread over all ranges.
    return doc, start - first[doc], end - start + 1, mixed(grams[at]), content, sides


def _anchors(docs: DataFrame, kind: Windows, ranges: int) -> DataFrame:
    """Runs of all texts, packed by the range of their anchor's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            anchor, content, ref, start, count, sides, ids = map(np.concatenate, zip(*held))
            order, keys, bounds = cut(anchor, ranges)
            for r in range(ranges):
                a, b = bounds[r], bounds[r + 1]
                if a < b:
                    mine = order[a:b]
                    used, local = np.unique(ref[mine], return_inverse=True)
                    arrays = ids[used].tobytes(), pack48(keys[a:b]), pack48(content[mine]), local.astype(np.uint16).tobytes(), start[mine].astype(np.uint32).tobytes(), count[mine].astype(np.uint8).tobytes(), sides[mine].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *[pa.array([x], pa.binary()) for x in arrays]], ["part", "ids", "keys", "contents", "refs", "starts", "counts", "sides"])

        docs_held = 0
        for batch in batches:
            ids = np.stack([batch.column(0).fill_null(LAST).to_numpy(), batch.column(1).to_numpy()], 1)
            for lo, hi, data, offsets in slices(batch.column(2)):
                values, first = units(data, offsets, kind.words)
                prefix = prefix_hash(values)
                doc, start, count, anchor, content, sides = _runs(prefix, first, kind)
                if docs_held + hi - lo > 65_535 and held:
                    yield from dealt()
                    held, total, docs_held = [], 0, 0
                held.append((anchor, content, doc + docs_held, start, count, sides, ids[lo:hi]))
                total += len(doc)
                docs_held += hi - lo
                if total >= _FLUSH:
                    yield from dealt()
                    held, total, docs_held = [], 0, 0
        if total:
            yield from dealt()

    return docs.select("doc_id", "tid", "text").mapInArrow(run, "part int, ids binary, keys binary, contents binary, refs binary, starts binary, counts binary, sides binary")


def pack_verdicts(buckets: int, kind: int, tid: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, kind, tids, column, ...) by the text's bucket."""
    bucket = tid % buckets
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        mine = order[a:b]
        yield (int(bucket[mine[0]]), kind, tid[mine].tobytes(), *[c[mine].tobytes() for c in columns])


VERDICTS = "bucket long, kind int, tids binary, starts binary, masks binary, anchors binary"
_VERDICTS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("tids", "starts", "masks", "anchors")]])
REPEATED, ASKED, ASKED_HOT = 0, 1, 2


def verdict_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in _VERDICTS]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _VERDICTS)], schema=_VERDICTS)


def _decide(kind: Windows, ranges: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        keys, contents, ids, starts, counts, sides = [], [], [], [], [], []
        for row in table.drop_columns(["part"]).to_pylist():
            keys.append(unpack48(row["keys"]))
            contents.append(unpack48(row["contents"]))
            ids.append(np.frombuffer(row["ids"], np.int64).reshape(-1, 2)[np.frombuffer(row["refs"], np.uint16)])
            starts.append(np.frombuffer(row["starts"], np.uint32))
            counts.append(np.frombuffer(row["counts"], np.uint8))
            sides.append(np.frombuffer(row["sides"], np.uint8).reshape(-1, 2))
        part = table["part"][0].as_py()
        keys, contents, ids, starts, counts, sides = map(np.concatenate, (keys, contents, ids, starts, counts, sides))
        order = np.argsort(keys)
        ordered = keys[order]
        again = np.zeros(len(order) + 1, bool)
        again[1:-1] = ordered[1:] == ordered[:-1]
        order = order[again[1:] | again[:-1]]  # anchors that occur once are done with
        if not len(order):
            return verdict_table([])
        order = order[np.lexsort((starts[order], ids[order, 1], ids[order, 0], contents[order], keys[order]))]
        keys, contents, doc, tid = keys[order], contents[order], ids[order, 0], ids[order, 1]
        starts, counts = starts[order], counts[order].astype(np.uint64)
        new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
        new_class = new_key | np.concatenate([[True], contents[1:] != contents[:-1]])
        which_key, which_class = np.cumsum(new_key) - 1, np.cumsum(new_class) - 1
        classes = np.bincount(which_key, new_class).astype(np.int64)[which_key]  # distinct contents of the anchor
        at = np.flatnonzero(new_class)
        # A content whose two sides no other content of the anchor has shares no window with one.
        meets = np.zeros(len(at), bool)
        for side in range(2):
            _, which, n = np.unique(which_key[at] << 8 | sides[order][at, side], return_inverse=True, return_counts=True)
            meets |= n[which] > 1
        # As early as the first of its content; with repeats inside a document, that first itself.
        head = doc == doc[at][which_class]
        if kind.within:
            head = (tid == tid[at][which_class]) & (starts == starts[at][which_class])
        if not kind.within:
            low, high = np.minimum.reduceat(doc, np.flatnonzero(new_key)), np.maximum.reduceat(doc, np.flatnonzero(new_key))
            classes[(low == high)[which_key]] = 0  # all in one document
        every = (np.uint64(1) << counts) - np.uint64(1)
        rows = []
        mine = ~head
        rows += pack_verdicts(buckets, REPEATED, tid[mine], starts[mine], every[mine])
        bits = int(ranges).bit_length() - 1
        full = keys << np.uint64(16) >> np.uint64(bits) | np.uint64(part) << np.uint64(64 - bits)  # the range's bits again on top
        for name, mine in ((ASKED, head & meets[which_class] & (classes > 1) & (classes <= HOT)), (ASKED_HOT, head & meets[which_class] & (classes > HOT))):
            rows += pack_verdicts(buckets, name, tid[mine], starts[mine], counts[mine], full[mine])
        return verdict_table([(*r, None)[:6] for r in rows])

    return run


def verdicts_of(table: pa.Table, kinds: tuple[int, ...]) -> list[np.ndarray]:
    """(tid, start, mask or count, anchor) of the rows of these kinds, in one array each."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for row in table.to_pylist():
        if row["kind"] in kinds:
            for held, blob, dtype in zip(parts, (row["tids"], row["starts"], row["masks"], row["anchors"]), (np.int64, np.uint32, np.uint64, np.uint64)):
                if blob is not None:
                    held.append(np.frombuffer(blob, dtype))
    return [np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, (np.int64, np.uint32, np.uint64, np.uint64))]


def find_repeats(docs: DataFrame, kind: Windows, ask: Callable, ask_schema: str, resolve: Callable[[DataFrame, int], DataFrame], finish: Callable, finish_schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Run the whole search over documents (doc_id, text) and return ``finish``'s rows.

    ``ask`` turns texts and the open questions of a bucket, those of usual and those of hot anchors (tid, start, count,
    anchor), into what ``resolve`` compares across documents; its verdicts and those of the anchors meet the texts once
    more in ``finish``. The columns in ``carry`` stay with their rows. Texts are shuffled once by tid and that exchange is used twice; everything is one lazy plan.
    """
    spark = docs.sparkSession
    ranges = ranges_for(docs, "text", 90 if kind.words else 72)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total >> 23))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tid"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    first = _anchors(docs, kind, ranges).groupBy("part").applyInArrow(_decide(kind, ranges, buckets), VERDICTS)
    first = first.repartition(buckets, "bucket")
    texts = docs.withColumn("bucket", F.expr(f"pmod(tid, {buckets})")).repartition(buckets, "bucket")

    def questions(left: pa.Table, right: pa.Table) -> pa.Table:
        return ask(left, verdicts_of(right, (ASKED,)), verdicts_of(right, (ASKED_HOT,)), FINER * ranges)

    asked = texts.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(questions, ask_schema)
    second = resolve(asked, buckets)
    both = first.where(f"kind = {REPEATED}").unionByName(second)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        tid, start, mask, _ = verdicts_of(right, (REPEATED,))
        order = np.argsort(tid, kind="stable")
        out = finish(left, tid[order], start[order], mask[order])
        for name in carry:
            out = out.append_column(name, left[name])
        return out

    finish_schema = ", ".join([finish_schema, *[f"{name} {docs.schema[name].dataType.simpleString()}" for name in carry]])
    return texts.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(last, finish_schema)


def windows_of(start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """First units of the windows that the masks name."""
    left, out, shift = mask.copy(), [], 0
    start = start.astype(np.int64)
    while left.any():
        hit = (left & np.uint64(1)).astype(bool)
        out.append(start[hit] + shift)
        left >>= np.uint64(1)
        keep = left > 0
        left, start = left[keep], start[keep]
        shift += 1
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def matched(ids: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ids, position in the sorted ``tid``) of all equal pairs."""
    a, b = np.searchsorted(tid, ids, "left"), np.searchsorted(tid, ids, "right")
    n = b - a
    return np.repeat(np.arange(len(ids)), n), np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


def covered(n: int, windows: np.ndarray, width: int) -> np.ndarray:
    """Which of n units lie in one of the windows."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + width, -1)
    return np.cumsum(edge[:-1]) > 0
