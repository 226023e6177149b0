"""Collocations from weighted acyclic automata: shards' n-grams as count transducers, united by prefix range.

A shard (some MB of text) sorts its n-grams and builds from them, path by path, an automaton whose transitions are words
(the first one a language) and whose ends carry counts. Automata travel packed, one for each range of prefixes; those
of a range are united level by level and their weights summed. A round adds one word: its n-grams are only those whose
first and last n - 1 words stood often enough, by a filter of fixed size that lets strangers through but misses none.
Candidates are composed with the united counts, as joins, to look their parts up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.exchange import bloom, passes, ranges_for
from seriesloom.llm.store import stored
from seriesloom.llm.text import LOWER, mixed, prefix_hash, range_hash, slices, words

SHARD = 1 << 20  # bytes of text whose n-grams make one automaton
FEW_RANGES = 64  # with more ranges shards grow in step, as each shard gives each range a row
LARGEST = 4  # times SHARD
LOTS = 16  # over so many ranges a prefix is dealt by its last word, so that a common one isn't a single range's
NO_LANGUAGE = "und"
_STEP = np.uint64(0xD1342543DE82EF95)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_INSIDE = ~_BREAK
_INSIDE[[32, 9]] = False
_STATE = "lang string, phrase string, f long, h long"


def _hashes(symbols: pa.Array) -> np.ndarray:
    _, offsets, data = symbols.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[: len(symbols) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return range_hash(prefix_hash(bytes_), at[:-1], at[1:])


def _follow(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of the path one transition further."""
    return mixed(state * _STEP + symbol)


def _dump(arrays: list[np.ndarray]) -> bytes:
    out = []
    for a in arrays:
        size = next(s for s in (1, 2, 4, 8) if s == 8 or a.max(initial=0) < 1 << (8 * s))
        out += [np.array([size, len(a)], "<i8").tobytes(), a.astype(f"<u{size}").tobytes()]
    return b"".join(out)


def _load(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        size, n = np.frombuffer(blob, "<i8", 2, at)
        out.append(np.frombuffer(blob, f"<u{size}", n, at + 16).astype(np.int64))
        at += 16 + int(size * n)
    return out


def build(paths: list[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
    """The automaton of sorted paths, given as one array of symbols for each depth: how many transitions leave each
    state, root first and depth by depth, the symbols of these transitions, and the weights of the last states."""
    new = np.zeros(len(weights), bool)
    new[:1] = True
    kids, labels, parents = [], [], np.zeros(1, np.int64)
    for symbol in paths:
        new = new.copy()
        new[1:] |= symbol[1:] != symbol[:-1]
        kids.append(np.add.reduceat(new.astype(np.int64), parents))
        parents = np.flatnonzero(new)
        labels.append(symbol[parents])
    return [np.concatenate(kids), np.concatenate(labels), weights]


def unite(automata: list[tuple[pa.Array, list[np.ndarray]]], depth: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
    """(symbols, their hashes, symbol of every path at each depth, summed weights) of the union of some automata, each
    given with its own symbols."""
    every = pa.concat_arrays([symbols for symbols, _ in automata])
    hashed, first, same = np.unique(_hashes(every), return_index=True, return_inverse=True)
    sizes = np.array([len(symbols) for symbols, _ in automata])
    base = np.concatenate([[0], np.cumsum(sizes)])
    state = [np.zeros(1, np.int64) for _ in automata]
    at = np.zeros((len(automata), 2), np.int64)  # how far kids and labels of each have been read
    parents, symbols = [], []
    for _ in range(depth):
        keys = []
        for a, (_, (kids, labels, _)) in enumerate(automata):
            count = kids[at[a, 0] : at[a, 0] + len(state[a])]
            label = labels[at[a, 1] : at[a, 1] + count.sum()]
            at[a] += len(state[a]), len(label)
            keys.append(np.repeat(state[a], count) * len(hashed) + same[base[a] + label])
        united, where = np.unique(np.concatenate(keys), return_inverse=True)
        state = np.split(where, np.cumsum([len(k) for k in keys])[:-1])
        parents.append(united // len(hashed))
        symbols.append(united % len(hashed))
    weights = np.zeros(len(symbols[-1]), np.int64)
    np.add.at(weights, where, np.concatenate([w for _, (_, _, w) in automata]))
    node, paths = np.arange(len(weights)), []
    for d in reversed(range(depth)):
        paths.append(symbols[d][node])
        node = parents[d][node]
    return every.take(pa.array(first)), hashed, paths[::-1], weights


def shard_bytes(ranges: int) -> int:
    """Bytes of text of a shard: the rows of all shards and ranges stay in proportion to the input up to 4 times SHARD."""
    return SHARD * min(LARGEST, max(1, ranges // FEW_RANGES))


def _shards(n: int, ranges: int, often: np.ndarray | None):
    """One row for each shard and range: the automaton of its n-grams of ``n`` words."""
    size = shard_bytes(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).fill_null(NO_LANGUAGE).dictionary_encode()
            names = _hashes(lang.dictionary)
            for lo, hi, data, offsets in slices(batch.column(0), size):
                low = LOWER[data]
                starts, ends, first = words(low, offsets, _INSIDE[low])
                if len(starts) < n:
                    continue
                word = range_hash(prefix_hash(low), starts, ends)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                piece = np.cumsum(_BREAK[low])[starts] + doc
                code = lang.indices.to_numpy()[lo:hi][doc]
                before = mixed(names)[code]
                for d in range(n - 1):
                    before = _follow(before[: len(word) - d], word[d:])
                last = len(word) - n + 1
                valid = piece[:last] == piece[n - 1 :]
                if often is not None:
                    known = passes(often, before.view(np.int64))
                    valid &= known[:last] & known[1:]
                    del known
                at = np.flatnonzero(valid)
                del doc, piece, valid
                whole = _follow(before[at], word[at + n - 1])
                _, some, weights = np.unique(whole, return_index=True, return_counts=True)
                at = at[some]
                tail = word[at + n - 1]
                lead = whole[some] if n == 1 else mixed(before[at] + (tail >> np.uint64(60)) % np.uint64(LOTS) * _STEP)
                part = (lead >> np.uint64(33)).astype(np.int64) % ranges
                path = [code[at], *(word[at + d] for d in range(n))]
                order = np.lexsort([*path[::-1], part])
                part, at, weights, path = part[order], at[order], weights[order], [p[order] for p in path]
                del before, whole, some, tail, lead, order
                edges = np.flatnonzero(np.diff(part, prepend=-1))
                rows = []
                low_bytes = pa.py_buffer(low)
                for a, b in zip(edges, np.append(edges[1:], len(part))):
                    spots = np.concatenate([at[a:b] + d for d in range(n)])
                    hashed, one, label = np.unique(word[spots], return_index=True, return_inverse=True)
                    here, tongue = np.unique(path[0][a:b], return_inverse=True)
                    label = label.reshape(n, b - a) + len(here)
                    spots = spots[one]
                    symbols = pa.concat_arrays([lang.dictionary.take(pa.array(here)).cast(pa.binary()), _cut(low_bytes, starts[spots], ends[spots])])
                    rows.append((int(part[a]), _dump([np.diff(_offsets(symbols)), *build([tongue, *label], weights[a:b])]), _joined(symbols)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    ["part", "automaton", "symbols"],
                )

    return run


def _cut(buffer: pa.Buffer, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given stretches of a buffer as binary values."""
    length = ends - starts
    at = np.concatenate([[0], np.cumsum(length)])
    from_ = np.repeat(starts - at[:-1], length) + np.arange(at[-1])
    data = np.frombuffer(buffer, np.uint8)[from_]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _offsets(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1].astype(np.int64)


def _joined(values: pa.Array) -> bytes:
    return values.buffers()[2].to_pybytes()[: _offsets(values)[-1]]


def _united(n: int, least: int):
    """Of a range's automata: the phrases that stand at least ``least`` times, and each language's sum of all."""

    def run(group: pa.Table) -> pa.Table:
        automata = []
        for blob, joined in zip(group["automaton"], group["symbols"]):
            lengths, *rest = _load(blob.as_buffer())
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            automata.append((pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, joined.as_buffer()]), rest))
        symbols, hashed, paths, weights = unite(automata, n + 1)
        state = mixed(hashed[paths[0]])
        for p in paths[1:]:
            state = _follow(state, hashed[p])
        keep = np.flatnonzero(weights >= least)
        text = symbols.cast(pa.string())
        parts = [text.take(pa.array(p[keep])) for p in paths[1:]]
        phrase = pc.binary_join_element_wise(*parts, " ")
        out = [text.take(pa.array(paths[0][keep])), phrase, pa.array(weights[keep]), pa.array(state[keep].view(np.int64))]
        if n == 1:
            tongues, which = np.unique(paths[0], return_inverse=True)
            total = np.zeros(len(tongues), np.int64)
            np.add.at(total, which, weights)
            none = [text.take(pa.array(tongues)), pa.nulls(len(tongues), pa.string()), pa.array(total), pa.nulls(len(tongues), pa.int64())]
            out = [pa.concat_arrays([a.cast(b.type), b]) for a, b in zip(out, none)]
        return pa.table(out, ["lang", "phrase", "f", "h"])

    return run


def counts(docs: DataFrame, text: str, lang: str, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """([states of 1, 2, ... words: lang, phrase, f, h], (lang, n)): all phrases that stand at least ``least`` times."""
    rows = docs.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    ranges = ranges_for(rows, "_text", 8)
    levels, often, total = [], None, None
    for n in range(1, longest + 1):
        shards = rows.mapInArrow(_shards(n, ranges, often), "part int, automaton binary, symbols binary")
        states = stored(shards.groupBy("part").applyInArrow(_united(n, least), _STATE), f"phrases-{n}")
        if n == 1:
            total = states.where("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
            states = states.where("phrase IS NOT NULL")
        levels.append(states)
        if n < longest:
            often = bloom(states, "h")
    return levels, total


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, share: int = 80, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and these into words at spaces and
    tabs. a, l and r count all contiguous places of the phrase, its first part and the rest within pieces of the
    language, overlapping ones too; n counts the language's words. Of the cuts of a phrase the one of least
    floor(2000000 a / (l + r)) counts, ties to the shortest first part. Candidates stand at least ``least`` times; one that lies
    in a longer candidate with at least ``share`` percent of its places goes. Order: score and a from high to low,
    then phrase by UTF-8 bytes.

    Null texts are empty, a null language is ``und``; repeated rows count each time; an empty table gives no rows; other
    columns are not read. Words of a shard are told apart by 64-bit hashes. The filter between rounds has a fixed size:
    with very many frequent phrases it rules out less, and rounds carry more n-grams, but the result is the same.
    """
    levels, total = counts(docs, text, lang, longest, least)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every = every.select("lang", "phrase", "f")
    candidates = every.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    join = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = cuts.select("lang", "phrase", "f", "k", join(F.lit(1), F.col("k")).alias("_first"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("_rest"))
    firsts = every.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
    rests = every.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    cuts = cuts.join(firsts, ["lang", "_first"]).join(rests, ["lang", "_rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    exact = "(cast(f as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    cuts = cuts.withColumn("score", F.expr(exact))
    best = cuts.groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = candidates.where(F.size("w") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    inner = inner.groupBy("lang", join(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(wide("longer") * 100 < wide("f") * share, F.lit(True)))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("f"), "phrase"))
    ranked = kept.withColumn("rank", order).where(F.col("rank") <= top).join(total, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
