"""Components of documents whose word shingles overlap: an exact Jaccard join by token prefixes and combinations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.exchange import bloom, cut, pack48, passes, ranges_for, unpack48
from seriesloom.llm.store import components, stored
from seriesloom.llm.text import gram_hash, prefix_hash, range_hash, slices, word_hashes

_NO_ID = np.iinfo(np.int64).max  # stands for a null id in the filter of wanted documents
RARE = 32  # a token of more sets is of the frequent class
_FLUSH = 1 << 20  # tokens a task gathers before it deals them out
SMALL = 160  # sets of at least so many tokens are indexed by their sample only
_SAMPLE = np.uint64(3)  # of 8 classes of tokens
_CLASS = 32  # lowest of the three bits of a token that tell its class


def _sampled(tokens: np.ndarray, shift: int = _CLASS) -> np.ndarray:
    return (tokens >> np.uint64(shift) & np.uint64(7)) < _SAMPLE


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct token hashes, hash of the set) of each text that has words."""
    for lo, hi, data, offsets in slices(column):
        hashes, first = word_hashes(data, offsets, lower=True)
        prefix = prefix_hash(hashes)
        grams = gram_hash(prefix, width)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                tokens = np.unique(grams[a : b - width + 1])
            elif b > a:
                tokens = range_hash(prefix, np.array([a]), np.array([b]))
            else:
                continue
            whole = range_hash(prefix_hash(tokens), np.array([0]), np.array([len(tokens)]))[0]
            yield lo + i, tokens, int(whole.astype(np.int64))


def _facts(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n, k, set_id) of every document: ``text_key`` is a hash of the text, ``k`` the size of the
    sample of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, part, ids = [0] * batch.num_rows, [0] * batch.num_rows, [None] * batch.num_rows
            for i, tokens, whole in _sets(batch.column(2), width):
                size[i], part[i], ids[i] = len(tokens), int(_sampled(tokens).sum()), whole
            made = [pa.array(x, pa.int64()) for x in (size, part, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "text_key", "n", "k", "set_id"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return docs.mapInArrow(run, "doc_id long, text_key long, n long, k long, set_id long")


def _index(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """The tokens of small sets and the samples of the others, packed by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "sets", "keys", "refs"]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def dealt(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            refs = np.repeat(np.arange(len(held), dtype=np.uint16), [len(t) for _, t in held])
            order, keys, bounds = cut(np.concatenate([t for _, t in held]), ranges)
            refs = refs[order]
            ids = np.array([s for s, _ in held], np.int64)
            for r in range(ranges):
                a, b = bounds[r], bounds[r + 1]
                if a < b:
                    used, local = np.unique(refs[a:b], return_inverse=True)
                    row = r, ids[used].tobytes(), pack48(keys[a:b]), local.astype(np.uint16).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        held, total, seen = [], 0, set()
        for batch in batches:
            for _, tokens, whole in _sets(batch.column(0), width):
                if whole not in seen:  # copies within a slice are one set
                    seen.add(whole)
                    held.append((whole, tokens if len(tokens) < SMALL else tokens[_sampled(tokens)]))
                    total += len(held[-1][1])
                if total >= _FLUSH or len(held) == 65_535:
                    yield from dealt(held)
                    held, total, seen = [], 0, set()
        if held:
            yield from dealt(held)

    return docs.select("text").mapInArrow(run, "part int, sets binary, keys binary, refs binary")


_PAIR = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("c", pa.int32()), ("kind", pa.int32())])


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sets, start, length and token of each posting list of two sets or more, set numbers of the lists) of one hash
    range."""
    keys, refs, ids = [], [], []
    for s, k, r in zip(table["sets"].to_pylist(), table["keys"].to_pylist(), table["refs"].to_pylist()):
        keys.append(unpack48(k))
        ids.append(np.frombuffer(s, np.int64)[np.frombuffer(r, np.uint16)])
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    shared = same[1:] | same[:-1]
    keys, ids = keys[shared], ids[shared]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[fresh], ids[fresh]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(keys)))
    sets, number = np.unique(ids, return_inverse=True)
    return sets, start[length > 1], length[length > 1], keys[start[length > 1]], number


def _counted(sets: np.ndarray, x: list[np.ndarray], y: list[np.ndarray], kind: int) -> pa.Table:
    if not x:
        return _PAIR.empty_table()
    pair, c = np.unique(np.concatenate(x).astype(np.uint64) << np.uint64(32) | np.concatenate(y).astype(np.uint64), return_counts=True)
    a, b = sets[(pair >> np.uint64(32)).astype(np.int64)], sets[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return pa.table({"x": a, "y": b, "c": c.astype(np.int32), "kind": np.full(len(a), kind, np.int32)}, schema=_PAIR)


def _pairs(rare: int, ranges: int) -> Callable[[pa.Table], pa.Table]:
    """Single tokens of the rare class give all pairs of their short lists (kind 0). A frequent token gives each of its
    sets a pair with the list's first set (kind 1), which is also how often a set has frequent tokens in its sample
    (kind 2) and besides (kind 3)."""
    shift = _CLASS - 16 + int(ranges).bit_length() - 1  # where the class is in a key without its range bits

    def run(table: pa.Table) -> pa.Table:
        sets, start, length, token, number = _lists(table)
        x, y = [], []
        for size in range(2, rare + 1):
            at = start[length == size]
            if len(at):
                member = number[at[:, None] + np.arange(size)]
                i, j = np.triu_indices(size, 1)
                x.append(member[:, i].ravel())
                y.append(member[:, j].ravel())
        out = [_counted(sets, x, y, 0)]
        long_ = length > rare
        at, size = start[long_], length[long_]
        if len(at):
            where = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
            member, leader = number[where], np.repeat(number[at], size)
            inside = np.repeat(_sampled(token[long_], shift), size)
            out += [_counted(sets, [m], [m], kind) for m, kind in ((member[inside], 2), (member[~inside], 3))]
            out.append(_counted(sets, [leader[leader != member]], [member[leader != member]], 1))
        return pa.concat_tables(out)

    return run


def _tokens_of(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(set_id, tokens) of the wanted sets (set_id, doc_id), one row each. A filter of fixed size over the wanted
    documents keeps nearly all others' tokens within the scan. Rows without an id pass it together; what a set's
    tokens are doesn't depend on the row that gives them."""
    addressed = lambda rows: F.coalesce(rows["doc_id"].cast("long"), F.lit(int(_NO_ID))).alias("doc_id")
    bits = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(addressed(wanted)), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            hit = np.flatnonzero(passes(bits.value, ids))
            for at in range(0, len(hit), 1000):
                rows = hit[at : at + 1000]
                found = {whole: t for _, t, whole in _sets(batch.column(1).take(pa.array(rows)), width)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([pack48(t) for t in found.values()], pa.binary())], ["set_id", "tokens"])

    found = docs.select(addressed(docs), "text").mapInArrow(run, "set_id long, tokens binary")
    return found.join(wanted.select("set_id"), "set_id").dropDuplicates(["set_id"])


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that link, by the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = unpack48(a.as_py()), unpack48(b.as_py())
                common = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(ok, pa.bool_())), batch.column("y").filter(pa.array(ok, pa.bool_()))], ["x", "y"])

    both = pairs.select("x", "y").join(tokens.select(F.col("set_id").alias("x"), F.col("tokens").alias("a")), "x")
    both = both.join(tokens.select(F.col("set_id").alias("y"), F.col("tokens").alias("b")), "y")
    return both.mapInArrow(run, "x long, y long")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    x, y = roots.select(F.col("node").alias("x"), F.col("root").alias("rx")), roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
    return pairs.join(x, "x", "left").join(y, "y", "left").where(F.coalesce("rx", "x") != F.coalesce("ry", "y")).drop("rx", "ry")


def link_components(docs: DataFrame, width: int = 5, percent: int = 80, rare: int = RARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (columns doc_id and text).

    See ``_linked`` for the method.
    """
    return _linked(docs, width, percent, rare).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, rare: int = RARE) -> DataFrame:
    """(doc_id, text_key): of every component the text of smallest id, ``text_key`` being ``xxhash64(text)``.

    Texts that share an id, or have none, are told apart by their key; of several with the smallest id of a component
    that of the smallest key stays. Texts without words are linked with nothing, so all of them stay.
    """
    found = _linked(docs, width, percent, rare)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    linked = found.where("root IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.text_key")
    return linked.unionByName(found.where("root IS NULL").select("doc_id", "text_key").distinct())


def _linked(docs: DataFrame, width: int, percent: int, rare: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, root) of every document; a component has one ``root``, and a text
    without words has none.

    A document's set is its distinct ``width``-word shingles in lower case (A-Z only); a shorter text is one shingle, a
    text without words or null is empty and linked with nothing. Sets link when 100 * intersection >= percent * union.

    Equal sets are one node. A set must share all but (100 - percent) % of its tokens with a partner. Sets of ``SMALL``
    tokens or more are indexed by a sample, the tokens of three of eight classes of hashes, the others by all of theirs, so
    a pair with a large set meets in both samples. Of a sample too, at most as many tokens as the whole set may have for
    itself are missing from a partner, and what isn't missing and not frequent (in more than ``rare`` sets) is shared and rare.
    So sets with enough rare tokens (nearly all) meet in the short posting lists of single rare tokens, as often as that
    demands. The count is a lower bound of the overlap, and the upper one adds the frequent and the unindexed tokens of the
    poorer side; pairs between the bounds are verified by their whole sets, first the best one of every set, then those that
    still join two components. Sets without enough rare tokens, i.e. small samples by chance and members of large groups
    of copies, first meet the first set of their lists; who isn't connected by that meets the others in families of lists,
    made of prefixes of the tokens that several components share; a task compares whole sets and gives links only. Posting
    lists never give all their pairs unless they are short.

    Repeated rows and rows that share an id are documents of their own, linked if their texts are; a null id is never
    the component's id unless there is no other. Other columns are not read. An empty table gives no rows.
    """
    ranges = ranges_for(docs, "text", 24)
    facts = stored(_facts(docs, width), "shingles")
    sets = facts.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.min("doc_id").alias("doc_id"))
    lists = _index(docs, width, ranges).groupBy("part").applyInArrow(_pairs(rare, ranges), "x long, y long, c int, kind int")
    counted = stored(lists.groupBy("x", "y", "kind").agg(F.sum("c").alias("c")), "pairs")
    times = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("c"))), F.lit(0))
    frequent = counted.where("kind > 1").groupBy(F.col("x").alias("set_id")).agg(times(2).alias("g"), (times(2) + times(3)).alias("f"))
    own = (F.col("n") * (100 - percent) / 100).cast("long")  # tokens a linked set may have for itself
    sized = sets.join(frequent, "set_id", "left").fillna(0, ["g", "f"])
    sized = sized.withColumn("all", F.col("n") - F.col("f") - own).withColumn("part", F.col("k") - F.col("g") - own)
    # Who can meet a large set needs enough rare tokens in its sample too.
    least = F.when(F.col("n") >= SMALL, F.col("part")).when(100 * F.col("n") >= percent * SMALL, F.least("all", "part")).otherwise(F.col("all"))
    sized = stored(sized.withColumn("spare", least), "prefixes")
    side = lambda k: sized.select(*[F.col(c).alias(c + k if c != "set_id" else k) for c in ("set_id", "n", "k", "f", "g", "all", "part")])
    pairs = counted.where("kind < 2").groupBy("x", "y").agg(F.sum("c").cast("long").alias("c"), times(0).alias("single"))
    fits = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    whole = F.greatest("nx", "ny") < SMALL  # both are indexed by all their tokens
    by = lambda a, b: (F.when(whole, F.col(f"{a}x")).otherwise(F.col(f"{b}x")), F.when(whole, F.col(f"{a}y")).otherwise(F.col(f"{b}y")))
    (ix, iy), (fx, fy) = by("n", "k"), by("f", "g")
    links_if = lambda overlap, x, y: overlap * (100 + percent) >= percent * (x + y)
    enough = F.col("single") >= F.greatest(F.lit(1), *by("all", "part"))
    most = F.col("single") + F.least(fx, fy) + F.least(F.col("nx") - ix, F.col("ny") - iy)
    sure, open_ = links_if(F.col("c"), F.col("nx"), F.col("ny")), enough & links_if(most, F.col("nx"), F.col("ny"))
    likely = links_if(F.col("c"), ix, iy)  # what the first sets of lists are good for
    pairs = pairs.join(side("x"), "x").join(side("y"), "y").where(fits & (sure | open_ | likely))
    pairs = stored(pairs.select("x", "y", "c", sure.alias("sure")), "candidates")
    roots = stored(components(pairs.where("sure"), "x", "y"), "roots")
    rest = stored(_across(pairs.where("NOT sure").select("x", "y", "c"), roots), "open-pairs")
    ends = rest.select(F.col("x").alias("set_id")).union(rest.select("y")).union(sized.where("spare <= 0").select("set_id")).distinct()
    tokens = stored(_tokens_of(docs, width, sized.select("set_id", "doc_id").join(ends, "set_id")), "tokens")
    known = roots.select(F.col("node").alias("x"), F.col("root").alias("y"))
    best = rest.groupBy("y").agg(F.max(F.struct("c", "x")).alias("best")).select("best.x", "y")
    known = stored(_verified(best, tokens, percent).unionByName(known), "links")
    rest = _across(rest.select("x", "y"), stored(components(known, "x", "y"), "roots"))
    links = stored(_verified(rest, tokens, percent).unionByName(known), "links")
    roots = stored(components(links, "x", "y"), "roots")
    dense = sized.where("spare <= 0").join(tokens, "set_id").select("set_id", "n", "tokens").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    more = stored(_frequent_links(dense.withColumn("root", F.coalesce("root", "set_id")), percent, ranges), "family-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more), "x", "y")
    member = sized.join(roots, sized["set_id"] == roots["node"], "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    smallest = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = member.join(smallest, "root").select("set_id", "component_id", "root")
    linked = facts.where("n > 0").join(member, "set_id").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "root")
    empty = facts.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return linked.unionByName(empty)


BITS = 1024  # of the parity map of a set


def _parity(tokens: np.ndarray) -> bytes:
    """A map with one bit for each group of tokens, set if the set holds an odd number of them."""
    odd = np.bincount((tokens % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


TILE = 2048  # sets of a family that are compared with as many others in one task


def _shared_counts(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all sets as small numbers, one set after the other, and where each set starts."""
    starts = np.cumsum([0, *map(len, tokens)])
    return np.unique(np.concatenate(tokens), return_inverse=True)[1], starts


def _tile_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between sets of different components that meet in a tile, at most one for two components that they join.

    A tile holds one chunk of a family, or two of which the first meets the second. Sets differ in at least as many
    tokens as their parity maps differ in bits; who passes that is compared by whole sets.
    """
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        place = [table[c].to_numpy() for c in ("chunk", "high", "low", "family")]
        order = np.lexsort(place)
        family, low, high, chunk = (c[order] for c in reversed(place))
        ids, n, root = (table[c].to_numpy()[order] for c in ("set_id", "n", "root"))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(family) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0), [True]]))
        links = []
        for a, b in zip(edges[:-1], edges[1:]):
            group = root[a:b].copy()
            if (group == group[0]).all():
                continue
            tokens = [unpack48(table["tokens"][int(i)].as_py()) for i in order[a:b]]
            number, starts = _shared_counts(tokens)
            bits = np.stack([np.frombuffer(_parity(t), np.uint64) for t in tokens])
            own, size = n[a:b], np.diff(starts)
            second = np.searchsorted(chunk[a:b], high[a]) if low[a] < high[a] else 0
            held = np.zeros(number.max() + 1, bool)
            for i in range(second or b - a):
                later = slice(second or i + 1, None)
                near = np.bitwise_count(bits[later] ^ bits[i]).sum(1) <= (100 - percent) * (own[later] + own[i]) // (100 + percent)
                near &= (group[later] != group[i]) & (100 * np.minimum(own[later], own[i]) >= percent * np.maximum(own[later], own[i]))
                at = np.flatnonzero(near) + later.start
                if not len(at):
                    continue
                held[number[starts[i] : starts[i + 1]]] = True
                ends = np.cumsum(size[at])
                where = np.repeat(starts[at] - ends + size[at], size[at]) + np.arange(ends[-1])
                common = np.add.reduceat(held[number[where]], ends - size[at], dtype=np.int64)
                held[number[starts[i] : starts[i + 1]]] = False
                for j in at[100 * common >= percent * (own[at] + own[i] - common)]:
                    if group[j] != group[i]:
                        links.append((ids[a + i], ids[a + j]))
                        group[group == group[j]] = group[i]
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"x": pairs[:, 0], "y": pairs[:, 1]}, schema=schema)

    return run


def _frequent_links(dense: DataFrame, percent: int, ranges: int) -> DataFrame:
    """(x, y): links that join the components of dense sets (set_id, n, tokens, root).

    Sets of two components share only tokens that occur in several components; a set with too few of these is linked
    with nobody outside. The others are ordered rarest first and indexed by the prefix of which a partner must have a
    token. The lists with the same smallest set are one family, in which a set is once however many tokens it shares;
    nearly all lists of a group of copies are in few families. Large families are compared in tiles. Sets of a family
    that are no copies of each other are compared in pairs, but only links between components leave a task.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tokens = [unpack48(t).view(np.int64) for t in part.column("tokens").to_pylist()]
                refs = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
                others = [part.column(c).take(refs) for c in ("set_id", "n", "root")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *others], ["key", "set_id", "n", "root"])

    rows = dense.select("set_id", "n", "tokens", "root").mapInArrow(deal, "key long, set_id long, n long, root long")
    several = lambda r, *more: r.groupBy("key").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"), *more).where("low <> high")
    need = F.ceil(F.col("n") * percent / 100)
    rows = rows.join(several(rows).select("key", "df"), "key")
    shared = rows.groupBy("set_id").agg(F.count("*").alias("m"), F.first("n").alias("n")).where(F.col("m") >= need).select("set_id", "m")
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("df", "key"))
    rows = rows.join(shared, "set_id").withColumn("at", rank).where(F.col("at") <= F.col("m") - need + 1).select("key", "set_id", "n", "root")
    rows = stored(rows, "dense-prefixes")
    families = several(rows, F.min("set_id").alias("family")).select("key", "family")
    members = stored(rows.join(families, "key").select("family", "set_id").distinct(), "families")
    chunks = members.groupBy("family").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    members = members.join(chunks, "family").withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    tiles = members.select("family", "set_id", "chunk", other)
    tiles = tiles.select("family", "set_id", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    tiles = tiles.withColumn("part", F.pmod(F.xxhash64("family", "low", "high"), F.lit(4 * ranges)))
    tiles = tiles.join(dense.select("set_id", "n", "root", "tokens"), "set_id")
    return tiles.groupBy("part").applyInArrow(_tile_links(percent), "x long, y long")
