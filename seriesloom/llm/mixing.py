"""Mix sources to target weights: fixed-length blocks, multinomial draws per shard, pseudorandom index permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.store import stored
from seriesloom.llm.text import mixed

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 100_000  # a recipe with more sources is refused: its table is held by the driver and every task
MAX_EPOCHS = 3
_RUN = 1 << 12  # documents (or shards) whose running totals one task adds up


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MAX_EPOCHS) -> np.ndarray:
    """Shares of the total size by weight; none above ``most`` times its source, the excess goes to the others by weight."""
    caps, out = most * sizes.astype(float), np.zeros(len(sizes))
    open_, left = np.ones(len(sizes), bool), float(sizes.sum())
    while open_.any() and left > 0:
        share = left * weights / weights[open_].sum()
        full = open_ & (share > caps)
        if not full.any():
            out[open_] = share[open_]
            break
        out[full] = caps[full]
        left -= caps[full].sum()
        open_ &= ~full
    return out


def recipe(sized: DataFrame, weights: tuple[float, ...], block: int) -> pd.DataFrame:
    """One row per source in code point order, null last: number, size, blocks, target and the slots that fill it.

    A target is whole passes over the source and a last, partial pass. ``tail_at`` is the slot of that pass that holds
    the source's short last block; ``taken`` the whole words that the mix takes.
    """
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("documents")).limit(MAX_SOURCES + 1).toPandas()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    found["key"] = [(s is None, (s or "").encode()) for s in found["source"]]
    out = found.sort_values("key", ignore_index=True).drop(columns="key")
    out["source"] = out["source"].astype(object).where(out["source"].notna(), None)
    n, size = np.arange(len(out)), out["size"].to_numpy("int64")
    out["number"] = n
    out["target"] = targets(size, np.asarray(weights, float)[n % len(weights)])
    out["blocks"] = -(-size // block)
    out["taken"] = np.minimum(np.rint(out["target"]).astype("int64"), MAX_EPOCHS * size)
    passes = np.where(size > 0, out["taken"] // np.maximum(size, 1), 0)
    rest = out["taken"] - passes * size
    tail = size - (out["blocks"] - 1) * block  # words of the last block
    out["tail"], out["rest"], out["passes"] = tail, rest, passes
    out["tail_at"] = [_position(int(b) - 1, int(b), int(i), int(p)) if b else 0 for b, i, p in zip(out["blocks"], n, passes)]
    before = out["tail_at"] * block  # words in the partial pass before the short block
    slots = np.where(rest <= before, -(-rest // block), np.where(rest <= before + tail, out["tail_at"] + 1, -(-(rest - tail) // block) + 1))
    out["slots"] = passes * out["blocks"] + np.where(rest > 0, slots, 0)
    return out


_ROUNDS = 4


def _halves(n: int) -> tuple[int, int]:
    low = 1
    while low * low < n:
        low *= 2
    return low, -(-n // low)


def permuted(index: np.ndarray, n: np.ndarray, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), another for each (source, turn): a Feistel network with cycle walking."""
    out = index.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    seed = mixed(source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn.astype(np.uint64) + np.uint64(1))
    walk = np.ones(len(out), bool)
    while walk.any():
        at = np.flatnonzero(walk)
        left, right = out[at] >> half[at], out[at] & mask[at]
        for r in range(_ROUNDS):
            left, right = right, left ^ (mixed(right + seed[at] + np.uint64(r * 0x632BE59BD9B4E019 % (1 << 63))) & mask[at])
        out[at] = (left << half[at]) | right
        walk[at] = out[at] >= n[at].astype(np.uint64)
    return out.astype(np.int64)


def _position(block: int, blocks: int, source: int, turn: int) -> int:
    """The slot of a pass that holds ``block``: the inverse of ``permuted``, found by walking it backwards."""
    bits = max(1, (max(blocks, 2) - 1).bit_length())
    half = (bits + 1) // 2
    mask = (1 << half) - 1
    one = lambda x: int(mixed(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
    seed = one(source * 0x9E3779B97F4A7C15 + turn + 1)
    out = block
    while True:
        left, right = out >> half, out & mask
        for r in reversed(range(_ROUNDS)):
            left, right = right ^ (one(left + seed + r * 0x632BE59BD9B4E019 % (1 << 63)) & mask), left
        out = (left << half) | right
        if out < blocks:
            return out


def _running(df: DataFrame, key: str, order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Exclusive running total of ``value`` within ``key``: inside buckets first, then over one row per bucket."""
    rows = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_bucket", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(sums, [key, "_bucket"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, source, size) of every document, written once; ``tie`` tells texts of one id apart."""
    return stored(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), "source", word_count(F.col("text")).alias("size")), "sized")


def mix(
    sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block: int = 1024, shard: int = 256, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(documents with their place, takes) of a mix of ``sized`` documents (doc_id, tie, source, size).

    The words of a source, document after document, form blocks of ``block`` words. Output shards of ``shard`` slots
    draw how many of their slots go to each source from the multinomial law of the targets; slots beyond a source's
    quota lapse and what the draws leave short follows in further shards, so every source ends on its target to the
    word. The j-th slot of a source reads block permutation(j) of pass j // blocks, each pass with a permutation of its
    own, and only then meets the words, in a join by block index. A take is (shard, slot, number, turn, doc_id, tie,
    start, from_word, n_words): words of one document, ``start`` being the document's place in its source.

    Everything follows from the seed and the rows, so reruns agree. Null texts and empty texts have no words and no
    takes; null is a source of its own; repeated rows are documents of their own. Columns other than doc_id, text and
    source are not read. A source is never one task: places are running totals over buckets, and blocks spread evenly
    however large the source is. An empty table mixes to nothing.
    """
    spark = sized.sparkSession
    plan = recipe(sized, weights, block)
    columns = ["number", "source", "size", "target", "blocks", "slots", "tail", "rest", "passes", "tail_at"]
    known = spark.createDataFrame(
        plan[columns].rename(columns={"size": "source_size"}),
        "number int, source string, source_size long, target double, blocks long, slots long, tail long, rest long, passes long, tail_at long",
    )
    known = F.broadcast(known)  # at most MAX_SOURCES rows
    named = known.select("number", F.col("source").alias("_source"), "source_size", "target")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    bucket = F.pmod(F.col("tie"), F.lit(int(plan["documents"].sum()) // _RUN + 1))
    placed = _running(placed, "number", ["tie", "doc_id", "size"], bucket, "size", "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = (
        placed.where("size > 0")
        .select("number", "doc_id", "tie", "start", "size", F.explode(F.sequence(first, last)).alias("index"))
        .withColumn("at", F.greatest(F.col("start"), F.col("index") * block))
        .withColumn("until", F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block))
    )

    quota = plan["slots"].to_numpy("int64")
    chance = quota / max(1, quota.sum())
    shards = int(-(-quota.sum() // shard))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["id"]:
                counts = np.random.default_rng([seed, int(s)]).multinomial(shard, chance)
                hit = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": np.full(len(hit), s, "int64"), "number": hit.astype("int32"), "n": counts[hit]})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, number int, n long")
    drawn = _running(drawn, "number", ["shard"], F.floor(F.col("shard") / _RUN), "n", "first")
    main = drawn.join(known, "number").withColumn("n", F.least("n", F.greatest(F.lit(0), F.col("slots") - F.col("first"))))
    short = known.join(drawn.groupBy("number").agg(F.sum("n").alias("first")), "number", "left")
    short = short.withColumn("first", F.coalesce("first", F.lit(0))).where("slots > first")
    short = short.withColumn("more", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - F.col("first") - 1) / shard))))
    short = short.withColumn("first", F.col("first") + F.col("more") * shard).withColumn("shard", F.col("more") + shards)
    short = short.withColumn("n", F.least(F.lit(shard), F.col("slots") - F.col("first")))
    slots = main.unionByName(short.select(main.columns)).where("n > 0")
    slots = slots.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    slots = slots.select("shard", "number", "j", "blocks", "tail", "rest", "passes", "tail_at")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turn, slot = b["j"] // b["blocks"], b["j"] % b["blocks"]
            index = permuted(slot.to_numpy(), b["blocks"].to_numpy(), b["number"].to_numpy(), turn.to_numpy())
            # Words of the partial pass before this slot; the last slot is cut where the target is met.
            before = slot * block - (slot > b["tail_at"]) * (block - b["tail"])
            room = np.where(turn < b["passes"], block, (b["rest"] - before).clip(0, block))
            yield pd.DataFrame({"shard": b["shard"], "slot": b["j"], "number": b["number"], "turn": turn, "index": index, "room": room})

    slots = slots.mapInPandas(look_up, "shard long, slot long, number int, turn long, index long, room long")
    most = F.least(F.col("until"), F.col("index") * block + F.col("room")) - F.col("at")
    takes = slots.join(pieces, ["number", "index"]).select(
        "shard", "slot", "number", "turn", "doc_id", "tie", "start", (F.col("at") - F.col("start")).alias("from_word"), most.alias("n_words")
    )
    return placed, takes.where("n_words > 0")


def taken(placed: DataFrame, takes: DataFrame) -> DataFrame:
    """One row per document: its words, its source's words and target, and the words that the mix takes from it."""
    words = takes.groupBy("number", "start").agg(F.sum("n_words").alias("taken"))
    full, none = placed.where("size > 0").join(words, ["number", "start"], "left"), placed.where("size = 0")
    out = full.unionByName(none.withColumn("taken", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns doc_id, text, lang, source and n_chars: a document comes once for each whole
    pass over it and, for a partial pass, once with the words it takes, in their order, joined by spaces. Documents
    without words go."""
    placed, takes = mix(sized_documents(docs), **options)
    spans = takes.groupBy("number", "turn", "start").agg(
        F.first("doc_id").alias("_id"), F.first("tie").alias("tie"), F.sum("n_words").alias("n"),
        F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("spans"),
    )
    spans = spans.join(placed.where("size > 0").select("number", "start", F.col("source").alias("_source"), "size"), ["number", "start"])
    once = docs.select("doc_id", "text", "lang", "source", F.xxhash64("doc_id", "text").alias("tie")).dropDuplicates(["doc_id", "tie", "source"])
    same = (once["tie"] == spans["tie"]) & once["doc_id"].eqNullSafe(spans["_id"]) & once["source"].eqNullSafe(spans["_source"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.flatten(F.transform("spans", lambda s: F.slice(words, (s["from_word"] + 1).cast("int"), s["n_words"].cast("int"))))
    out = once.join(spans, same).withColumn("text", F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(F.array_join(part, " ")))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
