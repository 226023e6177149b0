"""A training corpus from the documents table: filter by language, drop near copies, cut repeated spans, mix, tokenise."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm import jaccard, language, mixing, suffix, tokens
from seriesloom.llm.store import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # language scores, random draws and token ids are not SQL; tests hold the stages against brute force


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has a language; null texts and those without a letter go. Text in several languages
    stays, as do repeated rows and null ids; an empty table gives none."""
    labelled = language.predict(docs.select(COLUMNS))
    return labelled.where(F.col("lang_pred") != "und").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of every group of near copies, and one of rows that repeat id and text.
    Rows that share an id or have none are documents of their own, told apart by their text."""
    stays = jaccard.one_of_each(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    kept = docs.select(COLUMNS).withColumn("_t", F.xxhash64("text"))
    kept = kept.join(stays, (F.col("_t") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id", "_t").orderBy("_t"))
    return kept.withColumn("_turn", turn).where("_turn = 1").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the bytes that 50-byte strings of earlier documents cover; what is left of a cut character goes too
    (in texts that lose something, replacement characters do)."""
    cut = suffix.cut_repeated_bytes(docs.select(COLUMNS), carry=("lang", "source"))
    kept = F.col("kept").cast("string")
    text = F.when(F.col("n_removed") == 0, kept).otherwise(F.regexp_replace(F.make_valid_utf8(kept), "\uFFFD", ""))
    cut = cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: a document the mix takes twice is two rows, one it doesn't take goes. Null
    and empty texts have no words and go; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; a null or empty text has no ids. Rows stay as
    they are, repeated ones and null ids too."""
    vocabulary = tokens.share(spark, tokens.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    out = tokens.decode(tokens.encode(docs.select("doc_id", "source", "text"), vocabulary), vocabulary)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
