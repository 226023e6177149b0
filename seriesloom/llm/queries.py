"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import collocations, debruijn, jaccard, language, licenses, mixing, negatives, suffix, tokens, toolcalls, vectors, warc
from seriesloom.llm.registry import ORACLES, QUERIES, query, table
from seriesloom.session import shared_folder

__all__ = ["ORACLES", "QUERIES"]


@query("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(mixing.sized_documents(table(spark, sf_dir, "documents")))).drop("source")


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.cut_repeated_words(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op3_language_spans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.predict(table(spark, sf_dir, "documents"))
    out = language.held_out(F.col("doc_id"))
    return docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


OP4 = """
WITH u AS (SELECT conv_id, turn, min(text) AS text, count(*) AS uses FROM conversations WHERE role = 'user' GROUP BY ALL),
a AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL),
g AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS grp FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, grp ORDER BY turn) AS position FROM g),
s AS (SELECT p.*, a.text AS result, CASE WHEN uses > 1 THEN 'duplicate' WHEN p.text IS NULL THEN 'invalid_arguments'
      WHEN a.turn IS NULL THEN 'no_result' ELSE 'ok' END AS status
      FROM p LEFT JOIN a ON a.conv_id = p.conv_id AND a.turn = p.turn + 1)
SELECT conv_id, 'call-' || turn AS call_id, position, status,
       CAST(json_object('after', CASE WHEN position > 1 THEN 'call-' || (turn - 2) END,
            'arguments', json_object('query', text, 'turn', turn), 'call', 'call-' || turn, 'position', position,
            'result', result, 'status', status, 'tool', 'reply') AS VARCHAR) AS record
FROM s
"""


@query("op4_tool_call_links", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return toolcalls.link_tool_calls(*toolcalls.calls_of_turns(turns), toolcalls.REPLY)


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.share(spark, tokens.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    docs = tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    docs = docs.withColumn("n_tokens", (F.length("ids") / 4).cast("long")).withColumn("ids_sha256", F.sha2("ids", 256))
    docs = tokens.decode(docs, vocabulary)
    return docs.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_ngram_jaccard")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


@query("op7_embedding_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_exact_top_k")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.cut_repeated_bytes(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op10_warc_archives")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path)


OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 10
"""


@query("op11_hard_negatives", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_license_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("expressions")


OP13 = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
      FROM documents)),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f
      FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.f, x.f AS l, y.f AS r, j,
      CAST(c.f::HUGEINT * 2000000 // (x.f::HUGEINT + y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
      JOIN g AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ')
      JOIN g AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = best.lang AND len(c.phrase) > len(best.phrase)
      AND contains(' ' || c.phrase || ' ', ' ' || best.phrase || ' ') AND 100::HUGEINT * c.f >= 80::HUGEINT * best.f))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op13_phrase_collocations", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
