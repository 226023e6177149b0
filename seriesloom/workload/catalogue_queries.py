"""File lists, text filters, content pools and the ledger over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import columns as cols
from seriesloom.operators import ledger
from seriesloom.plans.series import Series, index_series
from seriesloom.sources import recordings
from seriesloom.workload.registry import query
from seriesloom.workload.tables import table


@query("p1_name_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), lower('EN/'))")
def name_search(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.lower("url").contains("EN/".lower())).select("page_id", "url")


@query("p2_extension_filter", "SELECT page_id, url FROM pages WHERE regexp_extract(lower(url), '\\.([a-z]+)$', 1) IN ('html', 'htm')")
def extension_filter(spark, sf_dir):
    ext = F.regexp_extract(F.lower("url"), r"\.([a-z]+)$", 1)
    return table(spark, sf_dir, "pages").filter(ext.isin("html", "htm")).orderBy("url", "page_id").select("page_id", "url")


@query("p7_display_names", """SELECT doc_id, regexp_replace(doc_id || '_' || source, '^\\d*_', '') AS name,
  CAST(CAST(round_even(n_chars / 15.0, 0) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(round_even(n_chars / 15.0, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock,
  CASE WHEN n_chars < 1024 THEN format('{:,}', n_chars) || ' B' ELSE format('{:,.1f}', n_chars / 1024.0) || ' KiB' END AS size FROM documents""")
def display_names(spark, sf_dir):
    path = F.concat(F.lit("/music/"), F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit(".wav"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        cols.short_name(path).alias("name"),
        cols.minutes_seconds(F.col("n_chars") / 15.0).alias("clock"),
        cols.byte_size(F.col("n_chars")).alias("size"),
    )


@query("s5_timed_files", """WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host, url, page_id FROM pages)
SELECT host, url, page_id, row_number() OVER (PARTITION BY host ORDER BY url, page_id) - 1 AS snap, (row_number() OVER (PARTITION BY host ORDER BY url, page_id) - 1) * 0.25::DOUBLE AS t_h FROM h""")
def timed_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1).alias("host"), "url", "page_id")
    named = pages.withColumn("name", F.struct("url", "page_id"))
    return recordings.timed_files(named, ["host"], "name", 0.25).select("host", "url", "page_id", "snap", "t_h")


@query("s12_catalogue", """WITH f AS (SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem,
  lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS ext FROM (SELECT page_id, '/lib/' || (page_id % 40) || CASE WHEN page_id % 3 = 0 THEN '.bin' ELSE '.wav' END AS url FROM pages)),
d AS (SELECT DISTINCT folder, stem FROM f WHERE ext = 'bin')
SELECT page_id, f.folder, f.stem, ext, ext <> 'bin' AND d.stem IS NOT NULL AS has_derived FROM f LEFT JOIN d USING (folder, stem) WHERE ext IN ('wav', 'bin')""")
def catalogue(spark, sf_dir):
    ext = F.when(F.col("page_id") % 3 == 0, ".bin").otherwise(".wav")
    files = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("/lib/"), (F.col("page_id") % 40).cast("string"), ext).alias("path")
    )
    return recordings.catalogue(files, "path", "wav", "bin").select("page_id", "folder", "stem", "ext", "has_derived")


@query("a12_distinct_contents", "SELECT source, count(DISTINCT sha256(text)) AS contents, count(*) AS documents FROM documents GROUP BY 1")
def distinct_contents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("hash"))
    once = rows.groupBy("source", "hash").agg(F.count(F.lit(1)).alias("copies"))
    return once.groupBy("source").agg(F.count(F.lit(1)).alias("contents"), F.sum("copies").alias("documents"))


@query("j6_only_new_contents", """WITH known AS (SELECT sha256(text) AS h FROM documents WHERE lang = 'en'),
b AS (SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE lang <> 'en' OR n_chars > 500 GROUP BY 1)
SELECT content_hash, doc_id FROM b WHERE content_hash NOT IN (SELECT h FROM known)""")
def only_new_contents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("content_hash"))
    known = docs.filter("lang = 'en'").select("content_hash")
    batch = docs.filter("lang <> 'en' OR n_chars > 500").select("content_hash", "doc_id")
    return ledger.only_new(batch, known, "doc_id").select("content_hash", "doc_id")


@query("l1_sorted_matches", "SELECT p_partkey, p_name, p_retailprice FROM part")
def sorted_matches(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").select("p_partkey", "p_name", "p_retailprice")


@query("l2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("l3_listing_changes", """WITH a AS (SELECT source AS name FROM documents WHERE lang = 'en'), b AS (SELECT source AS name FROM documents WHERE lang <> 'en')
(SELECT name, 'gone' AS change FROM (SELECT name FROM a EXCEPT ALL SELECT name FROM b)) UNION ALL (SELECT name, 'new' AS change FROM (SELECT name FROM b EXCEPT ALL SELECT name FROM a))""")
def listing_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before, after = docs.filter("lang = 'en'").select(F.col("source").alias("name")), docs.filter("lang <> 'en'").select(F.col("source").alias("name"))
    gone = before.exceptAll(after).withColumn("change", F.lit("gone"))
    return gone.unionByName(after.exceptAll(before).withColumn("change", F.lit("new")))


@query("l4_concatenated_turns", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations UNION ALL SELECT doc_id, 0, 'document', length(text) FROM documents")
def concatenated_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("document").alias("role"), F.length("text").cast("long").alias("chars")
    )
    return turns.unionByName(docs)


CHAIN = """
firsts AS (SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1),
numbered AS (SELECT content_hash, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM firsts),
chain AS (SELECT idx, content_hash, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || content_hash || '0') AS block_hash FROM numbered WHERE idx = 0
          UNION ALL SELECT n.idx, n.content_hash, c.block_hash, sha256(c.block_hash || n.content_hash || n.idx) FROM chain c JOIN numbered n ON n.idx = c.idx + 1)"""


def _ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    empty = spark.createDataFrame([], "index long, content_hash string, prev_hash string, block_hash string")
    return docs, ledger.append_once(empty, docs, "doc_id").select("index", "content_hash", "prev_hash", "block_hash")


@query("h3_h4_linked_ledger", f'WITH RECURSIVE {CHAIN} SELECT idx AS "index", content_hash, prev_hash, block_hash FROM chain')
def linked_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)[1]


@query("h5_verify_ledger", f"""WITH RECURSIVE {CHAIN},
seen AS (SELECT idx, CASE WHEN idx = (SELECT count(*) // 2 FROM numbered) THEN 'x' || content_hash ELSE content_hash END AS content, prev_hash, block_hash,
         coalesce(lag(block_hash) OVER (ORDER BY idx), repeat('0', 64)) AS before FROM chain),
bad AS (SELECT min(idx) AS first_bad FROM seen WHERE prev_hash <> before OR block_hash <> sha256(before || content || idx))
SELECT first_bad IS NULL AS ok, first_bad FROM bad""")
def verify_ledger(spark, sf_dir):
    """The linked ledger with the content of its middle row changed."""
    _, links = _ledger(spark, sf_dir)
    middle = links.count() // 2
    content = F.when(F.col("index") == middle, F.concat(F.lit("x"), F.col("content_hash"))).otherwise(F.col("content_hash"))
    return ledger.verify(links.withColumn("content_hash", content))
