"""The store's relations over the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = """chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS session_id, lang AS repo, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'main' END AS branch, text AS content,
    CASE doc_id % 4 WHEN 0 THEN 'wiki' WHEN 1 THEN 'dream' ELSE 'raw' END AS tier,
    CASE doc_id % 8 WHEN 1 THEN 'decision' WHEN 5 THEN 'gotcha' END AS dream_type,
    CASE WHEN doc_id % 50 <> 7 THEN TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 720) * INTERVAL 1 HOUR END AS ts,
    CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS invalid_at,
    'owner' || CAST(doc_id % 3 AS VARCHAR) AS owner, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 1 ELSE 2 END AS chunker_version,
    'm' || CAST(doc_id % 2 AS VARCHAR) AS embedding_model, CAST(doc_id // 4 AS VARCHAR) AS trajectory_id, CAST(doc_id % 4 AS INTEGER) AS chunk_index
  FROM documents)"""

DEMAND = """demand AS (
  SELECT event_id AS id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'ask' END AS kind,
    CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END || ' ' || CAST(user_id % 50 AS VARCHAR) AS query,
    event_id % 5 AS result_count, CASE WHEN event_id % 7 <> 0 THEN value / 40 END AS top_similarity,
    CASE event_id % 4 WHEN 0 THEN 'wiki' WHEN 1 THEN 'dream' ELSE 'raw' END AS top_tier, 's' || CAST(user_id AS VARCHAR) AS top_session_id,
    CASE event_type WHEN 'error' THEN 'not_covered' WHEN 'signup' THEN 'no_candidates' ELSE 'answered' END AS outcome
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"), "doc_id", F.col("source").alias("session_id"), F.col("lang").alias("repo"), F.when(d % 3 == 0, "").otherwise("main").alias("branch"), F.col("text").alias("content"),
        F.when(d % 4 == 0, "wiki").when(d % 4 == 1, "dream").otherwise("raw").alias("tier"), F.when(d % 8 == 1, "decision").when(d % 8 == 5, "gotcha").alias("dream_type"),
        F.when(d % 50 != 7, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 720 AS INT), 0, 0)")).alias("ts"),
        F.when(d % 11 == 0, F.expr("timestamp_ntz'2024-03-01 00:00:00'")).alias("invalid_at"), F.concat(F.lit("owner"), (d % 3).cast("string")).alias("owner"),
        F.when(d % 5 == 1, 1).when(d % 5 != 0, 2).alias("chunker_version"), F.concat(F.lit("m"), (d % 2).cast("string")).alias("embedding_model"),
        F.floor(d / 4).cast("string").alias("trajectory_id"), (d % 4).cast("int").alias("chunk_index"),
    )


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), "ts", F.when(F.col("event_type").isin("view", "click"), "search").otherwise("ask").alias("kind"),
        F.concat(F.when(e % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit(" "), (F.col("user_id") % 50).cast("string")).alias("query"), (e % 5).alias("result_count"),
        F.when(e % 7 != 0, F.col("value") / 40).alias("top_similarity"), F.when(e % 4 == 0, "wiki").when(e % 4 == 1, "dream").otherwise("raw").alias("top_tier"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("top_session_id"), F.when(F.col("event_type") == "error", "not_covered").when(F.col("event_type") == "signup", "no_candidates").otherwise("answered").alias("outcome"),
    )


PAGES = r"""wiki AS (
  SELECT 'p' || CAST(page_id AS VARCHAR) AS slug, page_id AS ordinal, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    list_transform(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1), lambda x: lower(x)) AS targets, html AS body,
    CASE page_id % 4 WHEN 0 THEN 'topic' WHEN 1 THEN 'entity' WHEN 2 THEN 'decision' ELSE 'howto' END AS kind,
    lower(regexp_extract(html, 'href="/([A-Za-z]+)"', 1)) AS alias
  FROM pages)"""


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as compiled pages: the first link target of a page is its alias, all are its links."""
    p = F.col("page_id")
    href = lambda: F.lit('href="/([A-Za-z]+)"')
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), p.cast("string")).alias("slug"), p.alias("ordinal"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.transform(F.regexp_extract_all("html", href(), F.lit(1)), lambda x: F.lower(x)).alias("targets"), F.col("html").alias("body"),
        F.when(p % 4 == 0, "topic").when(p % 4 == 1, "entity").when(p % 4 == 2, "decision").otherwise("howto").alias("kind"), F.lower(F.regexp_extract("html", 'href="/([A-Za-z]+)"', 1)).alias("alias"),
    )
