"""How the tables of a data folder are bound to the logical inputs of the operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("long")


def calls(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events") if events is None else events
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")).alias("backend"),
        F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"), (~bad).alias("ok"),
        F.when(bad & (_k() % 2 == 0), "AuthError").when(bad, "ToolError").alias("error_type"),
        F.when(F.col("event_type") == "view", "tools/list").otherwise("tools/call").alias("operation"),
    )


CALLS = """calls AS (
  SELECT event_id AS seq, ts AS "at", 'b' || (user_id % 7) AS backend, event_type AS tool_name, value AS duration_ms, event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN CASE WHEN regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT % 2 = 0 THEN 'AuthError' ELSE 'ToolError' END END AS error_type,
         CASE WHEN event_type = 'view' THEN 'tools/list' ELSE 'tools/call' END AS operation
  FROM events)"""


def usage(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    e = (table(spark, sf_dir, "events") if events is None else events).withColumn("k", _k())
    some = F.when(F.col("k") % 10 == 0, F.create_map(F.lit("request_count"), (F.col("k") % 4 + 1).cast("string")))
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider_id"),
        F.concat(F.lit("a"), (F.col("user_id") % 11).cast("string")).alias("account_id"), F.col("user_id").alias("session_id"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_id"),
        F.col("event_type").alias("category"), F.substring(F.sha2(F.concat_ws("|", "user_id", "event_type", "k"), 256), 1, 20).alias("signature"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.when(F.col("k") % 9 == 0, 1).otherwise(0).alias("retry_count"),
        (F.col("k") * 7).alias("input_tokens"), (F.col("k") * 3).alias("output_tokens"), F.col("k").alias("cached_input_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), (F.col("k") * 2).alias("reasoning_tokens"),
        (F.col("k") * 10).alias("total_tokens"), F.col("value").alias("latency_ms"), F.when(F.col("k") % 2 == 0, F.col("value") / 4).alias("time_to_first_token_ms"), F.when(F.col("k") % 3 == 0, F.col("k") * 1.5).alias("tokens_per_second"),
        F.col("k").cast("double").alias("context_utilization_percent"), (F.col("k") / 1000).alias("estimated_cost_usd"), (F.col("k") / 10).alias("credits_consumed"),
        (F.col("k") * 100).alias("output_bytes"), (F.col("k") * 1024).alias("memory_bytes"), some.alias("metadata"), F.col("ts"),
    )


USAGE = """usage AS (
  SELECT event_id AS seq, 'u' || event_id AS id, 'p' || (user_id % 3) AS provider_id, 'a' || (user_id % 11) AS account_id, user_id AS session_id, 'm' || (user_id % 5) AS model_id,
         event_type AS category, substr(sha256(user_id || '|' || event_type || '|' || k), 1, 20) AS signature, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
         CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS retry_count, k * 7 AS input_tokens, k * 3 AS output_tokens, k AS cached_input_tokens, 0::BIGINT AS cache_write_tokens, k * 2 AS reasoning_tokens, k * 10 AS total_tokens,
         value AS latency_ms, CASE WHEN k % 2 = 0 THEN value / 4 END AS time_to_first_token_ms, CASE WHEN k % 3 = 0 THEN k * 1.5::DOUBLE END AS tokens_per_second, k::DOUBLE AS context_utilization_percent,
         k / 1000 AS estimated_cost_usd, k / 10 AS credits_consumed, k * 100 AS output_bytes, k * 1024 AS memory_bytes, CASE WHEN k % 10 = 0 THEN k % 4 + 1 ELSE 1 END AS request_count, ts
  FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k FROM events))"""


def quotas(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("p"), (F.col("s_nationkey") % 5).cast("string")).alias("provider_id"), F.col("s_acctbal").alias("used"), F.lit(10000.0).alias("limit"), (F.col("s_acctbal") / 100).alias("utilization_percent"), F.lit("tokens").alias("metric"), F.lit(None).cast("long").alias("resets_at"))


QUOTAS = """quotas AS (
  SELECT 'q' || s_suppkey AS id, 'p' || (s_nationkey % 5) AS provider_id, s_acctbal AS used, 10000.0::DOUBLE AS "limit", s_acctbal / 100 AS utilization_percent FROM supplier)"""


def processes(spark, sf_dir) -> DataFrame:
    """A process tree: the parent of pid n is n div 2; sessions are rooted at 2 to 5."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent_pid"), (F.col("p_size") * 2.0).alias("cpu_percent"), (F.col("p_retailprice") * 100).cast("long").alias("resident_memory_bytes"), (F.col("p_partkey") % 50).alias("session_id"))


PROCESSES = """processes AS (
  SELECT p_partkey AS pid, p_partkey // 2 AS parent_pid, p_size * 2.0::DOUBLE AS cpu_percent, trunc(p_retailprice * 100)::BIGINT AS resident_memory_bytes, p_partkey % 50 AS session_id FROM part)"""


def files(spark, sf_dir, version: str = "all") -> DataFrame:
    """Documents as a file tree; `old` and `new` are two versions of it."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    text = F.col("text")
    if version == "old":
        d = d.filter(F.col("doc_id") % 11 != 0)
        text = F.when(F.col("doc_id") % 13 == 0, F.concat(text, F.lit("!"))).otherwise(text)
    elif version == "new":
        d = d.filter(F.col("doc_id") % 17 != 0)
    return d.select(path.alias("path"), text.alias("text"), F.sha2(text, 256).alias("digest"), "doc_id", "source", "lang")


FILES = """files AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, text, sha256(text) AS digest, doc_id, source, lang FROM documents WHERE text IS NOT NULL)"""
OLD_NEW = """old AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END AS text, doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0),
new AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, text, doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 17 <> 0)"""


def pages(spark, sf_dir) -> DataFrame:
    """Paths of URLs without scheme, query and fragment."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#][^\n]*\z", "").alias("path"))


PAGES = r"""paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"""


def edges(spark, sf_dir) -> DataFrame:
    """Import edges between parts: a distinct list of (source, target)."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 49)
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    return li.crossJoin(n).select(F.col("l_partkey").alias("source"), (1 + (F.col("l_orderkey") * 37 + F.col("l_linenumber")) % F.col("n")).alias("target")).distinct()


EDGES = """edges AS (SELECT DISTINCT l_partkey AS source, 1 + (l_orderkey * 37 + l_linenumber) % (SELECT count(*) FROM part) AS target FROM lineitem WHERE l_quantity >= 49)"""


def turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), "role", "text", (F.col("conv_id") * 100 + F.col("turn")).alias("seq"))


def claims(spark, sf_dir) -> DataFrame:
    c = turns(spark, sf_dir)
    return c.select(F.col("seq").alias("id"), F.lit("w").alias("workspace_id"), F.col("role").alias("scope"), F.lit("fact").alias("claim_type"), (F.col("session_id") % 20).cast("string").alias("subject"), F.col("text").alias("content"), F.when(F.col("session_id") % 3 == 0, "active").otherwise("proposed").alias("state"))


CLAIMS = """claims AS (SELECT conv_id * 100 + turn AS id, 'w' AS workspace_id, role AS scope, 'fact' AS claim_type, (conv_id % 20)::VARCHAR AS subject, text AS content, CASE WHEN conv_id % 3 = 0 THEN 'active' ELSE 'proposed' END AS state FROM conversations)"""
