"""The engine's tables, made from the driver's; each has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `general` collection, of documents."""
    d = t(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.col("source").alias("group"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("file_name"),
        F.when(F.col("doc_id") % 7 == 0, "website").when(F.col("doc_id") % 7 < 5, "txt").alias("doc_type"), F.col("n_chars").alias("size"), (F.col("doc_id") % 2 == 0).alias("even"), (F.col("n_chars") / 4.0).alias("quarter"), "lang",
    )


POINTS = """points AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS document, source AS "group", 'doc_' || doc_id || '.txt' AS file_name,
    CASE WHEN doc_id % 7 = 0 THEN 'website' WHEN doc_id % 7 < 5 THEN 'txt' END AS doc_type, n_chars AS size, doc_id % 2 = 0 AS even, n_chars / 4.0 AS quarter, lang FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_metadata, of orders."""
    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.concat(F.lit("obj-"), k).alias("storage_object_id"), F.concat(F.lit("up/"), F.col("o_custkey"), F.lit("/f"), k, F.when(k % 3 == 0, ".rs").otherwise(".pdf")).alias("full_path"),
        F.when(k % 3 == 0, ".rs").otherwise(".pdf").alias("file_type"), (k * 37 % 4000).alias("size_bytes"), F.when(k % 3 == 0, F.concat(F.lit("repo"), k % 11)).alias("repo_name"),
        F.when(k % 4 != 0, F.concat(F.lit("g"), F.col("o_custkey") % 17)).alias("group_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"), F.when(k % 3 == 0, "codebase").otherwise("general").alias("collection"),
    )


FILES = """files AS (SELECT o_orderkey AS id, 'obj-' || o_orderkey AS storage_object_id, 'up/' || o_custkey || '/f' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.rs' ELSE '.pdf' END AS full_path,
    CASE WHEN o_orderkey % 3 = 0 THEN '.rs' ELSE '.pdf' END AS file_type, o_orderkey * 37 % 4000 AS size_bytes, CASE WHEN o_orderkey % 3 = 0 THEN 'repo' || (o_orderkey % 11) END AS repo_name,
    CASE WHEN o_orderkey % 4 != 0 THEN 'g' || (o_custkey % 17) END AS group_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
    CASE WHEN o_orderkey % 5 != 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 'codebase' ELSE 'general' END AS collection FROM orders)"""


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.regexp_replace("s_name", "[^A-Za-z0-9_]", "_").alias("name"), (F.col("s_suppkey") % 4 != 0).alias("active"), F.concat(F.lit("2024-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0")).alias("created_at"))


SERVERS = """servers AS (SELECT s_suppkey AS id, regexp_replace(s_name, '[^A-Za-z0-9_]', '_', 'g') AS name, s_suppkey % 4 != 0 AS active, '2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS created_at FROM supplier)"""


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = t(spark, sf_dir, "part"), t(spark, sf_dir, "supplier").count()
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("tool_"), F.col("p_partkey") % 50).alias("name"), (F.col("p_partkey") % 5 != 0).alias("active"), (F.col("p_partkey") % n + 1).alias("server_id"), (F.col("p_size") % 60 - 4).alias("max_chunk_limit"), F.concat(F.lit("2024-02-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")).alias("created_at"))


TOOLS = """tools AS (SELECT p_partkey AS id, 'tool_' || (p_partkey % 50) AS name, p_partkey % 5 != 0 AS active, p_partkey % (SELECT count(*) FROM supplier) + 1 AS server_id, p_size % 60 - 4 AS max_chunk_limit,
    '2024-02-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS created_at FROM part)"""


def scopes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Code scopes belong to tools with even ids, document scopes to every third; lists are JSON text."""
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("tool_id"), "p_size")
    key, step, word = ("repo_names", 2, "repo") if kind == "code" else ("group_ids", 3, "g")
    return p.where(F.col("tool_id") % step == 0).select(
        "tool_id", F.lit("codebase" if kind == "code" else "general").alias("collection"), F.when(F.col("p_size") % 3 == 0, "[]").when(F.col("p_size") % 3 == 1, F.concat(F.lit(f'["{word}'), "p_size", F.lit('"]'))).otherwise(F.concat(F.lit(f'["{word}'), "p_size", F.lit(f'","{word}x"]'))).alias(key)
    )


def scopes_sql(kind: str) -> str:
    key, step, word = ("repo_names", 2, "repo") if kind == "code" else ("group_ids", 3, "g")
    return f"""{kind}_scopes AS (SELECT p_partkey AS tool_id, '{"codebase" if kind == "code" else "general"}' AS collection, CASE p_size % 3 WHEN 0 THEN '[]' WHEN 1 THEN '["{word}' || p_size || '"]' ELSE '["{word}' || p_size || '","{word}x"]' END AS {key} FROM part WHERE p_partkey % {step} = 0)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_status, of orders; update times fall in one day."""
    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    clock = lambda n: F.concat(F.lit("2024-05-01T"), F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":00Z"))
    return o.select(
        k.alias("id"), F.concat(F.lit("job-"), k).alias("job_id"), F.element_at(F.array(*map(F.lit, ("PENDING", "RUNNING", "FINISHED", "FAILED"))), (k % 4 + 1).cast("int")).alias("status"), clock(k).alias("created_at"), clock(k * 7).alias("updated_at"),
        F.concat(F.lit("obj-"), k).alias("storage_object_id"), F.when(k % 9 != 0, "process_zip").alias("task_name"), (k % 131 - 15).cast("int").alias("progress_percentage"), F.lit(None).cast("string").alias("error_message"),
    )


_CLOCK = "'2024-05-01T' || lpad(CAST(({0}) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({0}) % 60 AS VARCHAR), 2, '0') || ':00Z'"
JOBS = f"""jobs AS (SELECT o_orderkey AS id, 'job-' || o_orderkey AS job_id, ['PENDING', 'RUNNING', 'FINISHED', 'FAILED'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS status, {_CLOCK.format("o_orderkey")} AS created_at, {_CLOCK.format("o_orderkey * 7")} AS updated_at,
    'obj-' || o_orderkey AS storage_object_id, CASE WHEN o_orderkey % 9 != 0 THEN 'process_zip' END AS task_name, CAST(o_orderkey % 131 - 15 AS INTEGER) AS progress_percentage, CAST(NULL AS VARCHAR) AS error_message FROM orders)"""
