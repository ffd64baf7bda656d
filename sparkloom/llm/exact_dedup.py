"""Exact duplicates by content sort, with DataFrame operations only.

Sampled splitters range-partition the normalised texts, an external sort brings equal texts next to each other, and neighbours
are compared in full. The splitter key is (leading characters, 64-bit hash, salt of the row): a text that holds a third of all
rows falls into many ranges by its salt, so no task gets the whole group. Each range finds runs of equal texts; runs, of which a
text has one per salt at most, are united by SHA-256, and rows meet their own run's verdict, never all rows of a text in one task.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, shuffle_partitions, table

LEADING = 24
#: Parts at least that the rows of one text are dealt to; as many as the session has shuffle partitions, where that is more.
SALTS = 64


def normalised(text):
    """Null as empty, A-Z lower-cased and nothing else. Pure ASCII, where lower() does just that, takes the fast way."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(doc_id, sha, salt, rn, n), with `row` (all columns) if whole: rn counts the rows of a run of equal texts from the largest id
    down, n is the run's length. Rows that repeat an id, or have none, are dealt out by the partition they are read from."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if whole else F.struct(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    text = F.col("row").getField(text_col).cast("string")
    salts = max(SALTS, shuffle_partitions(docs.sparkSession))
    rows = docs.select(row.alias("row")).select("row", F.col("row").getField(id_col).alias("doc_id"))
    norm = normalised(text)
    keys = {"lead": F.substring(norm, 1, LEADING), "h": F.xxhash64(norm), "salt": F.pmod(F.xxhash64("doc_id") + F.spark_partition_id(), F.lit(salts)).cast("int")}
    dealt = rows.withColumns(keys).repartitionByRange("lead", "h", "salt").withColumn("norm", norm)
    run = W.partitionBy("lead", "h", "salt", "norm")
    placed = dealt.withColumns({"rn": F.row_number().over(run.orderBy(F.desc_nulls_last("doc_id"))), "n": F.count(F.lit(1)).over(run)})
    return placed.select("doc_id", F.sha2("norm", 256).alias("sha"), "salt", "rn", "n", *(["row"] if whole else []))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normalised(). Of equal texts the row with the largest id stays. A null text is an empty
    text, equal to other empty texts. Rows that repeat id and text form a group in which exactly one row is kept. A null id is
    smaller than any other. Very long texts are compared whole. An empty table gives an empty result; other columns of the input,
    whatever their names, are ignored.
    """
    # The texts are done with after the sort: what follows moves ids and digests only.
    members = materialize(_sorted_runs(docs, id_col, text_col, False), "exact-runs")
    runs = members.where("rn = 1").select("sha", "salt", "doc_id", "n")
    groups = runs.groupBy("sha").agg(F.max(F.struct("doc_id", "salt")).alias("keep"), F.sum("n").alias("group_size"))
    verdicts = runs.select("sha", "salt").join(groups, "sha")
    return members.join(verdicts, ["sha", "salt"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        ((F.col("rn") == 1) & F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("salt") == F.col("keep.salt"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps among those with an id, with all their columns, and all rows without one.

    The columns go through the sort once; of each run the row with the largest id is written. A text that has several runs keeps the
    one of the largest id (and salt, where rows repeat an id).
    """
    has_id = F.col(f"`{id_col}`").isNotNull()
    first = materialize(_sorted_runs(docs.where(has_id), id_col, text_col, True).where("rn = 1").drop("rn", "n"), "exact-first")
    spread = first.groupBy("sha").agg(F.max(F.struct("doc_id", "salt")).alias("keep"), F.count(F.lit(1)).alias("runs")).where("runs > 1")
    beaten = first.select("sha", "salt", "doc_id").join(spread, "sha").where("NOT (doc_id <=> keep.doc_id AND salt = keep.salt)").select("sha", "salt")
    return first.join(beaten, ["sha", "salt"], "left_anti").select("row.*").unionByName(docs.where(~has_id))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
