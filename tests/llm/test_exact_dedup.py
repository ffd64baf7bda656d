"""Exact duplicates against a dictionary."""

import hashlib

from pyspark.sql import functions as F

from sparkloom.llm.exact_dedup import exact_duplicates, without_duplicates


def norm(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "Ab"), (4, "aB"), (5, "ÀB"), (6, "àb"), (7, "ÀB"), (8, "x" * 300_000), (9, "X" * 300_000), (10, "y")]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, sha string, n int")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(docs).collect()}
    for i, t in rows:
        same = [j for j, u in rows if norm(u) == norm(t)]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(norm(t).encode()).hexdigest())
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = exact_duplicates(docs).collect()
    assert sorted((r.text_sha256, r.kept) for r in got if r.group_size == 3).count((hashlib.sha256(b"a").hexdigest(), True)) == 1
    assert [r.kept for r in got if r.group_size == 1] == [True]


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'The Same', concat('t', id)) AS text")
    kept = exact_duplicates(docs).where("kept")
    assert kept.count() == 2001 and kept.where("group_size = 1000").first().doc_id == 2997


def test_rows_that_stay(spark):
    """Ids that repeat or are missing, texts that differ in case, clashing names of columns."""
    rows = [(1, "Same", "x"), (2, "sAME", "y"), (2, "same", "z"), (2, "other", "x"), (None, "same", "x"), (None, "same", "x"), (None, "own", None), (3, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string").withColumns({"rn": F.lit(7), "norm": F.lit("n"), "row": F.lit("r"), "salt": F.lit(None).cast("int")})
    got = without_duplicates(docs)
    assert got.columns == docs.columns
    found = sorted(((r.doc_id or 0, norm(r.text)) for r in got.collect()))
    assert found == sorted([(2, "same"), (2, "other"), (0, "same"), (0, "same"), (0, "own"), (4, "")])
    assert without_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows_over_many_partitions(spark):
    docs = spark.range(4000).selectExpr("id % 2 AS doc_id", "'one and the same' AS text").repartition(16)
    got = exact_duplicates(docs)
    assert got.count() == 4000 and got.where("kept").count() == 1 and got.where("group_size = 4000 AND keep_id = 1").count() == 4000
    assert [r.doc_id for r in without_duplicates(docs).collect()] == [1]
