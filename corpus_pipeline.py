"""Raw documents to packed training sequences: each stage calls one operator of sparkloom.llm on all that the stage before it kept.

Stages but the last return the columns of documents (doc_id, text, lang, source, n_chars), whatever others there are. Documents
are rows: of rows that repeat doc_id and text one stays; rows that repeat a doc_id with different texts are documents of their own
in exact dedup, and stay or go together in near-dedup; rows with a null doc_id are never dropped as copies. Null and empty texts go
in the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, langid, lpf, packing, wide_simhash
from sparkloom.llm.common import drop, settled, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter."""
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of at least 0.8 of their five-word shingles the one with the smallest doc_id stays;
    candidates come from SimHash."""
    found = wide_simhash.near_components(docs)
    copies = found.groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("kept")).where("not kept")
    return docs.join(copies.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes or more are cut from the texts; n_chars follows."""
    found = lpf.without_repeats(docs)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("suffix-array dedup", repeats), ("packing", packed)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage leaves in the shared folder goes when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
