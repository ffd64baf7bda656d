"""Reciprocal rank fusion of ranked lists, and reranking."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
#: Pairs that a scorer gets at a time.
BATCH = 16


def ranked(df: DataFrame) -> DataFrame:
    """Rank from 1 by falling score, ties by id. For lists that a limit has bounded: the ranking is in one task."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def fuse(lists: list[DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """(id, score) of the best by the sum of 1 / (k + rank) over the lists they are in."""
    rows = [ranked(x).select("id", (1.0 / (k + F.col("rank"))).alias("part")) for x in lists]
    both = rows[0]
    for x in rows[1:]:
        both = both.unionByName(x)
    return both.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def lexical_score(query: str, document: str) -> float:
    """A reranker that needs no weights: the part of the query's words that the document has, and how early."""
    words = set(re.findall(r"\w+", query[:4000].lower()))
    found = re.findall(r"\w+", (document or "")[:4000].lower())
    if not words:
        return 0.0
    first: dict[str, int] = {}
    for i, w in enumerate(found):
        if w in words:
            first.setdefault(w, i)
    return len(first) / len(words) + sum(1 / (100 + i) for i in first.values()) / len(words)


def batched(score: Callable[[str, str], float]) -> Callable[[str, list[str]], list[float]]:
    """A scorer of lists from one of single pairs."""
    return lambda query, documents: [float(score(query, d)) for d in documents]


class OnnxPairScorer:
    """A cross-encoder: query and document as one sequence of at most 512 tokens, of which the longer side is cut; the first output is
    the score (J9). All pairs of a batch are padded to its longest (F17)."""

    def __init__(self, folder: str, most: int = 512):
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(f"{folder}/model.onnx", options)
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_truncation(most, strategy="longest_first")
        self.tokenizer.enable_padding()

    def __call__(self, query: str, documents: list[str]) -> list[float]:
        import numpy as np

        got = self.tokenizer.encode_batch([(query[:4000], d[:4000]) for d in documents])
        feeds = {"input_ids": [e.ids for e in got], "attention_mask": [e.attention_mask for e in got], "token_type_ids": [e.type_ids for e in got]}
        names = {x.name for x in self.session.get_inputs()}
        found = self.session.run(None, {k: np.array(v, np.int64) for k, v in feeds.items() if k in names})[0]
        return np.asarray(found, np.float64).reshape(len(documents), -1)[:, 0].tolist()


def rerank(candidates: DataFrame, query: str, limit: int, score: Callable = lexical_score, by_list: bool = False) -> DataFrame:
    """Of (id, document, score): scored anew, best first, equal scores (and NaN) in the candidates' order, cut.

    The scorer takes a query and a document, or with by_list a query and up to BATCH documents.
    """
    of_list = score if by_list else batched(score)

    @F.pandas_udf("double")
    def scored(documents: pd.Series) -> pd.Series:
        texts = documents.fillna("").tolist()
        return pd.Series([x for i in range(0, len(texts), BATCH) for x in of_list(query, texts[i : i + BATCH])], dtype="float64")

    order = candidates.withColumn("candidate_rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    return order.withColumn("score", scored("document")).orderBy(F.desc(F.when(F.isnan("score"), None).otherwise(F.col("score"))), "candidate_rank").limit(limit)
