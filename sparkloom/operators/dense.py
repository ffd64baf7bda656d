"""Dense retrieval: encoders, cosine, exact top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sparkloom.functions.text import clamp

DIMENSION, BATCH = 384, 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def literal_vector(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def top_k(points: DataFrame, vector: list[float], k: int, id_col: str = "id", vector_col: str = "dense", among: DataFrame | None = None) -> DataFrame:
    """Exact, by falling cosine, ties by id. Vectors of another dimension or null never match. With among, only ids of that table
    count; its ids meet scores, so neither vectors nor its other columns are shuffled."""
    fits, own = points.where(F.size(vector_col) == len(vector)), float(np.sqrt(sum(float(x) * float(x) for x in vector)))
    both = norm(F.col(vector_col)) * F.lit(own)
    score = F.when(both == 0, F.lit(0.0)).otherwise(dot(F.col(vector_col), literal_vector(vector)) / both)
    scored = fits.select(F.col(id_col).alias("id"), score.alias("score"))
    if among is not None:
        scored = scored.join(among.select("id").distinct(), "id")
    return scored.orderBy(F.desc("score"), "id").limit(k)


class EncodeQuery(Protocol):
    """What encodes a query."""

    dim: int

    def encode_query(self, text: str) -> list[float]: ...


class EncodeDocuments(Protocol):
    """R2: what encodes documents, a batch at a time."""

    dim: int

    def encode_documents(self, texts: list[str]) -> list[list[float]]: ...


def padded_length(lengths: list[int], most: int = 512) -> int:
    """tokens that all sequences of a batch are padded to: the longest, cut at `most`; at least one."""
    return max([1, *(min(n, most) for n in lengths)])


def providers(available: list[str], device: str = "auto") -> list[str]:
    """Inference providers in the order of choice: a device that was asked for (or any but the CPU) where it is there, then the CPU."""
    wanted = [p for p in available if p != "CPUExecutionProvider" and (device == "auto" or device.lower() in p.lower())]
    return [*([] if device == "cpu" else wanted), "CPUExecutionProvider"]


class HashEncoder:
    """A deterministic encoder that needs no weights: signed hashes of the words, summed over the text, of `dim` dimensions."""

    def __init__(self, dim: int = DIMENSION, instruction: str = ""):
        self.dim, self.instruction = dim, instruction

    def encode_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim, np.float32)
            for word in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            out.append(v.tolist())
        return out

    def encode_query(self, text: str) -> list[float]:
        return self.encode_documents([self.instruction + text[:4000]])[0]


class OnnxEncoder:
    """An ONNX model with its tokenizer: 512 tokens, mean over the unmasked token vectors, no normalisation."""

    def __init__(self, folder: str, dim: int = DIMENSION, device: str = "auto"):
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        self.dim, self.session = dim, onnxruntime.InferenceSession(f"{folder}/model.onnx", options, providers=providers(onnxruntime.get_available_providers(), device))
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_truncation(512)
        self.tokenizer.enable_padding()

    def encode_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for start in range(0, len(texts), BATCH):
            got = self.tokenizer.encode_batch([t[:4000] for t in texts[start : start + BATCH]])
            mask = np.array([e.attention_mask for e in got], np.int64)
            feeds = {"input_ids": np.array([e.ids for e in got], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            names = {x.name for x in self.session.get_inputs()}
            out += mean_pool(self.session.run(None, {k: v for k, v in feeds.items() if k in names})[0], mask).tolist()
        return out

    def encode_query(self, text: str) -> list[float]:
        return self.encode_documents([text])[0]


def mean_pool(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """of (texts, tokens, dimensions)."""
    m = mask[:, :, None].astype(np.float32)
    return (vectors * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def encode_documents(df: DataFrame, text_col: str, out_col: str, make: Callable[[], object] = HashEncoder) -> DataFrame:
    """The encoder is made once in each Python worker and task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for texts in batches:
            yield pd.Series(encoder.encode_documents(texts.fillna("").tolist()), index=texts.index)

    return df.withColumn(out_col, encode(clamp(F.col(text_col))))
