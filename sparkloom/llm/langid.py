"""Language ID by language-bitmask n-gram filters.

For each language the n-grams of its training texts that are typical of it go into a Bloom filter. The filters are bit-sliced: one
array whose entry at a hash holds a bit per language, so k lookups and their conjunction give all languages that contain an
n-gram; languages beyond one array's bits have further arrays. Bits are counted per document and language, the count is corrected
for the filter's rate of false positives, and the language with the largest corrected share decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import byte_rows, held_out, materialize, release_kept, sliced, table, texts

GRAM = 5
#: Bounds of the fit: labelled rows, n-grams of a language. Languages that an array has bits for.
SAMPLE_ROWS, MAX_GRAMS, BITS = 4000, 30_000, 64
#: An n-gram is typical of a language that has it this often at least, and not this much less often than another language.
MIN_COUNT, MIN_SHARE = 3, 0.05
SLOTS, HASHES = 1 << 20, 3
#: Bytes of texts that are looked up at a time.
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _fold_table() -> np.ndarray:
    """Lower case for A-Z; letters and bytes of longer characters stay; all else is a space."""
    t = np.full(256, 32, np.uint8)
    t[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    t[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    t[128:] = np.arange(128, 256)
    return t


FOLD = _fold_table()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of bytes of all documents with a space before and after each, and the offsets of the documents' n-grams; blank ones are 0."""
    sizes = np.diff(offsets)
    n, pad = len(sizes), GRAM - 1
    room = np.full(int(sizes.sum()) + pad * (n + 1), 32, np.uint8)
    begin = np.arange(n) * pad + pad + offsets[:-1]
    shift = np.repeat(begin - offsets[:-1], sizes)
    room[np.arange(len(data)) + shift] = FOLD[data]
    key = np.zeros(len(room) - pad, np.uint64)
    for i in range(GRAM):
        key <<= np.uint64(8)
        key |= room[i : i + len(key)]
    key[key == np.uint64(int.from_bytes(b" " * GRAM, "big"))] = 0
    return key, np.r_[begin - pad, len(key)]


@dataclass
class Model:
    languages: list[str]
    #: One array for every BITS languages, in their order.
    masks: list[np.ndarray]
    false_rate: np.ndarray
    default: int

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, languages): the corrected share of a document's n-grams that a language contains."""
        key, cuts = grams(data, offsets)
        real = key != 0
        total = np.maximum(np.add.reduceat(real, cuts[:-1], dtype=np.int64), 1)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        spots = [(key * m >> np.uint64(64 - (len(self.masks[0]) - 1).bit_length())).astype(np.int64) for m in _MULTIPLIERS[:HASHES]] if self.masks else []
        for w, masks in enumerate(self.masks):
            found = np.bitwise_and.reduce([masks[at] for at in spots])
            found[~real] = 0
            one = masks.dtype.type(1)
            for k in range(w * BITS, min((w + 1) * BITS, len(self.languages))):
                hits = np.add.reduceat(found >> masks.dtype.type(k - w * BITS) & one, cuts[:-1], dtype=np.int64)
                out[:, k] = np.clip((hits / total - self.false_rate[k]) / (1 - self.false_rate[k]), 0, 1)
        return out


def build(rows: list[tuple[str, int, int]], totals: dict[str, int], slots: int = SLOTS) -> Model:
    """Of (language, n-gram, count) rows and the number of documents of each language."""
    languages = sorted(totals)
    if not languages:
        return Model([], [], np.zeros(0), 0)
    index = {x: i for i, x in enumerate(languages)}
    lang = np.array([index[r[0]] for r in rows], np.int64)
    gram, count = np.array([r[1] for r in rows], np.int64).astype(np.uint64), np.array([r[2] for r in rows], np.float64)
    share = count / np.maximum(np.bincount(lang, count, len(languages)), 1)[lang]
    _, inverse = np.unique(gram, return_inverse=True)
    best = np.zeros(inverse.max(initial=-1) + 1)
    np.maximum.at(best, inverse, share)
    typical = share >= MIN_SHARE * best[inverse]
    arrays, fill = [], []
    for first in range(0, len(languages), BITS):
        own_bits = min(BITS, len(languages) - first)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if own_bits <= 8 * np.dtype(t).itemsize)
        masks = np.zeros(slots, kind)
        for k in range(own_bits):
            own = gram[typical & (lang == first + k)]
            for m in _MULTIPLIERS[:HASHES]:
                masks[(own * m >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)] |= kind(1 << k)
        arrays.append(masks)
        fill += [(masks >> kind(k) & kind(1)).mean() for k in range(own_bits)]
    return Model(languages, arrays, np.array(fill) ** HASHES, max(range(len(languages)), key=lambda k: (totals[languages[k]], -k)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_kept()
    for batch in sliced(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist())
        key, cuts = grams(*byte_rows(batch))
        of = np.repeat(np.arange(len(langs)), np.diff(cuts))
        for x in np.unique(langs).tolist():
            g, n = np.unique(key[(langs[of] == x) & (key != 0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(g)), pa.array(g.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Of rows (doc_id, text, lang); about sample_rows of them, chosen by a hash of the id, are used. Null langs and texts are left out."""
    rows = labelled.where("lang is not null and text is not null")
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = min(1.0, sample_rows / max(1, sum(totals.values())))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).select("text", "lang")
    counts = sample.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    counts = materialize(counts, "lang-grams")
    # The most frequent n-grams of each language: all with a count at which no more than MAX_GRAMS have it or more. No ranking, so no
    # task gets a language; the driver sees how many n-grams have each count.
    least: dict[str, int] = {}
    held: dict[str, int] = {}
    for r in sorted(counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams")).collect(), key=lambda r: -r.n):
        held[r.lang] = held.get(r.lang, 0) + r.grams
        if held[r.lang] <= MAX_GRAMS:
            least[r.lang] = r.n
    limits = labelled.sparkSession.createDataFrame(list(least.items()), "lang string, least long")
    top = counts.join(limits, "lang").where("n >= least")
    return build([(r.lang, r.gram, r.n) for r in top.collect()], totals)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    release_kept()
    for batch in sliced(batches, "text", SLICE_BYTES):
        shares = model.shares(*byte_rows(batch))
        best = shares.argmax(axis=1) if model.languages else np.zeros(len(shares), np.int64)
        total = shares.sum(axis=1)
        lang, score = [], []
        for i, t in enumerate(texts(batch)):
            if not model.languages or not _LETTER.search(t):
                lang.append(UNDETERMINED)
                score.append(0.0)
            else:
                k = int(best[i]) if total[i] > 0 else model.default
                lang.append(model.languages[k])
                score.append(float(shares[i, k] / total[i]) if total[i] > 0 else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    `und` with score 0 if the text is null or has no letter. The score is the language's part of all languages' corrected shares;
    a text without any known n-gram gets the commonest language with score 0. Rows that repeat are predicted alike; an empty
    table gives an empty result, an empty training table `und` for all. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, model), "doc_id long, lang_pred string, score double")


def _accepted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    release_kept()
    for batch in sliced(batches, "text", SLICE_BYTES):
        asked = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])
        found = next(_predict(iter([asked]), model)) if batch.num_rows else asked
        yield batch.filter(pa.array([x != UNDETERMINED for x in found.column("lang_pred").to_pylist()], pa.bool_()))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text has a language, with all their columns (whatever their names); those that predict() calls `und` go: null
    and empty texts and those without a letter. Rows that repeat stay or go alike, texts of any length are read whole; an empty
    table gives an empty result, a model without languages an empty one too."""
    return docs.mapInArrow(lambda it: _accepted(it, model), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
