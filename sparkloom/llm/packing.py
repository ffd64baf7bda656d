"""Lexical retrieval packing: sequences of at most 2048 tokens from documents that are lexical neighbours.

A document longer than a window fills windows of its own (WHOLE_WINDOWS), and its rest is packed like any other; so long documents
don't travel, and no task gets more than a window's tokens of any of them. Its terms do travel: it is routed, indexed and asked for
by those of the whole document. Two min-hashes of all its tokens route a document to a shard, a range of the routing order bounded
in tokens and postings; near texts meet in a shard, and a text that many rows hold spreads over as many shards as it fills.
Every shard has an inverted BM25 index over all of its documents, with document frequencies and lengths of the whole corpus. The
first document of a window is its seed: its terms are looked up, the heaviest first, and unused neighbours fill the window in the
order of their scores, the last one cut where the window ends; its rest is the seed of the next window. Lighter terms are asked when
no unused document has a heavier one, so no document that shares any term is passed over for one that shares none. What is left at
the end of a shard is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_rows, byte_rows, give_back, materialize, release_kept, sliced, table
from sparkloom.llm.tokens import library_encoder

WINDOW = 2048
END_ID = 1
#: Do full windows of long documents go out alone? (Else every document travels whole.)
WHOLE_WINDOWS = True
SHARD_TOKENS = 2 << 20
#: Rows of whole texts that a worker gets at a time, and bytes of them that are encoded at a time.
BATCH_ROWS, SLICE_BYTES = 2000, 1 << 18
#: BM25; a seed's terms are asked QUERY_TERMS at a time by falling weight, its neighbours NEIGHBOURS at a time.
K1, B, QUERY_TERMS, NEIGHBOURS = 1.2, 0.75, 24, 32
#: Tasks in which document frequencies meet before the driver adds them (as many numbers each as the vocabulary has).
STAT_TASKS = 32
TOKENS = "doc_id long, ids binary, terms binary, counts binary, start long, doc_tokens long, route long, ids_crc32 long, sequence_id long, stats binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _hash_tables(vocabulary: int) -> np.ndarray:
    x = np.arange(vocabulary, dtype=np.uint64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = (x + np.uint64(1)) * np.uint64(salt)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(33)).astype(np.int64))
    return np.stack(out)


def _tokens(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """A row with ids for each document's rest (and the terms of the whole, if that is longer), one with a sequence for each window
    that it fills alone, and at the end one with the task's document frequencies, documents and tokens."""
    from pyspark import TaskContext

    encoder = library_encoder(tokenizer)
    hashes = _hash_tables(encoder.vocabulary)
    stats = np.zeros(encoder.vocabulary + 2, np.int64)
    sequence = 1 << 62 | TaskContext.get().partitionId() << 32  # apart from the shards' numbers
    kinds = (pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 5, pa.binary())
    end = np.array([END_ID], encoder.kind)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])

    give_back()
    for batch in sliced(batches, "text", SLICE_BYTES):
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(*byte_rows(batch)), strict=True):
            x = np.concatenate([ids, end])
            terms = np.sort(x)
            first = np.concatenate([[True], terms[1:] != terms[:-1]])
            terms = terms[first]
            stats[terms] += 1
            stats[-2:] += 1, len(x)
            full = len(x) // WINDOW * WINDOW if WHOLE_WINDOWS else 0
            for start in range(0, full, WINDOW):
                rows.append((doc_id, None, None, None, start, len(x), None, zlib.crc32(x[start : start + WINDOW].astype("<u4").tobytes()), sequence, None))
                sequence += 1
            if full < len(x):
                a, b = hashes[:, terms].min(axis=1).tolist()
                whole = (terms.tobytes(), np.diff(np.flatnonzero(np.r_[first, True])).astype("<u4").tobytes()) if full else (None, None)
                rows.append((doc_id, x[full:].tobytes(), *whole, full, len(x), a << 31 | b, None, None, None))
        yield out(rows)
    if stats[-2]:
        yield out([(*[None] * 9, stats.tobytes())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("stats").to_pylist():
            x = np.frombuffer(x, np.int64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["stats"])


class Shard:
    """The inverted index of a shard's documents. Of documents given in part, whole has (terms, counts, length) of all of it."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, whole: dict[int, tuple[np.ndarray, np.ndarray, int]] | None = None):
        n, whole = len(docs), whole or {}
        own = np.array([i for i in range(n) if i not in whole], np.int64)
        lengths = np.array([whole[i][2] if i in whole else len(x) for i, x in enumerate(docs)], np.int64)
        key = np.repeat(own, lengths[own]) << 32 | np.concatenate([np.zeros(0, np.int64), *(docs[i] for i in own.tolist())])
        key.sort()
        starts = np.flatnonzero(np.r_[np.ones(min(1, len(key)), np.bool_), key[1:] != key[:-1]])
        tf, key = np.diff(np.r_[starts, len(key)]), key[starts]
        if whole:
            key = np.concatenate([key, *(i << 32 | terms.astype(np.int64) for i, (terms, _, _) in whole.items())])
            order = np.argsort(key, kind="stable")
            key, tf = key[order], np.concatenate([tf, *(counts.astype(np.int64) for _, counts, _ in whole.values())])[order]
        doc, term, tf = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), tf.astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        self.by_doc, self.doc_terms, self.doc_weights = np.searchsorted(doc, np.arange(n + 1)), term, weight.astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.posted_docs, self.posted_weights = doc[order], self.doc_weights[order]
        self.by_term = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.used, self.left = np.zeros(n, np.bool_), n

    def use(self, doc: int) -> None:
        self.left -= not self.used[doc]
        self.used[doc] = True

    def query(self, seed: int, tier: int) -> np.ndarray:
        """The seed's terms number tier x QUERY_TERMS and on, by falling weight; none after the last."""
        span = slice(self.by_doc[seed], self.by_doc[seed + 1])
        terms, heavy = self.doc_terms[span], -self.doc_weights[span]
        if tier == 0:
            return terms[np.argpartition(heavy, QUERY_TERMS)[:QUERY_TERMS]] if len(terms) > QUERY_TERMS else terms
        first = np.argpartition(heavy, QUERY_TERMS)[:QUERY_TERMS] if len(terms) > QUERY_TERMS else np.arange(len(terms))
        rest = np.delete(np.arange(len(terms)), first)
        rest = rest[np.argsort(heavy[rest], kind="stable")]
        return terms[rest[(tier - 1) * QUERY_TERMS : tier * QUERY_TERMS]]

    def neighbours(self, seed: int, tier: int = 0) -> tuple[list[int], int]:
        """(unused documents by falling score against a tier of the seed's terms, ties by position; the tier): the first tier from the
        given one on whose terms any unused document has; empty when none has."""
        while self.left and len(terms := self.query(seed, tier)):
            spans = [slice(self.by_term[t], self.by_term[t + 1]) for t in terms.tolist()]
            docs = np.concatenate([self.posted_docs[s] for s in spans])
            scores = np.bincount(docs, np.concatenate([self.posted_weights[s] for s in spans]), len(self.used))
            scores[self.used] = 0
            found = np.flatnonzero(scores)
            if len(found) > NEIGHBOURS:
                found = np.sort(found[np.argpartition(-scores[found], NEIGHBOURS)[:NEIGHBOURS]])
            if len(found):
                return found[np.argsort(-scores[found], kind="stable")].tolist(), tier
            tier += 1
        return [], tier


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW, whole: dict[int, tuple[np.ndarray, np.ndarray, int]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0 and are full or powers of two."""
    shard, pieces, sequence = Shard(docs, idf, mean, whole), [], 0
    open_: list[tuple[int, int, int]] = []
    fill, seed, ranked, tier, turn = 0, None, None, 0, 0

    def place(doc: int) -> None:
        nonlocal fill, seed, ranked, sequence
        shard.use(doc)
        start, n = 0, len(docs[doc])
        while start < n:
            if fill == 0:
                seed, ranked = doc, None
            take = min(n - start, window - fill)
            open_.append((doc, start, take))
            fill, start = fill + take, start + take
            if fill == window:
                sequence = close(sequence)

    def close(at: int) -> int:
        """Deals the open pieces to sequences: one full window, or powers of two by falling size."""
        nonlocal fill
        for size in [window] if fill == window else [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]:
            offset = 0
            while offset < size:
                doc, start, n = open_.pop(0)
                take = min(n, size - offset)
                pieces.append((doc, start, take, at, offset))
                offset += take
                if take < n:
                    open_.insert(0, (doc, start + take, n - take))
            at += 1
        fill = 0
        return at

    while shard.left:
        chosen = None
        if fill:
            if ranked is None:
                ranked, tier = shard.neighbours(seed)
            while ranked and chosen is None:
                x = ranked.pop(0)
                chosen = None if shard.used[x] else x
            if chosen is None:  # more were wanted
                ranked, tier = shard.neighbours(seed, tier)
                if ranked:
                    continue
        if chosen is None:
            while shard.used[turn]:
                turn += 1
            chosen = turn
        place(chosen)
    close(sequence)
    return pieces


def _pack(batches: Iterator[pa.RecordBatch], stats: bytes, kind: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    release_kept()
    numbers = np.frombuffer(stats, np.int64)
    df, n, tokens = numbers[:-2].astype(np.float64), numbers[-2], numbers[-1]
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), tokens / max(n, 1)
    base, held, whole, of, size = TaskContext.get().partitionId() << 32, [], {}, [], 0

    def packed():
        nonlocal base
        found = pack_shard(held, idf, mean, whole=whole)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*found, strict=True))
        crc = [zlib.crc32(held[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        ids, before, tokens_of = zip(*(of[d] for d in doc.tolist()), strict=True)
        out = [pa.array(ids, pa.int64()), pa.array(start + np.array(before)), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens_of, pa.int64()), pa.array(sequence + base), pa.array(offset)]
        base += int(sequence.max()) + 1
        return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in PIECES.split(", ")])

    for batch in batches:
        for x, terms, counts, *row in zip(*(batch.column(c).to_pylist() for c in ("ids", "terms", "counts", "doc_id", "start", "doc_tokens")), strict=True):
            if terms is not None:
                whole[len(held)] = (np.frombuffer(terms, kind), np.frombuffer(counts, "<u4"), row[2])
            held.append(np.frombuffer(x, kind))
            of.append(row)
            size += max(len(held[-1]), len(terms or b"") // np.dtype(kind).itemsize)
            if size >= SHARD_TOKENS:
                yield packed()
                held, whole, of, size = [], {}, [], 0
    if held:
        yield packed()


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of every document is in exactly one piece. Null and empty texts are one token, END_ID. Rows that repeat an id are
    documents of their own, as are rows with a null id. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        encoded = materialize(rows.mapInArrow(lambda it: _tokens(it, tokenizer), TOKENS), "tokens")
    met = encoded.where("stats is not null").select("stats").repartition(STAT_TASKS).mapInArrow(_summed, "stats binary")
    total = sum(np.frombuffer(r.stats, np.int64) for r in met.collect())
    stats = total.tobytes() if isinstance(total, np.ndarray) else b""
    kind = "<u2" if len(stats) // 8 - 2 <= 1 << 16 else "<u4"
    alone = encoded.where("sequence_id is not null").select("doc_id", "start", F.lit(WINDOW).cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    rests = encoded.where("ids is not null").select("doc_id", "ids", "terms", "counts", "start", "doc_tokens", "route", (F.xxhash64("doc_id") + F.spark_partition_id()).alias("_deal"))
    # Rows that repeat an id, or have none, spread by the partition that they are read from.
    routed = rests.repartitionByRange("route", "_deal").sortWithinPartitions("route", "_deal")
    return alone.unionByName(routed.select("doc_id", "ids", "terms", "counts", "start", "doc_tokens").mapInArrow(lambda it: _pack(it, stats, kind), PIECES))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
