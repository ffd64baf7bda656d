"""Packing: every token in one piece, no padding, neighbours by BM25."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sparkloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, pieces):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0  # 2048 itself is one


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, packing.op6_packing(spark, sf).collect())


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "word " * 50_000), (5, "x y z " * 683)]
    docs = spark.createDataFrame([(*r, "q", 7) for r in rows], "doc_id long, text string, route string, offset int")
    check(rows, packing.pack(docs, PATH).collect())
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), PATH).collect()
    assert sum(p.length for p in twice) == 8


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 400, rng.integers(5, 60)).astype(np.uint16) for _ in range(200)]
    df = np.zeros(1 << 16)
    for x in docs:
        df[np.unique(x)] += 1
    idf = np.log1p((200 - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = np.mean([len(x) for x in docs])
    shard = packing.Shard(docs, idf, mean)
    shard.used[::3] = True

    def weight(t, x):
        tf = (x == t).sum()
        return idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))

    seed = 7
    terms = sorted(set(docs[seed].tolist()), key=lambda t: -weight(t, docs[seed]))[: packing.QUERY_TERMS]
    scores = {i: sum(weight(t, x) for t in terms) for i, x in enumerate(docs) if not shard.used[i]}
    best = sorted(scores.values(), reverse=True)[:10]
    assert np.allclose([scores[i] for i in shard.neighbours(seed)[0][:10]], best, rtol=1e-4)


def test_lighter_terms_are_asked_when_the_heavier_have_no_one(monkeypatch):
    """A document that shares any term with the seed is taken before those that share none; and long documents are asked for by all their terms."""
    monkeypatch.setattr(packing, "QUERY_TERMS", 3)
    idf = np.linspace(5, 0.1, 500).astype(np.float32)
    docs = [np.arange(0, 30, dtype=np.uint16), np.arange(100, 130, dtype=np.uint16), np.r_[200:229, 29].astype(np.uint16), np.arange(300, 330, dtype=np.uint16)]
    order = [p[0] for p in packing.pack_shard(docs, idf, 30.0, window=64)]
    assert order[:2] == [0, 2]
    whole = {3: (np.r_[5, 300:400].astype(np.uint16), np.ones(101, np.uint32), 400)}
    shard = packing.Shard(docs, idf, 30.0, whole)
    assert set(shard.neighbours(0)[0]) == {0}  # itself, not yet used
    shard.use(0)
    found, tier = shard.neighbours(0)
    assert found == [3] and tier == 1
    shard.use(3)
    assert shard.neighbours(0, tier)[0] == [2]


def test_rows_that_repeat_are_spread(spark):
    docs = spark.range(600).selectExpr("cast(if(id % 2 = 0, 7, null) AS long) AS doc_id", "'the same words in every row of this table' AS text").repartition(8)
    got = packing.pack(docs, PATH).collect()
    assert sum(p.start == 0 for p in got) == 600 and sum(p.length for p in got) == sum(p.doc_tokens for p in got if p.start == 0)


def test_workers_hold_little_of_their_texts(spark, monkeypatch):
    """Few rows come to a worker at a time and few bytes are encoded at a time; the session's setting stays as it was."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(packing, "materialize", lambda df, label, f=packing.materialize: (seen.append(int(spark.conf.get(key))), f(df, label))[1])
    was = spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    check([(i, f"text number {i}") for i in range(50)], packing.pack(docs, PATH).collect())
    assert seen and max(seen) <= 2000 and spark.conf.get(key) == was

    class Encoder:
        vocabulary, kind, given = 10, np.dtype("<u2"), []

        def ids(self, data, offsets):
            self.given.append(len(data))
            return [np.full(max(b - a, 1), 3, "<u2") for a, b in zip(offsets, offsets[1:])]

    monkeypatch.setattr(packing, "library_encoder", lambda path: Encoder())
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": ["x" * 2000] * 1000})
    out = list(packing._tokens(iter([batch]), "any"))
    assert sum(Encoder.given) == 2_000_000 and max(Encoder.given) <= 1 << 18
    assert sum(b.num_rows - b.column("doc_id").null_count for b in out) == 1000
