"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sparkloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(lines), special_tokens={})


def test_ids_equal_the_library_s(library):
    rng = np.random.default_rng(3)
    made = ["".join(map(chr, rng.choice([*range(32, 127), 10, 9, 0xE9, 0x4E2D, 0x1F600, 0x301], rng.integers(0, 40)))) for _ in range(2000)]
    made += ["a" * 3000, "ab" * 700, "thethethe" * 100, "é" * 999, " " * 500, "\n" * 300 + "x", "!" * 700, "0123456789" * 90]
    got = bpe.matrix_encoder(PATH, PATTERN)[0].of_texts(made)
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in made]


def test_long_and_short_merges_agree(library):
    own = bpe.matrix_encoder(PATH, PATTERN)[1]
    rng = np.random.default_rng(4)
    pieces = [bytes(rng.choice(list(b"theandionr"), rng.integers(2, 200)).astype(np.uint8)) for _ in range(300)]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode_pieces(pieces)] == [own._merge_long(p) if p not in own.ranks else [own.ranks[p]] for p in pieces]


def test_whole_table(spark, sf, library):
    for r, got in zip(spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), bpe.op7_bpe(spark, sf).orderBy("doc_id").collect(), strict=True):
        ids = library.encode_ordinary(r.text)
        assert (got.doc_id, got.n_tokens) == (r.doc_id, len(ids))
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word\n" * 100_000), (3, "word\n" * 100_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(((r.doc_id or 0), r.decoded) for r in back) == sorted(((i or 0), (t or "").encode()) for i, t in rows)
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
