"""Token-id shards: equality with the tokenizers library, lookups, round trip."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import sstable
from sparkloom.llm.common import scratch, write_bytes
from sparkloom.llm.tokens import library_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def expected(rows, tokenizer):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_encode_like_whole_texts(tokenizer):
    rng = np.random.default_rng(5)
    alphabet = list(" \n\t\r \x1c\x85　ab'sé1,.!\x00​Z") + ["  ", " \n", "<|endoftext|>", "'s ", "日本", "́", "²"]
    made = ["".join(rng.choice(alphabet, rng.integers(0, 16))) for _ in range(3000)]
    got = library_encoder(PATH).of_texts(made)
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in made]


def test_whole_table(spark, sf, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r)[:4] for r in sstable.op2_sstable(spark, sf).collect()]
    assert sorted(got) == expected(rows, tokenizer)


def test_edge_cases(spark, tokenizer):
    rows = [(5, None), (-3, ""), (2, "a b"), (7, "x y " * 100_000), (None, "n"), (1 << 62, "big")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = [tuple(r) for r in sstable.read_shards(sstable.write_shards(docs, scratch(spark, "t"), PATH, shard_bytes=1)).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows, tokenizer)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    assert sorted(r.start for r in sstable.read_shards(sstable.write_shards(twice, scratch(spark, "t"), PATH)).collect()) == [0, 2, 4]
    assert sstable.read_shards(sstable.write_shards(docs.limit(0), scratch(spark, "t"), PATH)).count() == 0


def test_lookup(tmp_path):
    ids = list(range(-500, 100_000, 7))
    out = io.BytesIO()
    close, out.close = out.close, lambda: None
    writer = sstable.ShardWriter(out)
    for i in ids:
        writer.add(sstable.key_of(i), np.array([i & 255, 2], "<u2"))
    writer.close()
    write_bytes(str(tmp_path / "s" / "x.sst"), out.getvalue())
    close()
    shard = sstable.ShardReader(str(tmp_path / "s" / "x.sst"))
    assert len(shard.index) > 1 and shard.docs == len(ids)
    for i in [*ids[::101], ids[0], ids[-1]]:
        assert shard.get(i).tolist() == [i & 255, 2]
    assert all(shard.get(i) is None for i in (-501, 1, 100_000, 1 << 40, None))
    assert [sstable.id_of(k) for k, _ in shard.scan()] == ids
