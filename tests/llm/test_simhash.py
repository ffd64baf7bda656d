"""SimHash near duplicates against an all-pairs search."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash

from sparkloom.llm import simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    ids, comp = sorted(fps), {i: i for i in fps}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 3:
                a, b = sorted((root(x), root(y)))
                comp[b] = a
    return {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_matches_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(simhash.op9_simhash(spark, sf)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "x"), (5, "one  TWO", "x"), (6, "a", None), (7, "É é " * 9, "x"), (8, "word " * 200_000, "x"), (9, "word word word", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert result(simhash.simhash_components(docs)) == brute([r[:2] for r in rows])
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "quite different words here")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id) for r in simhash.simhash_components(docs).collect() if r.component_id)
    assert got == [(0, 3), (3, 3), (3, 3)]


def pairs_of(fp):
    return {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3}


def near_one(n, bits, first, seed=1):
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2**63))
    return np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(bits, 3, replace=False) + first) for _ in range(n)], np.uint64))


def test_pairs_of_a_posting():
    fp = near_one(600, 40, 24)
    got = {tuple(sorted(p)) for i, j in simhash._posting_pairs(np.zeros(len(fp), np.int64), fp) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == pairs_of(fp)


@pytest.mark.parametrize("rows", [7, 64, 5000])
@pytest.mark.parametrize("shared", [2, 0])
def test_long_postings_are_divided_without_loss(rows, shared, monkeypatch):
    """Level by level by hand, with a posting of 100 called long: all entries share five bytes (or three); components as by brute force."""
    monkeypatch.setattr(simhash, "LONG", 100)
    if shared:
        fp = np.array([7 | a << 40 | b << 48 | c << 56 for a in range(12) for b in range(12) for c in range(12)], np.uint64)
    else:
        fp = near_one(900, 40, 24)
    triple = 0
    octets = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
    key = (octets[:, 0] << 16 | octets[:, 1] << 8 | octets[:, 2]) + (triple << 24)
    entry, rep, links = [key, fp.view(np.int64), np.arange(len(fp))], None, set()
    for level in (1, 2, 3):
        order = np.argsort(entry[0], kind="stable")
        key, f, rep = (x[order] for x in entry)
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + rows]) for x in (key, f, rep)], names=["key", "fp", "rep"]) for i in range(0, len(key), rows)]
        out = pa.Table.from_batches(list(simhash._postings(iter(batches), level)))
        links |= {tuple(sorted(p)) for p in zip(*(out.filter(pa.compute.is_null(out["key"]))[c].to_pylist() for c in "ab"))}
        entry = [out.filter(pa.compute.is_valid(out["key"]))[c].to_numpy() for c in ("key", "a", "b")]
        assert (level == 3) == (len(entry[0]) == 0)
    got, want = (simhash.forest(*np.array(sorted(x)).T) for x in (links, pairs_of(fp)))
    assert dict(zip(*map(np.ndarray.tolist, got))) == dict(zip(*map(np.ndarray.tolist, want)))


def test_dense_posting_end_to_end(spark):
    """5,000 fingerprints that share five bytes: all their postings inside one half are long."""
    rng = np.random.default_rng(5)
    fp = np.unique(0x1122334455 | rng.integers(0, 1 << 24, 5000, dtype=np.uint64) << np.uint64(40))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    i, j = np.nonzero(np.triu(near, 1))
    want = dict(zip(*map(np.ndarray.tolist, simhash.forest(i, j))))
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate(fp.view(np.int64).tolist())], "fp long, rep long")
    got = {r.node: r.component for r in simhash.components_of(nodes).collect() if r.node != r.component}
    assert got == want and len(i) > 1000


def test_one_fingerprint_in_most_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('own words of ', id, ' only', id), 'the same text again') AS text")
    got = result(simhash.simhash_components(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
