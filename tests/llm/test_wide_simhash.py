"""SimHash candidates for Jaccard >= 0.8 against all pairs, and the pipeline's use of them."""

import random

import corpus_pipeline
import numpy as np
import pytest

from sparkloom.llm import minhash, wide_simhash

from . import test_minhash


def ones_by_hand(grams):
    """Sums of +1 and -1 of SplitMix64's bits, then the sign of two positions turned into each other."""
    sums = []
    for seed in wide_simhash._SEEDS.tolist():
        words = []
        for g in grams.tolist():
            z = (g + seed) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            words.append((z ^ z >> 31).to_bytes(8, "little"))
        sums += [sum(1 if w[k] >> 7 - b & 1 else -1 for w in words) for k in range(8) for b in range(8)]
    half = len(sums) // 2
    bits = [2 * x + y > 0 for x, y in zip(sums[:half], sums[half:])] + [2 * y - x > 0 for x, y in zip(sums[:half], sums[half:])]
    return bytes(sum(bit << 7 - k for k, bit in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("n", [0, 1, 4, 300])
def test_fingerprint_by_hand(n):
    grams = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    got = wide_simhash.fingerprint(grams)
    assert got == ones_by_hand(grams) and len(got) == 2 * wide_simhash.GROUPS


def test_keys_name_group_and_bytes():
    prints = np.arange(2 * 2 * wide_simhash.GROUPS).astype(np.uint8).reshape(2, -1)
    keys = wide_simhash.position_keys(prints)
    assert keys[0, :2].tolist() == [1, 1 << 16 | 2 << 8 | 3] and keys.shape == (2, wide_simhash.GROUPS) and len(np.unique(keys)) == keys.size


@pytest.mark.parametrize("sizes", [(4, 5, 4), (9, 9, 8), (18, 18, 16), (180, 180, 160), (160, 200, 160), (900, 900, 800)])
def test_recall_at_the_threshold(sizes):
    rng, (a, b, shared), agreed = np.random.default_rng(3), sizes, 0
    for _ in range(200):
        of = rng.integers(0, 2**64, a + b - shared, dtype=np.uint64)
        assert 9 * shared >= 4 * (a + b)
        prints = np.stack([np.frombuffer(wide_simhash.fingerprint(x), np.uint8) for x in (of[:a], of[a - shared :])])
        keys = wide_simhash.position_keys(prints)
        assert (keys[0] == keys[1]).any()
        assert wide_simhash.counted(None, wide_simhash.first_bits(prints), np.array([0]), np.array([1]))[0]
        agreed += (keys[0] == keys[1]).mean() / 200
    assert agreed > (0.05 if sizes == (4, 5, 4) else 0.065)


def test_unrelated_sets_are_dropped():
    rng = np.random.default_rng(4)
    prints = np.stack([np.frombuffer(wide_simhash.fingerprint(rng.integers(0, 2**64, 40, dtype=np.uint64)), np.uint8) for _ in range(400)])
    i, j = np.triu_indices(400, 1)
    assert wide_simhash.counted(None, wide_simhash.first_bits(prints), i, j).mean() < 1e-4
    same = (wide_simhash.position_keys(prints)[i[:20000]] == wide_simhash.position_keys(prints)[j[:20000]]).mean()
    assert same < 3 / 65536


def test_matches_all_pairs(spark):
    docs = spark.createDataFrame(test_minhash.made(), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in wide_simhash.near_components(docs).collect()}
    assert got == test_minhash.brute(test_minhash.made())


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "quite different words here"), (None, "zz"), (5, "Quite different words here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in wide_simhash.near_components(docs).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (3, 3), (5, 3)]
    assert wide_simhash.near_components(docs.limit(0)).count() == 0


def test_stage_takes_its_candidates_from_simhash(spark, sf, monkeypatch):
    """With an index whose postings bring no two sets together the stage finds no copy: nothing beside it does."""
    base = [f"w{i}" for i in range(60)]
    near = [*base]
    near[30] = "other"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()] == [1]

    def apart(prints):
        return np.unique(prints, axis=0, return_inverse=True)[1].reshape(-1, 1) + np.int64(prints.astype(np.int64).sum()) * 1000

    def alone(n, marks, i, j):
        return np.zeros(len(i), np.bool_)

    monkeypatch.setattr(wide_simhash, "SIMHASH", wide_simhash.SIMHASH._replace(keys=apart, near=alone))
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()) == [1, 2]


def test_group_of_many_near_copies(spark):
    """1,300 sets that share long postings in several parts, and 40 that only just belong to them: components as by brute force."""
    rng, base = random.Random(3), [f"g{i}" for i in range(60)]
    rows = []
    for k in range(1340):
        text = list(base)
        for _ in range(1 if k < 1300 else 2):
            text[rng.randrange(60)] = f"z{k}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in wide_simhash.near_components(docs).collect()}
    sets = [test_minhash.words_of(t) for _, t in rows]
    order = {w: i for i, w in enumerate({w for s in sets for w in s})}
    m = np.zeros((len(rows), len(order)), np.float32)
    for i, s in enumerate(sets):
        m[i, [order[w] for w in s]] = 1
    shared, n = m @ m.T, m.sum(axis=1)
    a, b = np.nonzero(np.triu(9 * shared >= 4 * (n[:, None] + n[None, :]), 1))
    want = {i: i for i in range(len(rows))} | dict(zip(*map(np.ndarray.tolist, test_minhash.forest(a, b)), strict=True))
    assert got == want


@pytest.mark.parametrize("others", [0, 400, 1200])
def test_long_postings(others):
    """Pairs of postings of up to PART sets are all compared unless many are left; else the key is told, and a chain kept."""
    rng = np.random.default_rng(6)
    marks = rng.integers(0, 2**64, (others + 40, 2), dtype=np.uint64)
    marks[[5, others + 30]] = 7
    pairs, long = minhash._bucket_pairs(np.ones(others + 40, np.int64), None, marks, wide_simhash.counted)
    got = {(i, j) for a, b in pairs for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert ((5, others + 30) in got) == (others < 1000) and long.tolist() == ([] if others < 1000 else [1])
    same = np.zeros((300, 2), np.uint64)
    pairs, long = minhash._bucket_pairs(np.ones(300, np.int64), None, same, wide_simhash.counted)
    assert long.tolist() == [1] and {(0, 1), (0, 2), (298, 299)} <= {(i, j) for a, b in pairs for i, j in zip(a.tolist(), b.tolist(), strict=True)}
