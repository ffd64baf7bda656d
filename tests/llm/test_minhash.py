"""Near duplicates by Jaccard similarity against an all-pairs search over sets of words."""

import random

import corpus_pipeline
import numpy as np

from sparkloom.llm import minhash
from sparkloom.llm.components import forest


def words_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Kept ids: of texts linked by Jaccard >= 0.8 the smallest."""
    sets, comp = {i: words_of(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in sets:
        for y in sets:
            if x < y and (sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])):
                a, b = sorted((root(x), root(y)))
                comp[b] = a
    return {i: root(i) for i in comp}


def made(seed=7):
    """Texts of 60 words, each with copies of which one to three words differ; some copies only link by way of others."""
    rng, rows = random.Random(seed), []
    for _ in range(40):
        text = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(4):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(60)] = f"x{rng.randrange(5000)}"
    group = [f"g{i}" for i in range(60)]
    for _ in range(60):  # one large group, in buckets longer than SHORT
        text = list(group)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(60)] = f"y{rng.randrange(5000)}"
        rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(900, "one two"), (901, "One  two"), (902, "three"), (903, ""), (904, None)]


def test_matches_all_pairs(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.jaccard_components(docs).collect()}
    assert got == brute(made())
    assert len(set(got.values())) < len(got) - 60


def test_stage_drops_near_copies(spark, sf):
    """A copy with one word of 60 changed (Jaccard 51/61 = 0.836) goes; one of 0.778 stays."""
    base = [f"w{i}" for i in range(60)]
    near, far = [*base], [*base]
    near[30], far[20], far[27] = "other", "some", "other"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()) == [1, 3]


def test_recall_at_the_threshold():
    rng, missed = np.random.default_rng(3), 0
    for _ in range(300):
        both = rng.integers(0, 2**64, 180, dtype=np.uint64)  # 160 of 200 are shared: 0.8
        a, b = np.unique(np.r_[both[:160], both[160:]]), np.unique(np.r_[both[:160], rng.integers(0, 2**64, 20, dtype=np.uint64)])
        assert 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
        marks = np.frombuffer(minhash.sketch(a) + minhash.sketch(b), np.uint64).reshape(2, 4)
        assert minhash._near(np.array([180, 180]), marks, np.array([0]), np.array([1]))[0]
        missed += not (minhash.band_keys(a) == minhash.band_keys(b)).any()
    assert missed == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "quite different words here"), (None, "zz"), (5, "Quite different words here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in minhash.jaccard_components(docs).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (3, 3), (5, 3)]
    assert minhash.jaccard_components(docs.limit(0)).count() == 0


def test_group_of_many_near_copies(spark):
    """2,600 sets in long buckets of one group, in several parts, and 40 that only just belong to it: components as by brute force."""
    rng, base = random.Random(3), [f"g{i}" for i in range(60)]
    rows = []
    for k in range(2640):
        text = list(base)
        for _ in range(1 if k < 2600 else 2):
            text[rng.randrange(60)] = f"z{k}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.jaccard_components(docs).collect()}
    sets = [words_of(t) for _, t in rows]
    order = {w: i for i, w in enumerate({w for s in sets for w in s})}
    m = np.zeros((len(rows), len(order)), np.float32)
    for i, s in enumerate(sets):
        m[i, [order[w] for w in s]] = 1
    shared, n = m @ m.T, m.sum(axis=1)
    a, b = np.nonzero(np.triu(9 * shared >= 4 * (n[:, None] + n[None, :]), 1))
    want = {i: i for i in range(len(rows))} | dict(zip(*map(np.ndarray.tolist, forest(a, b)), strict=True))
    assert got == want


def test_parts_compare_sides_only():
    n, marks = np.full(6, 10), np.zeros((6, 4), np.uint64)
    label, side = np.array([1, 2, 1, 2, 3, 3]), np.array([0, 0, 1, 1, 2, 2])
    key = np.array([5, 5, 5, 5, 6, 6])
    got = {(i, j) for a, b in minhash._part_pairs(key, n, marks, label, side) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(0, 3), (1, 2)}
