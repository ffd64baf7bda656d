"""The epsilon grid order join against all pairs."""

import numpy as np

from sparkloom.llm import ego_join


def brute(rows, cosine=0.9):
    good = {}
    for k, (i, e) in enumerate(rows):
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, np.float64)
            good[k] = v / np.linalg.norm(v)
    near = {k: {m for m in good if m != k and len(good[k]) == len(good[m]) and good[k] @ good[m] >= cosine} for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        comp = None if i is None else min(rows[m][0] for m in seen)
        out.append((i, len(near.get(k, ())), comp, i is not None and comp == i))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_small_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(ego_join.op1_near_vectors(spark, sf)) == brute(rows)


def test_clusters_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12))
    rows = [(int(i), (centres[rng.integers(30)] + rng.normal(size=12) * rng.choice([0.05, 0.4])).astype(np.float32).tolist()) for i in rng.permutation(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(ego_join.near_vectors(df)) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0]), (10, []), (None, [1.0, 1.0]), (11, [-1.0, -1.0]), (12, [1e-30, 1e-30]), (6, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, n int, rep int")
    assert result(ego_join.near_vectors(df)) == brute(rows)
    assert ego_join.near_vectors(df.limit(0)).count() == 0


def test_malformed_rows_leave_others_alone(spark):
    """A wider row with a null, other dimensions, an exact 0.9, negative zero, huge and tiny vectors."""
    rows = [(1, [1.0, 0.01]), (2, [1.0, 0.0]), (3, [None, 1.0, 2.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.1, 3.0]), (6, [1.0, 0.0, 0.0, 0.0, 0.0]), (7, [9.0, 4.0, 1.0, 1.0, 1.0]), (8, [1.0, -0.0]), (9, [1e200, 1e200, 0.0]), (10, [1e-300, 1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ego_join.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (2, 1), 9: (1, 9), 10: (1, 9)}


def test_tree_of_intervals_finds_all_near_pairs(spark):
    rng = np.random.default_rng(4)
    low = rng.uniform(-1, 1, (150, ego_join.LEADING))
    rows = [(k // 40, k % 40, f"f{k}", 1, low[k].tolist(), (low[k] + 0.3).tolist()) for k in range(150)]
    got = [tuple(r) for r in ego_join.near_intervals(spark.createDataFrame(rows, ego_join.INTERVALS), 0.5).collect()]
    want = {(f"f{i}", f"f{j}") for i in range(150) for j in range(i, 150) if ego_join.box_gap(low[i], low[i] + 0.3, low[j], low[j] + 0.3) <= 0.5}
    assert len(got) == len(set(got)) and set(got) == want and 150 < len(want) < 9000


def test_one_vector_in_a_third_of_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(ego_join.near_vectors(df)) == brute(rows)


def test_distant_blocks_are_skipped_and_none_is_lost():
    rng = np.random.default_rng(1)

    class Boxes:
        def __init__(self, n):
            x = np.sort(rng.uniform(-1, 1, (n, 3)), axis=0)
            self.low, self.high, self.sizes = x, x + 0.05, np.ones(n)

    a, b = Boxes(20), Boxes(33)
    want = {(i, j) for i in range(20) for j in range(33) if ego_join.box_gap(a.low[i], a.high[i], b.low[j], b.high[j]) <= 0.3}
    assert set(ego_join.near_blocks(a, b, False, 0.3)) == want and len(want) < 660
    assert set(ego_join.near_blocks(a, a, True, 3.0)) == {(i, j) for i in range(20) for j in range(i, 20)}
