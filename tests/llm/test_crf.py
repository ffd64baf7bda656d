"""The conditional random field: marginals against enumeration, features, held-out accuracy."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from sparkloom.llm import crf
from sparkloom.llm.common import byte_rows


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 3]
    by_doc = np.r_[0, np.cumsum(sizes)]
    scores, pairs = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    marginal, joint, last = crf.forward_backward(scores, pairs, by_doc)
    want_joint = np.zeros((2, 2))
    for d, n in enumerate(sizes):
        s = scores[by_doc[d] : by_doc[d + 1]]
        weights = {y: np.exp(sum(s[t, y[t]] for t in range(n)) + sum(pairs[y[t - 1], y[t]] for t in range(1, n))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        assert np.isclose(last[d], np.log(z))
        for t in range(n):
            assert np.isclose(marginal[by_doc[d] + t, 1], sum(w for y, w in weights.items() if y[t]) / z)
        for y, w in weights.items():
            for t in range(1, n):
                want_joint[y[t - 1], y[t]] += w / z
    assert np.allclose(joint, want_joint)


def test_features():
    texts = ["The cat sat.\nAB!! CD!!\nab ab ab ab\nab ab ab ab", "", None, "x\n\ny"]
    f, length, by_doc = crf.line_features(*byte_rows(pa.RecordBatch.from_pydict({"text": pa.array(texts)})))
    name = {x: i for i, x in enumerate(crf.FEATURES)}
    assert by_doc.tolist() == [0, 4, 5, 6, 9] and length.tolist() == [12, 9, 11, 11, 0, 0, 1, 0, 1]
    assert np.isclose(f[1, name["upper"]], 4 / 9) and np.isclose(f[1, name["symbols"]], 4 / 9) and f[1, name["symbol words"]] == 1
    assert f[2, name["word repeats"]] == 0.75 and f[2, name["word variety"]] == 0.25 and f[0, name["word variety"]] == 1
    assert f[:, name["line repeats"]].tolist() == [0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert f[:, name["blank"]].tolist() == [0, 0, 0, 0, 1, 1, 0, 1, 0]
    x = crf.with_neighbours(f, by_doc)
    k = len(crf.FEATURES)
    assert (x[1, k : 2 * k] == f[0]).all() and (x[1, 2 * k : 3 * k] == f[2]).all() and not x[4, k : 3 * k].any()


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = crf.op4_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.95 * len(out)


def test_edge_cases(spark):
    rows = [(1, "A fine sentence here.\nAnd another one.", 1), (2, "BUY!! NOW!! BUY!! NOW!!", 0), (3, None, None), (4, "", 1), (None, "x", None), (5, "line\n" * 100_000, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, quality int, score string")
    model = crf.fit(docs.select("doc_id", "text", "quality"))
    got = {r.doc_id: r.score for r in crf.score(docs, model).collect()}
    assert len(got) == 6 and got[1] > 0.5 > got[2] and got[3] == got[4]
    assert crf.score(docs.limit(0), model).count() == 0
    assert all(abs(r.score - 0.5) < 1e-6 for r in crf.score(docs, crf.fit(docs.limit(0).select("doc_id", "text", "quality"))).collect())


def test_strides_carry_messages():
    """Chains of several strides against the plain recursion, line by line."""
    rng = np.random.default_rng(1)
    n = 3 * crf.STRIDE + 40
    by_doc, scores, pairs = np.array([0, n - 60, n - 59, n]), rng.normal(size=(n, 2)) * 3, rng.normal(size=(2, 2))
    marginal, _, last = crf.forward_backward(scores, pairs, by_doc)
    for d, (i, j) in enumerate(itertools.pairwise(by_doc)):
        a, b = np.zeros((j - i, 2)), np.zeros((j - i, 2))
        a[0] = scores[i]
        for t in range(1, j - i):
            a[t] = scores[i + t] + np.logaddexp.reduce(a[t - 1][:, None] + pairs, axis=0)
        for t in range(j - i - 2, -1, -1):
            b[t] = np.logaddexp.reduce(pairs + (scores[i + t + 1] + b[t + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(a[-1])
        assert np.isclose(last[d], z) and np.allclose(marginal[i:j], np.exp(a + b - z), atol=1e-9)


def test_four_megabytes_of_newlines():
    """Linear in lines: a few seconds of CPU, where a step per line took minutes; and pieces of lines score as one."""
    import time

    rng = np.random.default_rng(2)
    model = crf.Model(rng.normal(size=(3 * len(crf.FEATURES) + 1, 2)), rng.normal(size=(2, 2)), (1.0, 0.0))
    data, began = np.full(4 << 20, 10, np.uint8), time.process_time()
    (score,) = model.scores(data, np.array([0, len(data)]))
    assert 0 <= score <= 1 and time.process_time() - began < 10
    text = np.frombuffer("\n".join(f"line {i % 7} of Many, words {i}" for i in range(3 * crf.PIECE_LINES // 2)).encode(), np.uint8)
    f, length, by_doc = crf.line_features(text, np.array([0, len(text)]))
    q = model.raw(crf.with_neighbours(f, by_doc), length, by_doc)
    assert np.allclose(model.scores(text, np.array([0, len(text)])), 1 / (1 + np.exp(-np.log(q / (1 - q)))))
