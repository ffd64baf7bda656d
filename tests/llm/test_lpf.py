"""Repeated passages and longest previous factors against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import lpf


def brute(rows, least=200, keep_first=False):
    data = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    where = Counter()
    first = {}
    for i, b in data:
        for q in range(len(b) - least + 1):
            w = b[q : q + least]
            where[w] += 1
            first.setdefault(w, (i, q))
    out = {}
    for i, b in data:
        gone = np.zeros(len(b) + 1, np.bool_)
        for q in range(len(b) - least + 1):
            w = b[q : q + least]
            if where[w] > 1 and not (keep_first and first[w] == (i, q)):
                gone[q : q + least] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-1]][: len(b)]).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_previous_factors():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 370)
    got, source = lpf.SuffixOrder(text, starts, 21).previous_factors()

    def common(a, b):
        n = 0
        while n < 21 and text[a + n] == text[b + n]:
            n += 1
        return n

    want = [max((common(i, j) for j in range(i)), default=0) for i in starts.tolist()]
    assert got.tolist() == want
    assert all(common(i, s) == n for i, s, n in zip(starts.tolist(), source.tolist(), want, strict=True) if n)


def test_smaller_neighbours():
    p = np.random.default_rng(1).permutation(300)
    assert lpf.smaller_before(p).tolist() == [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(300)]
    assert lpf.smaller_after(p).tolist() == [min((j for j in range(i + 1, 300) if p[j] < p[i]), default=-1) for i in range(300)]


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(lpf.op5_repeats(spark, sf)) == brute(rows)


@pytest.mark.parametrize("hot", [2000, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_made_repeats(spark, hot, keep_first, monkeypatch):
    rng = np.random.default_rng(7)

    def made(n, letters="abcdé "):
        return "".join(rng.choice(list(letters), n))

    passage, long = made(150), made(600)
    rows = [(i, made(int(rng.integers(0, 90))) + (passage if i % 3 else long) + made(int(rng.integers(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "xy" * 2000), (103, "z" * 39), (104, "z" * 40), (105, "z" * 41), (106, long[:300] + "!" + long[301:]), (107, made(3000, "ab"))]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, chunk int, bucket string").repartition(5)
    assert result(lpf.repeated_spans(docs, least=40, gram=20, hot=hot, keep_first=keep_first)) == brute(rows, 40, keep_first)


def test_texts_and_other_columns_stay(spark):
    p = "0123456789" * 3 + "a passage that repeats, of more than forty bytes "
    rows = [(1, p + "one", "en"), (2, "two " + p, "de"), (3, None, None), (None, p, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang: (r.doc_id, r.text) for r in lpf.without_repeats(docs, least=40, gram=20).collect()}
    assert got["x"] == (None, p) and got[None] == (3, None)
    assert got["en"] == (1, "one") and got["de"] == (2, "two ")
    assert lpf.without_repeats(docs.limit(0)).count() == 0
