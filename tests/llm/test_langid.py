"""Language ID: held-out accuracy, and filters against sets."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkloom.llm import langid
from sparkloom.llm.common import byte_rows


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op8_langid(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.95 * len(out)


def test_filters_agree_with_sets():
    rng = np.random.default_rng(0)
    made = {x: ["".join(rng.choice(list(letters), 60)) for _ in range(40)] for x, letters in {"aa": "abcde ", "bb": "cdefgh ", "cc": "ghijké "}.items()}

    def of(t):
        b = bytes(langid.FOLD[np.frombuffer(b"    " + t.encode() + b"    ", np.uint8)])
        return [int.from_bytes(b[i : i + 5], "big") for i in range(len(b) - 4) if b[i : i + 5] != b"     "]

    counts = {x: Counter(g for t in ts for g in of(t)) for x, ts in made.items()}
    model = langid.build([(x, g, n) for x, c in counts.items() for g, n in c.items()], {x: 40 for x in made}, slots=1 << 22)
    texts = [t for ts in made.values() for t in ts[:5]] + ["", "zzz"]
    shares = model.shares(*byte_rows(pa.RecordBatch.from_pydict({"text": texts})))
    for t, row in zip(texts, shares, strict=True):
        typical = [{g for g, n in counts[x].items() if n / sum(counts[x].values()) >= langid.MIN_SHARE * max(counts[y][g] / sum(counts[y].values()) for y in counts)} for x in model.languages]
        g = of(t)
        want = [sum(k in s for k in g) / max(1, len(g)) for s in typical]
        assert np.allclose(row, want, atol=0.01)


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog and the cat and the dog", "en"), (2, "der hund und die katze und der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "en"), (6, "中文", None), (None, "the cat and the dog and", None), (8, "and the dog " * 100_000, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[None][0] == "en" and got[8][0] == "en"
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6] == ("en", 0.0)
    assert langid.predict(docs.limit(0), model).count() == 0
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0).select("doc_id", "text", "lang"))).collect()] == ["und"] * 8


def test_more_languages_than_bits_of_a_word():
    rng = np.random.default_rng(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = {f"l{k:03}": "".join(rng.choice(list(letters), 400)) for k in range(150)}
    counts = []
    for x, t in made.items():
        key, _ = langid.grams(*byte_rows(pa.RecordBatch.from_pydict({"text": [t]})))
        counts += [(x, int(g), int(n)) for g, n in zip(*np.unique(key[key != 0], return_counts=True), strict=True)]
    model = langid.build(counts, dict.fromkeys(made, 1))
    assert len(model.masks) == 3
    shares = model.shares(*byte_rows(pa.RecordBatch.from_pydict({"text": list(made.values())})))
    assert (shares.argmax(axis=1) == np.arange(150)).all()


def test_kept_grams_end_at_a_count(spark, monkeypatch):
    """No more than MAX_GRAMS, and all or none of those with one count."""
    monkeypatch.setattr(langid, "MAX_GRAMS", 6)
    monkeypatch.setattr(langid, "MIN_COUNT", 1)
    seen = []
    monkeypatch.setattr(langid, "build", lambda rows, totals: seen.append((rows, totals)))
    langid.fit(spark.createDataFrame([(1, "aaaaaaaaaa bcdefgh bcdefgh", "x"), (2, None, "x"), (3, "q", None)], "doc_id long, text string, lang string"))
    (rows, totals), = seen
    assert totals == {"x": 1} and 0 < len(rows) <= 6 and all(n >= 2 for _, _, n in rows)


def test_few_bytes_are_looked_up_at_a_time():
    class Model:
        languages, given = ["en"], []

        def shares(self, data, offsets):
            self.given.append(len(data))
            return np.ones((len(offsets) - 1, 1))

    batch = pa.RecordBatch.from_pydict({"doc_id": range(1500), "text": ["word " * 400] * 1500})
    assert sum(b.num_rows for b in langid._predict(iter([batch]), Model())) == 1500
    assert sum(b.num_rows for b in langid._accepted(iter([batch]), Model())) == 1500
    assert sum(Model.given) == 2 * 3_000_000 and max(Model.given) <= 1 << 20
