"""Each stage of the pipeline against brute force on what the stage before it kept."""

from pathlib import Path

import corpus_pipeline
import pytest

from sparkloom.llm.common import materialize, shared_dir

from . import test_exact_dedup, test_minhash, test_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(rows, least=200):
    first = {}
    for i, t in sorted(rows):
        b = t.encode()
        for q in range(len(b) - least + 1):
            first.setdefault(hash(b[q : q + least]), (i, q))
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for q in range(len(b) - least + 1):
            if first[hash(b[q : q + least])] != (i, q):
                gone[q : q + least] = b"\1" * least
        parts, at = [], 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = kept.decode("utf-8", "ignore")
    return out


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), "test")
        found.append((before, docs))
    return found


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_language(stages):
    before, after = stages[0]
    assert after.columns == COLUMNS
    assert sorted(rows(after)) == sorted((i, t) for i, t in rows(before) if t and any(c.isalpha() for c in t))


def test_exact(stages):
    before, after = stages[1]
    assert after.columns == COLUMNS and after.count() < before.count()
    last = {}
    for i, t in sorted(rows(before)):
        last[test_exact_dedup.norm(t)] = i
    assert sorted(i for i, _ in rows(after)) == sorted(last.values())


def test_near(stages):
    before, after = stages[2]
    assert after.columns == COLUMNS
    found = test_minhash.brute(rows(before))
    assert sorted(i for i, _ in rows(after)) == sorted(i for i, c in found.items() if i == c)


def test_repeats(stages):
    before, after = stages[3]
    assert after.columns == COLUMNS and after.count() == before.count()
    assert dict(rows(after)) == without_repeats(rows(before))
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_packing_stage(stages):
    before, after = stages[4]
    test_packing.check(rows(before), after.collect())


def test_edge_cases(spark, sf):
    """Null texts and ids, rows that repeat, another column, an empty table; what stays is asserted stage by stage."""
    made = [
        (1, None, "en", "s", 0, "x"), (2, "the cat and the dog", None, None, None, "y"), (2, "the cat and the dog", None, None, None, "y"), (2, "other words entirely here", "en", "s", 1, "z"),
        (None, "the cat and the dog", "en", "s", 5, None), (None, "the cat and the dog", "en", "s", 5, None), (None, "zz top", "en", "s", 2, "q"), (3, "THE cat and the dog", "en", "s", 2, "q"), (4, "12 !", "en", "s", 2, "q"),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, sha string")
    want = [
        [(2, "the cat and the dog")] * 2 + [(2, "other words entirely here"), (3, "THE cat and the dog"), (0, "zz top")] + [(0, "the cat and the dog")] * 2,
        [(2, "other words entirely here"), (3, "THE cat and the dog"), (0, "zz top")] + [(0, "the cat and the dog")] * 2,
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf), "test")
        if k < 4:
            assert docs.columns == before.columns
            assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted(want[min(k, 1)])
    assert sum(r.start == 0 for r in docs.collect()) == 5
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, sf), "test")
    assert empty.count() == 0


def test_run_leaves_no_scratch_of_its_stages(spark, tmp_path):
    spark.createDataFrame([(i, f"the cat and the dog number {i}", "en", "s", 30) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_dir(spark).removeprefix("file://")) / "sparkloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 6
    assert {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before} <= {"suffix-array-dedup", "tokens"}
