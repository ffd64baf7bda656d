"""Scalars against known values."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import limits, paths, urls
from sparkloom.functions import text as tx
from sparkloom.functions.stem import murmur3, stem, term_of
from sparkloom.operators import jobs
from sparkloom.operators.chunk import byte_windows, merge_small, split_text
from sparkloom.sources.code.common import clean_code, merged_spans, normalize_code, remainder, strip_comments


@pytest.mark.parametrize("word, id_", [("rust", 326552902), ("hello", 613153351), ("jump", 1913189942), ("fox", 1621867415), ("dog", 1312749093), ("run", 243905464), ("world", 74040069), ("123", 1632341525)])
def test_term_ids(word, id_):
    h = murmur3(word.encode())
    assert abs(h - (1 << 32) if h >> 31 else h) == id_


def test_stems():
    pairs = {"jumps": "jump", "lazy": "lazi", "knackeries": "knackeri", "consistency": "consist", "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "generously": "generous", "cats": "cat", "national": "nation", "happily": "happili", "dying": "die"}
    assert {w: stem(w) for w in pairs} == pairs
    assert sorted(term_of(w)[1] for w in "quick brown fox jumps lazy dog".split()) == [226376294, 741580288, 771291085, 1312749093, 1621867415, 1913189942]


@pytest.mark.parametrize("requested, cap, want", [(None, None, 5), (0, 10, 5), (-3, 10, 5), (3, 10, 3), (20, 10, 10), (20, None, 5), (20, 0, 5), (1, 1, 1), (None, 2, 2), (7, 7, 7)])
def test_effective_limit(requested, cap, want):
    assert limits.effective_limit(requested, cap) == want


def test_limits():
    assert [limits.normalize_limit(x) for x in (None, 0, 7, 500)] == [10, 1, 7, 100]
    assert [x * limits.overfetch(x) for x in (1, 10, 11, 25, 26, 50, 51, 100)] == [5, 50, 44, 100, 78, 150, 102, 200]
    assert [limits.max_chunk_limit(x) for x in (None, 0, 9, 99)] == [5, 1, 9, 50]
    assert limits.prefetch(0) == 4


def test_text_columns(spark):
    rows = [("a  \r\n\r\n\r\n\r\nb\t\n",), ("\n \n",), ("x\n\n\ny",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.normalize_code(F.col("t"))).collect()]
    assert got == [normalize_code(r[0]) for r in rows] == ["a\n\nb", "\n", "x\n\ny"]
    d = spark.createDataFrame([("The the QUICK_brown fox's 40" + "x" * 41 + " Été",)], "t string")
    assert d.select(tx.content_tokens(F.col("t"))).first()[0] == ["quick_brown", "fox", "été"]
    assert d.select(tx.hard_split(F.lit("abcdé"), 2)).first()[0] == ["ab", "cd", "é"]
    assert d.select(tx.hard_split(F.lit(""), 2)).first()[0] == [""]


def test_code_cleaning():
    assert clean_code("\tint x { get;  set; }\n\n\n\n\tvoid f() { }  ") == "int x {get;set;}\n\nvoid f(){}"
    assert strip_comments("a // x\nb /* y /* z */ */ c\n'--' -- d") == "a \nb \n c\n'--' "
    assert merged_spans([(5, 9), (0, 2), (2, 3), (8, 12)]) == [(0, 3), (5, 12)]
    assert remainder("abcdef", [(1, 3), (90, 99)]) == "adef" and remainder("  \nx", [(3, 4)]) == ""


def test_splitting():
    text = "# Title\n\n" + "One two three. " * 200 + "\n\n## Next\n\n" + "word " * 500
    pieces = split_text(text, 100, 10, markdown=True)
    assert all(len(p.encode()) <= 400 for p in pieces) and any(p.lstrip().startswith("## Next") or "\n## Next" in p for p in pieces)
    assert set(text.split()) == {w for p in pieces for w in p.split()}
    assert max(map(len, split_text("x" * 900_000, 768, 50))) <= 3072
    for t in ("日本語 " * 100, "a" * 99, "", "é ü " * 33):
        assert "".join(byte_windows(t, 3)) == t
    assert merge_small(["aa", "bb", "c" * 9, "d"], 2) == ["aa\nbb\n" + "c" * 9, "d"] and merge_small([], 3) == []


def test_urls():
    assert urls.website_url(" example.com/a ") == "https://example.com/a" and urls.website_url("//x.y") == "https://x.y/"
    for bad in ("ftp://x", "", "https://"):
        with pytest.raises(ValueError):
            urls.website_url(bad)
    assert urls.resolve("../b#c", "https://h/x/y/z") == "https://h/x/b" and urls.resolve("mailto:a@b", "https://h/") is None
    assert urls.canonical("https://h/a//#x") == "https://h/a"
    assert urls.in_scope("https://H:443/docs/x", "https://h/docs") and not urls.in_scope("https://h/docsx", "https://h/docs") and urls.in_scope("https://h/any", "https://h/")
    assert urls.ignored("www.x.com") and not urls.ignored("ax.com")
    assert urls.robots_sitemaps("Sitemap: /s.xml # c\nUser-agent: *\nSITEMAP:https://h/t.xml", "https://h/") == ["https://h/s.xml", "https://h/t.xml"]
    assert urls.sitemap_seeds("https://h/docs/a") == ["https://h/sitemap.xml", "https://h/sitemap_index.xml", "https://h/docs/sitemap.xml", "https://h/docs/sitemap_index.xml"]
    assert urls.server_id("server_id=&server_id=a%20b") == "a b" and urls.document_base("https://h/a/", "https://h/a") == "https://h/a/"


def test_paths():
    assert paths.is_skipped("a/NODE_MODULES/x.js") and paths.is_skipped("x.min.css") and paths.is_skipped("a\\bin\\b.rs") and not paths.is_skipped("src/main.rs")
    assert paths.language("a/b.HPP") == "Cpp" and paths.language("README") is None


def test_uploads():
    j, f, e = jobs.upload_rows([("up/a.zip", 3), ("up/", 0)], "codebase", "process_zip", {"k": 1}, "2024-01-01T00:00:00Z", repo="r")
    assert len(j) == len(f) == len(e) == 1 and j[0]["storage_object_id"] == f[0]["storage_object_id"] and f[0]["status"] == "pending"
    assert jobs.one_kind(["a.zip", "b.txt", "c.ZIP"]) == ["a.zip", "c.ZIP"] and jobs.added_paths(["a"], ["b", "a", "b", "c"], 2) == ["a", "b"]


def test_stems_begin_as_their_words():
    """What stem_forms() rests on."""
    import random

    from sparkloom.functions.stem import EXCEPTIONS, stem

    rng, letters = random.Random(1), "aeiouybcdglmnrstz'"
    ends = ["", "s", "es", "ies", "ied", "ing", "ed", "edly", "ingly", "y", "ly", "ational", "ness", "ement", "e", "ll", "eed", "sses", "yed", "ying", "'s"]
    for _ in range(60_000):
        w = "".join(rng.choice(letters[:-1]) for _ in range(rng.randrange(1, 5))) + rng.choice(ends)
        assert w in EXCEPTIONS or w.startswith(stem(w)[:2]), w


def test_forms_of_a_query_are_all_found(spark):
    from sparkloom.functions.stem import term_of
    from sparkloom.operators import bm25

    docs = spark.createDataFrame([(1, "connect connected connecting connection connections consist skies sky dying die"), (2, None), (3, "Connects ski")], "doc_id long, text string")
    got = dict(bm25.forms_of(docs, "connection sky die"))
    assert set(got) == {"connect", "connected", "connecting", "connection", "connections", "connects", "skies", "sky", "dying", "die"}
    assert all(term_of(t)[1] == k for t, k in got.items()) and bm25.forms_of(docs, "the of") == []


def test_stems_of_arrays(spark):
    """Nulls and empty arrays stay; slices count from their own start."""
    import pyarrow as pa

    from sparkloom.functions.stem import each, stems, term_ids, term_of

    rows = [["running", "the", "running"], None, [], ["skies"]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<string>").coalesce(1).select("i", stems("x").alias("s"), term_ids("x").alias("t")).orderBy("i").collect()
    assert [(r.s, r.t) for r in got] == [(x if x is None else [term_of(w)[0] for w in x], x if x is None else [term_of(w)[1] for w in x]) for x in rows]
    lists = pa.array([["a", "b"], ["c"], None, ["b", "c"]])
    assert each(lists.slice(1), str.upper, pa.string()).to_pylist() == [["C"], None, ["B", "C"]]


def test_stems_hold_few_objects():
    """A batch of texts, 64 MB, is held as arrays, with objects for distinct tokens only; F2."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from sparkloom.functions.stem import term_ids, term_of

    words = pa.array([f"word{i}ing" for i in range(5000)])
    n, size = 2000, 500
    tokens = words.take(pa.array(np.arange(n * size) % len(words)))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), tokens)
    tracemalloc.start()
    try:
        got = term_ids.func(lists)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == n and got[1][0].as_py() == term_of("word500ing")[1]
    assert most < 40e6 and term_of.cache_info().maxsize <= 1 << 16
