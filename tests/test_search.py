"""Predicates, hybrid queries, collections, catalog."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import bm25, catalog, collection, fusion
from sparkloom.operators.dense import HashEncoder
from sparkloom.plans import registry
from sparkloom.plans.predicate import FilterError, compile_filter, filtered
from sparkloom.plans.search import Engine, Request, formatted, rows_of_batches, scope_requests


@pytest.fixture(scope="module")
def points(spark):
    enc = HashEncoder(64)
    texts = ["rust is a systems programming language", "the cat sat on a mat", "python is a programming language for data", "gardens need water", ""]
    rows = [(str(i), t, enc.encode_query(t), "r" if i % 2 else "s", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, document string, dense array<float>, repo_name string, n int")


def test_filter_errors(points):
    for bad in ([1], {"$and": {}}, {"$or": [1]}, {"n": None}, {"n": [1]}, {"n": {"a": 1}}, "x"):
        with pytest.raises(FilterError):
            compile_filter(points, bad)
    assert filtered(points, {"$or": []}).count() == filtered(points, {}).count() == filtered(points).count() == 5
    assert filtered(points, {"n": "1"}).count() == 0 and filtered(points, {"n": 1}).count() == 1 and filtered(points, {"n": 1.0}).count() == 1


def test_hybrid(spark, points):
    e = Engine(spark, {"codebase": points}, encode_query=HashEncoder(64).encode_query)
    got = e.run([Request("codebase", "programming language", 3)]).collect()
    assert {r.id for r in got[:2]} == {"0", "2"} and [r.rank for r in got] == [1, 2, 3]
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    hidden = e.run([Request("codebase", "language", 2), Request("codebase", "cat", 1, show_documents=False, where={"repo_name": "r"})]).collect()
    assert all(r.document == "" for r in hidden) and [r.request_idx for r in hidden] == [0, 0, 1]
    with pytest.raises(ValueError):
        e.run([])
    text = e.call_tool([Request("codebase", "")], "programming language", None, 2).first().text
    assert text.startswith("Found 2 results for 'programming language'\n\nResult 1 [") and text.count("\n---\n") == 1


def test_empty_text(spark):
    none = spark.createDataFrame([], "request_idx int, rank int, id string, document string, metadata string, score double")
    assert formatted(none, "q", 3).first().text == "No results found for query: 'q'"
    batch = spark.createDataFrame([(["a", "b"], ["x"], None, [0.5, 0.1])], "ids array<string>, documents array<string>, metadatas array<string>, distances array<double>")
    assert [tuple(r)[1:] for r in rows_of_batches(batch.withColumn("metadatas", F.array())).orderBy("pos").collect()] == [("a", "x", "{}", 0.5), ("b", "", "{}", 0.1)]


def test_sparse_vectors(spark):
    d = spark.createDataFrame([(1, "rust"), (2, "the quick brown fox jumps over the lazy dog"), (3, "the the and or"), (4, None)], "doc_id long, text string")
    got = {r.id: r for r in bm25.sparse_vectors(d).collect()}
    assert got[1].indices == [326552902] and abs(got[1]["values"][0] - 1.687743) < 1e-4
    assert got[2].indices == [226376294, 741580288, 771291085, 1312749093, 1621867415, 1913189942] and all(abs(v - 1.665287) < 1e-4 for v in got[2]["values"])
    assert got[3].indices == got[4].indices == []


def test_rerank_is_stable(spark):
    c = spark.createDataFrame([("b", "x", 2.0), ("a", "x", 2.0), ("c", "y", 1.0)], "id string, document string, score double")
    assert [r.id for r in fusion.rerank(c, "q", 3, lambda q, d: 1.0).collect()] == ["a", "b", "c"]


def test_scopes():
    assert [(r.collection, r.where) for r in scope_requests([], [])] == [("codebase", {})]
    got = scope_requests([("codebase", ["a"]), ("", [])], [("general", ["x", "y"])])
    assert [(r.collection, r.where) for r in got] == [("codebase", {"repo_name": "a"}), ("codebase", {}), ("general", {"$or": [{"group": "x"}, {"group": "y"}]})]


def test_store(spark, tmp_path):
    s = collection.Store(spark, str(tmp_path))
    schema = "id string, document string, repo_name string"
    assert s.ensure("codebase", schema) and not s.ensure("codebase", schema) and s.list_collections() == ["codebase"]
    with pytest.raises(ValueError):
        s.ensure("other", schema)
    s.upsert("codebase", spark.createDataFrame([("1", "a", "r"), ("2", "b", "r")], schema))
    s.upsert("codebase", spark.createDataFrame([("2", "B", "q"), ("3", "c", "q")], schema))
    assert sorted(tuple(r) for r in s.table("codebase").select("id", "document").collect()) == [("1", "a"), ("2", "B"), ("3", "c")]
    s.delete("codebase", ids=["1"])
    s.delete("codebase", where={"repo_name": "zzz"})
    assert s.table("codebase").count() == 2
    s.delete("codebase", where={})
    assert s.table("codebase").count() == 0
    with pytest.raises(ValueError):
        s.delete("codebase")
    with pytest.raises(ValueError):
        collection.check_index("k", "blob")
    assert collection.check_indexes("codebase", spark.createDataFrame([], schema)) == ["file_name", "created_at"]


def test_catalog_rules(spark):
    servers = spark.createDataFrame([(1, "one", True)], "id long, name string, active boolean")
    assert catalog.with_server(servers, {"id": 2, "name": " two ", "active": True}).count() == 2
    for bad in ("one", "no spaces", ""):
        with pytest.raises(ValueError):
            catalog.with_server(servers, {"id": 3, "name": bad, "active": True})
    tools = spark.createDataFrame([(1, "t", True, 5)], "id long, name string, active boolean, max_chunk_limit int")
    assert catalog.with_tool(tools, {"id": 1, "name": " u ", "active": True, "max_chunk_limit": 999}).collect()[0][:] == (1, "u", True, 50)
    assert not catalog.toggled(tools, 1).first().active
    with pytest.raises(ValueError):
        catalog.with_tool(tools, {"id": 2, "name": " "})


def test_vectors_apart(spark, points):
    """As with vectors in the collection: a vector of no point and a point without a vector have no place in the list."""
    enc = HashEncoder(64)
    within = points.withColumn("dense", F.when(F.col("id") != "2", F.col("dense")))
    apart = within.select("id", "dense").where("dense is not null").unionByName(spark.createDataFrame([("9", enc.encode_query("programming language"))], "id string, dense array<float>"))
    for query, where in (("programming language", None), ("cat", {"repo_name": "r"}), ("", {"n": 3})):
        for_one = Engine(spark, {"codebase": within}, encode_query=enc.encode_query).candidates("codebase", query, enc.encode_query(query), 4, where)
        for_two = Engine(spark, {"codebase": points.drop("dense")}, encode_query=enc.encode_query, vectors={"codebase": apart}).candidates("codebase", query, enc.encode_query(query), 4, where)
        assert [tuple(r) for r in for_one.collect()] == [tuple(r) for r in for_two.collect()] != []


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, was)


def dealt_out(df):
    """The columns of each exchange by a key."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return [set(re.findall(r"(\w+)#", columns)) for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", plan)]


@pytest.mark.parametrize("name", ["search", "search_words", "k12_tool_text", "j6_hybrid", "j7_dense_only", "a20_search_rows"])
def test_search_shuffles_no_texts(name, spark, sf, no_broadcast):
    """Vectors that are too many to broadcast meet ids."""
    found = dealt_out(registry.QUERIES[name](spark, sf))
    assert found and not any(x & {"text", "document", "embedding", "dense"} for x in found)
