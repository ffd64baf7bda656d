"""Retrieval: tokens, BM25, cosine, fusion, hybrid search, limits, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import limits
from sparkloom.functions import text as tx
from sparkloom.functions.stem import stem, term_of
from sparkloom.operators import bm25, dense, fusion
from sparkloom.plans.common import POINTS, points, t
from sparkloom.plans.predicate import but_not, compile_filter, filtered
from sparkloom.plans.search import Engine, Include, Request

QUERY = "the that with from tion stion"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)
_TERMS = ", ".join(f"'{x}'" for x in bm25.query_terms(QUERY + " thon reand ered anth"))
_TOKENS = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
kept AS (SELECT * FROM tok WHERE length(term) <= 40 AND term NOT IN ({_STOP}))"""
_POSTINGS = f"""{_TOKENS}, len AS (SELECT doc_id, count(*) AS length FROM kept GROUP BY doc_id), tf AS (SELECT doc_id, term, count(*) AS tf FROM kept GROUP BY doc_id, term),
post AS (SELECT doc_id, term, tf, length, tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / 256.0)) AS weight FROM tf JOIN len USING (doc_id))"""
_SPARSE = f"""{_POSTINGS}, df AS (SELECT term, count(*) AS df FROM post WHERE term IN ({_TERMS}) GROUP BY term),
sparse AS (SELECT doc_id, sum(weight * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))) AS score FROM post JOIN df USING (term) GROUP BY doc_id)"""
SEARCH_TEXT = QUERY + " thon reand ered anth"


def k1_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def j4_bm25_weights(spark, sf):
    p = bm25.postings(t(spark, sf, "documents"))
    return p.select(F.col("id").alias("doc_id"), "term", "tf", "length", F.round("weight", 6).alias("weight"))


def f8_term_statistics(spark, sf):
    d = t(spark, sf, "documents")
    s = bm25.document_frequencies(d)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return s.join(F.broadcast(n), how="cross").select("term", "df", F.round(bm25.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def e5_bm25_search(spark, sf):
    return bm25.search(spark, t(spark, sf, "documents"), SEARCH_TEXT, 20).select(F.col("id").alias("doc_id"), F.round("score", 5).alias("score"))


def _query_vector(dim: int = 64) -> list[float]:
    return [((i * 37 + 11) % 29 - 14) / 10 for i in range(dim)]


def j3_dense_top_k(spark, sf):
    return dense.top_k(t(spark, sf, "embeddings"), _query_vector(), 25, "vec_id", "embedding").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


_VECTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in _query_vector()) + "]"
_DENSE = f"SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR}) AS score FROM embeddings"


def f10_rank_fusion(spark, sf):
    near = dense.top_k(t(spark, sf, "embeddings"), _query_vector(), 40, "vec_id", "embedding")
    words = bm25.search(spark, t(spark, sf, "documents"), SEARCH_TEXT, 40)
    return fusion.fuse([near, words], 30).select("id", F.round("score", 8).alias("score"))


def g6_list_ranks(spark, sf):
    return fusion.ranked(dense.top_k(t(spark, sf, "embeddings"), _query_vector(), 40, "vec_id", "embedding")).select(F.col("id").alias("vec_id"), "rank")


def _engine(spark: SparkSession, sf: str) -> Engine:
    e = t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("dense"))
    return Engine(spark, {"general": points(spark, sf)}, encode_query=lambda q: _query_vector(), vectors={"general": e}, stemmed=False)


def j6_hybrid(spark, sf):
    return _engine(spark, sf).candidates("general", SEARCH_TEXT, _query_vector(), 20, {"lang": "en"}).select("id", F.round("score", 8).alias("score"))


def j7_dense_only(spark, sf):
    return _engine(spark, sf).candidates("general", "the and of", _query_vector(), 15).select("id", F.round("score", 6).alias("score"))


def a20_search_rows(spark, sf):
    rows = _engine(spark, sf).query("general", SEARCH_TEXT, 10, {"lang": "en"}, Include(metadatas=False))
    return rows.select("id", F.char_length("document").alias("chars"), F.round("score", 8).alias("score"))


def search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: two requests, hybrid, reranked, with stems."""
    return _flagship(spark, sf, True).withColumn("score", F.round("score", 6))


def search_words(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship's requests without stems, which SQL can follow to the end."""
    return _flagship(spark, sf, False).select("request_idx", "rank", "id", F.char_length("document").alias("chars"), F.round("score", 6).alias("score"))


def _flagship(spark: SparkSession, sf: str, stemmed: bool) -> DataFrame:
    engine = _engine(spark, sf)
    engine.stemmed = stemmed
    return engine.run([Request("general", SEARCH_TEXT, 10, where={"lang": "en"}), Request("general", "nation this there", 5)])


def k12_tool_text(spark, sf):
    return _engine(spark, sf).call_tool([Request("general", "", where={"group": "src0"}), Request("general", "", where={})], SEARCH_TEXT, None, 7)


_CLAUSES = {
    "d4_equality": ({"lang": "en", "even": True}, "lang = 'en' AND even"),
    "d2_and": ({"$and": [{"lang": "fr"}, {"doc_type": "txt"}], "lang": "ignored"}, "lang = 'fr' AND coalesce(doc_type = 'txt', false)"),
    "d3_or": ({"$or": [{"group": "src0"}, {"$and": [{"lang": "de"}, {"even": False}]}]}, "\"group\" = 'src0' OR (lang = 'de' AND NOT even)"),
    "d4_types": ({"$or": [{"size": "9"}, {"even": 1}, {"lang": "es"}, {"absent": "x"}]}, "lang = 'es'"),
    "d5_float": ({"quarter": 100.25}, "quarter BETWEEN 100.25 - 2.220446049250313e-16 AND 100.25 + 2.220446049250313e-16"),
    "d7_none": ({}, "true"),
}


def _clause(where):
    return lambda spark, sf: filtered(points(spark, sf), where).select("id", "lang")


def d8_but_not(spark, sf):
    p = points(spark, sf)
    return p.where(but_not(compile_filter(p, {"group": "src0"}), compile_filter(p, {"doc_type": "website"}))).select("id")


def h2_limits(spark, sf):
    n = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size") * 3 - 20).alias("n"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") - 5).alias("cap"))
    limit = limits.limit_column(F.col("n"))
    return n.select("p_partkey", limit.alias("limit"), (limit * limits.overfetch_column(limit)).alias("fetch"), (F.greatest(limit, F.lit(1)) * 4).alias("prefetch"), limits.effective_limit_column(F.col("n"), F.col("cap")).alias("shown"))


def h11_display_cut(spark, sf):
    """First rows of a concatenation of lists, not the best of all."""
    r = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request_idx"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("id"))
    return r.orderBy("request_idx", "rank", "id").limit(25)


def i1_concatenation(spark, sf):
    a = fusion.ranked(dense.top_k(t(spark, sf, "embeddings"), _query_vector(), 5, "vec_id", "embedding")).select(F.lit(0).alias("request_idx"), "rank", "id")
    b = fusion.ranked(bm25.search(spark, t(spark, sf, "documents"), SEARCH_TEXT, 5)).select(F.lit(1).alias("request_idx"), "rank", "id")
    return a.unionByName(b)


def j4_stemmed_vectors(spark, sf):
    v = bm25.sparse_vectors(t(spark, sf, "documents"))
    return v.select(F.col("id").alias("doc_id"), F.size("indices").alias("terms"), F.array_min("indices").alias("least"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 3).alias("mass"))


def j2_encoded(spark, sf):
    d = dense.encode_documents(t(spark, sf, "documents"), "text", "dense", lambda: dense.HashEncoder(32))
    return d.select("doc_id", F.size("dense").alias("dim"), F.round(dense.norm(F.col("dense")), 4).alias("norm"))


def j10_rerank(spark, sf):
    c = bm25.search(spark, t(spark, sf, "documents"), SEARCH_TEXT, 50)
    rows = t(spark, sf, "documents").join(F.broadcast(c), F.col("doc_id") == F.col("id")).select("id", F.col("text").alias("document"), "score")
    return fusion.rerank(rows, SEARCH_TEXT, 10).select("id", F.round("score", 8).alias("score"), "candidate_rank")


def w_window_dense(spark, sf):
    """The nearest vectors within each label: a ranking per group needs no single task."""
    e = t(spark, sf, "embeddings").select("vec_id", "label", dense.cosine(F.col("embedding"), dense.literal_vector(_query_vector())).alias("score"))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("rank <= 3").select("vec_id", "label", "rank")


QUERIES = {
    "k1_tokens": k1_tokens,
    "j4_bm25_weights": j4_bm25_weights,
    "f8_term_statistics": f8_term_statistics,
    "e5_bm25_search": e5_bm25_search,
    "j3_dense_top_k": j3_dense_top_k,
    "g6_list_ranks": g6_list_ranks,
    "f10_rank_fusion": f10_rank_fusion,
    "j6_hybrid": j6_hybrid,
    "j7_dense_only": j7_dense_only,
    "a20_search_rows": a20_search_rows,
    "search": search,
    "search_words": search_words,
    "k12_tool_text": k12_tool_text,
    **{k: _clause(w) for k, (w, _) in _CLAUSES.items()},
    "d8_but_not": d8_but_not,
    "h2_limits": h2_limits,
    "h11_display_cut": h11_display_cut,
    "i1_concatenation": i1_concatenation,
    "j4_stemmed_vectors": j4_stemmed_vectors,
    "j2_encoded": j2_encoded,
    "j10_rerank": j10_rerank,
    "g6_top_per_label": w_window_dense,
}

_DENSE_40 = f"(SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_DENSE}) ORDER BY rank LIMIT {{n}})"
_HYBRID = f"""WITH {POINTS}, en AS (SELECT * FROM points WHERE lang = 'en'), {_SPARSE.replace("FROM documents),", "FROM documents WHERE lang = 'en'),", 1)},
dn AS (SELECT CAST(vec_id AS VARCHAR) AS id, row_number() OVER (ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM ({_DENSE}) WHERE CAST(vec_id AS VARCHAR) IN (SELECT id FROM en)),
sp AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM sparse),
both_lists AS (SELECT * FROM dn WHERE rank <= {{pre}} UNION ALL SELECT * FROM sp WHERE rank <= {{pre}}),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM both_lists GROUP BY id ORDER BY score DESC, id LIMIT {{n}})"""



_SUFFIXES = "s es 's ed eds ing ings edly ingly ly li y ies ied e ment ments ness ful fully fulness ous ously ousness ive ively iveness ize ized izes izing izer izers ization al als ally ality alism ational tional ation ations ator ators ance ances ence ences anci enci able ible ably bly ability ant ants ent ents ently ism ate ated ates ating iti ity ion ions ional er ers ic ics ical ically icate less lessly".split()


def _forms(query: str) -> str:
    """A table of words and their stems: of a query's stems every word that its letters and up to two endings make and that has this stem."""
    stems = {term_of(w)[0] for w in bm25.query_terms(query)}
    found = {}
    for s in stems:
        bases = {s, s[:-1] + "y", s + "e", s + s[-1], s + "t", s[:-1]}
        words = {b + x + y for b in bases for x in ["", *_SUFFIXES] for y in ["", "s", "ed", "ing", "ly", "er", "ness"]}
        found |= {w: s for w in words if stem(w) == s}
    return f"forms AS (SELECT * FROM (VALUES {', '.join(repr((w, s)) for w, s in sorted(found.items()) if chr(39) not in w)}) f(token, stem))"


def _request(i: int, query: str, where: str, n: int, limit: int, stemmed: bool = False) -> str:
    """The CTEs of a request: prefetched lists, fusion to n candidates, lexical scores, the best `limit`."""
    terms = ", ".join(f"'{x}'" for x in (sorted({term_of(w)[0] for w in bm25.query_terms(query)}) if stemmed else bm25.query_terms(query)))
    words = ", ".join(f"'{x}'" for x in sorted(set(query.lower().split())))
    return f"""
    own{i} AS (SELECT doc_id FROM documents WHERE {where}),
    df{i} AS (SELECT term, count(*) AS df FROM post WHERE term IN ({terms}) AND doc_id IN (SELECT doc_id FROM own{i}) GROUP BY term),
    sp{i} AS (SELECT CAST(doc_id AS VARCHAR) AS id, sum(weight * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))) AS score FROM post JOIN df{i} USING (term) WHERE doc_id IN (SELECT doc_id FROM own{i}) GROUP BY doc_id),
    dn{i} AS (SELECT CAST(vec_id AS VARCHAR) AS id, score FROM ({_DENSE}) WHERE vec_id IN (SELECT doc_id FROM own{i})),
    parts{i} AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sp{i} UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM dn{i}),
    fused{i} AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM parts{i} WHERE rank <= {4 * n} GROUP BY id ORDER BY score DESC, id LIMIT {n}),
    placed{i} AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM fused{i}),
    texts{i} AS (SELECT p.id, place, coalesce(d.text, '') AS text, regexp_extract_all(lower(substr(coalesce(d.text, ''), 1, 4000)), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM placed{i} p JOIN documents d ON CAST(d.doc_id AS VARCHAR) = p.id),
    firsts{i} AS (SELECT id, place, length(text) AS chars, list_filter(list_transform([{words}], lambda w: list_position(toks, w)), lambda x: x > 0) AS spots FROM texts{i}),
    scored{i} AS (SELECT id, place, chars, len(spots) / {len(set(query.lower().split()))}.0 + coalesce(list_sum(list_transform(spots, lambda x: 1.0 / (99 + x))), 0) / {len(set(query.lower().split()))}.0 AS score FROM firsts{i}),
    best{i} AS (SELECT {i} AS request_idx, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, place) AS INTEGER) AS rank, id, chars, round(score, 6) AS score FROM scored{i} QUALIFY rank <= {limit})"""


_STEMMED = f"""{_TOKENS}, {_forms(SEARCH_TEXT + ' nation this there')}, len AS (SELECT doc_id, count(*) AS length FROM kept GROUP BY doc_id),
tf AS (SELECT doc_id, stem AS term, count(*) AS tf FROM kept JOIN forms ON token = term GROUP BY ALL),
post AS (SELECT doc_id, term, tf, length, tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / 256.0)) AS weight FROM tf JOIN len USING (doc_id))"""
_SHOWN = """[CASE WHEN "group" IS NOT NULL THEN '"group":"' || "group" || '"' END, '"file_name":"' || file_name || '"', CASE WHEN doc_type IS NOT NULL THEN '"doc_type":"' || doc_type || '"' END, '"size":' || size, '"even":' || CASE WHEN even THEN 'true' ELSE 'false' END,
    '"quarter":' || CAST(CAST(quarter AS DOUBLE) AS VARCHAR), CASE WHEN lang IS NOT NULL THEN '"lang":"' || lang || '"' END]"""
_WORDS = ", ".join(f"'{w}'" for w in sorted(set(SEARCH_TEXT.lower().split())))

ORACLE_SQL = {
    "search_words": f"WITH {_POSTINGS}, {_request(0, SEARCH_TEXT, "lang = 'en'", 50, 10)}, {_request(1, 'nation this there', 'true', 25, 5)} SELECT * FROM best0 UNION ALL SELECT * FROM best1",
    "search": f"""WITH {POINTS}, {_STEMMED}, {_request(0, SEARCH_TEXT, "lang = 'en'", 50, 10, True)}, {_request(1, 'nation this there', 'true', 25, 5, True)}
        SELECT request_idx, rank, id, coalesce(document, '') AS document, '{{' || array_to_string(list_filter({_SHOWN}, lambda x: x IS NOT NULL), ',') || '}}' AS metadata, score FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1) JOIN points USING (id)""",
    "k12_tool_text": f"""WITH {POINTS}, {_POSTINGS}, {_request(0, SEARCH_TEXT, "source = 'src0'", 25, 5)}, {_request(1, SEARCH_TEXT, 'true', 25, 5)},
        every AS (SELECT *, row_number() OVER (ORDER BY request_idx, rank) AS i FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1)),
        lines AS (SELECT i, 'Result ' || i || ' (score: ' || printf('%.3f', score) || '):' || chr(10) || 'Metadata: {{' || array_to_string(list_filter({_SHOWN}, lambda x: x IS NOT NULL), ',') || '}}' AS line FROM every JOIN points USING (id))
        SELECT 'Found ' || count(*) || ' results for ' || chr(39) || '{SEARCH_TEXT}' || chr(39) || chr(10) || chr(10) || string_agg(line, chr(10) || '---' || chr(10) ORDER BY i) FILTER (i <= 5) AS text FROM lines""",
    "j10_rerank": f"""WITH {_SPARSE}, placed AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM sparse),
        firsts AS (SELECT id, place, list_filter(list_transform([{_WORDS}], lambda w: list_position(regexp_extract_all(lower(substr(coalesce(text, ''), 1, 4000)), '[\\p{{L}}\\p{{N}}_]+'), w)), lambda x: x > 0) AS spots FROM placed JOIN documents ON doc_id = id WHERE place <= 50),
        scored AS (SELECT id, place, (len(spots) + coalesce(list_sum(list_transform(spots, lambda x: 1.0 / (99 + x))), 0)) / {len(set(SEARCH_TEXT.lower().split()))}.0 AS score FROM firsts)
        SELECT id, round(score, 8) AS score, CAST(place AS INTEGER) AS candidate_rank FROM scored ORDER BY round(scored.score, 12) DESC, place LIMIT 10""",
    "k1_tokens": "WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS token FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok GROUP BY token",
    "j4_bm25_weights": f"WITH {_POSTINGS} SELECT doc_id, term, tf, length, round(weight, 6) AS weight FROM post",
    "f8_term_statistics": f"WITH {_POSTINGS} SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM post GROUP BY term",
    "e5_bm25_search": f"WITH {_SPARSE} SELECT doc_id, round(score, 5) AS score FROM sparse ORDER BY sparse.score DESC, doc_id LIMIT 20",
    "j3_dense_top_k": f"SELECT vec_id, round(score, 6) AS score FROM ({_DENSE}) s ORDER BY s.score DESC, vec_id LIMIT 25",
    "g6_list_ranks": f"SELECT id AS vec_id, rank FROM {_DENSE_40.format(n=40)}",
    "f10_rank_fusion": f"WITH {_SPARSE}, sp AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sparse), parts AS (SELECT * FROM {_DENSE_40.format(n=40)} UNION ALL SELECT * FROM sp WHERE rank <= 40), f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM parts GROUP BY id ORDER BY score DESC, id LIMIT 30) SELECT id, round(score, 8) AS score FROM f",
    "j6_hybrid": _HYBRID.replace("{pre}", "80").replace("{n}", "20") + " SELECT id, round(score, 8) AS score FROM fused",
    "j7_dense_only": f"SELECT id, round(score, 6) AS score FROM (SELECT CAST(vec_id AS VARCHAR) AS id, score FROM ({_DENSE}) WHERE vec_id IN (SELECT doc_id FROM documents)) s ORDER BY s.score DESC, id LIMIT 15",
    "a20_search_rows": _HYBRID.replace("{pre}", "40").replace("{n}", "10") + " SELECT f.id, length(p.document) AS chars, round(f.score, 8) AS score FROM fused f JOIN points p ON p.id = f.id",
    **{k: f"WITH {POINTS} SELECT id, lang FROM points WHERE {sql}" for k, (_, sql) in _CLAUSES.items()},
    "d8_but_not": f"WITH {POINTS} SELECT id FROM points WHERE \"group\" = 'src0' AND NOT coalesce(doc_type = 'website', false)",
    "h2_limits": """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 10 != 0 THEN p_size * 3 - 20 END AS n, CASE WHEN p_partkey % 7 != 0 THEN p_size - 5 END AS cap FROM part),
        l AS (SELECT *, least(greatest(coalesce(n, 10), 1), 100) AS lim FROM n)
        SELECT p_partkey, lim AS "limit", lim * CASE WHEN lim <= 10 THEN 5 WHEN lim <= 25 THEN 4 WHEN lim <= 50 THEN 3 ELSE 2 END AS fetch, lim * 4 AS prefetch, least(CASE WHEN n > 0 THEN n ELSE 5 END, CASE WHEN cap > 0 THEN cap ELSE 5 END) AS shown FROM l""",
    "h11_display_cut": "SELECT l_orderkey AS request_idx, l_linenumber AS rank, l_partkey AS id FROM lineitem ORDER BY 1, 2, 3 LIMIT 25",
    "i1_concatenation": f"WITH {_SPARSE}, sp AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sparse) SELECT 0 AS request_idx, rank, id FROM {_DENSE_40.format(n=5)} UNION ALL SELECT 1, rank, id FROM sp WHERE rank <= 5",
    "g6_top_per_label": f"SELECT * FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR}) AS score FROM embeddings)) WHERE rank <= 3",
}
