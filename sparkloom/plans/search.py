"""Hybrid queries: a filtered collection ranked by cosine and by BM25, fused, reranked and cut; several requests in a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.limits import effective_limit, normalize_limit, overfetch, prefetch
from sparkloom.operators import bm25, dense, fusion
from sparkloom.plans.predicate import compile_filter, filtered

DEFAULT_COLLECTION = "codebase"


@dataclass
class Request:
    collection: str
    query: str
    limit: int | None = None
    show_documents: bool | None = None
    where: dict | None = None


@dataclass
class Include:
    """Which columns a result has beside the ids."""

    metadatas: bool = True
    documents: bool = True
    distances: bool = True


@dataclass
class Engine:
    """collections: tables of (id, document, dense, payload columns); postings, if given: BM25 postings of a collection, clustered by term;
    vectors, if given: (id, dense) of a collection whose vectors are a table of their own, which then meet its ids, never its texts."""

    spark: SparkSession
    collections: dict[str, DataFrame]
    encode_query: Callable[[str], list[float]] = dense.HashEncoder().encode_query
    rerank_score: Callable[[str, str], float] = fusion.lexical_score
    postings: dict[str, DataFrame] = field(default_factory=dict)
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    rrf_k: int = fusion.RRF_K
    stemmed: bool = True

    def candidates(self, collection: str, query: str | None, vector: list[float], n: int, where: dict | None = None, forms=None) -> DataFrame:
        """(id, score). The filter stands before the limit of each list, so no place in a list is wasted."""
        points = filtered(self.collections[collection], where)
        apart = self.vectors.get(collection)
        near = dense.top_k(points, vector, prefetch(n)) if apart is None else dense.top_k(apart, vector, prefetch(n), among=points)
        terms = bm25.query_terms(query, self.stemmed) if query else []
        if not terms:
            return near.orderBy(F.desc("score"), "id").limit(n)
        posted = self.postings.get(collection)
        if posted is None:
            if self.stemmed and forms is None:
                forms = bm25.forms_of(self.collections[collection], query, "document")
            posted = bm25.hits(points, terms, "id", "document", forms)
        else:
            posted = posted.where(F.col("term").isin(terms))
            posted = posted if where in (None, {}) else posted.join(points.select("id"), "id", "left_semi")
        total = self.collections[collection].agg(F.count(F.lit(1)).alias("n"))
        words = bm25.scores(posted, total, terms).orderBy(F.desc("score"), "id").limit(prefetch(n))
        return fusion.fuse([near, words], n, self.rrf_k)

    def query(self, collection: str, query: str, limit: int, where: dict | None = None, include: Include | None = None) -> DataFrame:
        """Fused results with payload and document, best first."""
        found = self.candidates(collection, query, self.encode_query(query), limit, where)
        rows = self.collections[collection].join(F.broadcast(found), "id").orderBy(F.desc("score"), "id")
        return rows.select(*projected(rows, include or Include()))

    def run(self, requests: list[Request]) -> DataFrame:
        """(request_idx, rank, id, document, metadata, score) of all requests in their order."""
        if not requests:
            raise ValueError("no requests")
        hidden = requests[-1].show_documents is False  # C4: the last one speaks for all
        forms = {}
        if self.stemmed:  # the tokens that stand for any request's stems, found once per collection
            for name in {r.collection for r in requests} - set(self.postings):
                forms[name] = bm25.forms_of(self.collections[name], " ".join(r.query for r in requests if r.collection == name), "document")
        parts = []
        for i, r in enumerate(requests):
            limit = normalize_limit(r.limit)
            found = self.candidates(r.collection, r.query, self.encode_query(r.query), limit * overfetch(limit), r.where, self._own(forms.get(r.collection), r.query))
            rows = self.collections[r.collection].join(F.broadcast(found), "id")
            meta = metadata(rows)
            best = fusion.rerank(rows.select("id", F.coalesce("document", F.lit("")).alias("document"), meta.alias("metadata"), "score"), r.query, limit, self.rerank_score)
            rank = F.row_number().over(W.orderBy(F.desc(F.when(F.isnan("score"), None).otherwise(F.col("score"))), "candidate_rank"))
            parts.append(best.select(F.lit(i).alias("request_idx"), rank.alias("rank"), "id", F.lit("").alias("document") if hidden else F.col("document"), "metadata", "score"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _own(self, forms, query: str):
        """Of the forms for all requests those of this query."""
        if forms is None:
            return None
        terms = bm25.query_terms(query, True)
        return [x for x in forms if x[1] in terms] if isinstance(forms, list) else forms.where(F.col("term").isin(terms))

    def call_tool(self, scopes: list[Request], query: str, requested: int | None, tool_max: int | None) -> DataFrame:
        """The query over all scopes of a tool, as text in one row; the first results of the concatenation are shown."""
        limit = effective_limit(requested, tool_max)
        found = self.run([Request(s.collection, query, limit, True, s.where) for s in scopes])
        return formatted(found, query, limit)


def metadata(rows: DataFrame) -> Column:
    """The payload without the document, as JSON."""
    keys = [c for c in rows.columns if c not in ("id", "document", "dense", "sparse", "score")]
    return F.to_json(F.struct(*keys)) if keys else F.lit("{}")


def projected(rows: DataFrame, include: Include) -> list[Column]:
    out = [F.col("id")]
    if include.documents:
        out.append(F.col("document"))
    if include.metadatas:
        out.append(metadata(rows).alias("metadata"))
    if include.distances:
        out.append(F.col("score"))
    return out


def rows_of_batches(batches: DataFrame) -> DataFrame:
    """Results as parallel arrays of (ids, documents, metadatas, distances) to rows; what is missing is empty."""
    zipped = batches.select(F.posexplode(F.arrays_zip("ids", "documents", "metadatas", "distances")).alias("pos", "r"))
    return zipped.select(
        "pos", F.coalesce("r.ids", F.lit("")).alias("id"), F.coalesce("r.documents", F.lit("")).alias("document"), F.coalesce("r.metadatas", F.lit("{}")).alias("metadata"), F.coalesce("r.distances", F.lit(0.0)).alias("score")
    )


def formatted(results: DataFrame, query: str, limit: int) -> DataFrame:
    """One row, the results as text. The header counts all of them, whatever is shown."""
    source = F.coalesce(F.get_json_object("metadata", "$.source"), F.get_json_object("metadata", "$.repo_name"))
    place = F.row_number().over(W.orderBy("request_idx", "rank"))
    numbered = results.select(place.alias("i"), source.alias("source"), "score", "metadata")
    line = F.concat(F.format_string("Result %d", "i"), F.when(F.col("source").isNotNull(), F.concat(F.lit(" ["), "source", F.lit("]"))).otherwise(""), F.format_string(" (score: %.3f):\nMetadata: %s", "score", "metadata"))
    shown = numbered.agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.when(F.col("i") <= limit, F.struct("i", line.alias("line"))))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n---\n")
    return shown.select(F.when(F.col("total") == 0, F.lit(f"No results found for query: '{query}'")).otherwise(F.concat(F.format_string("Found %d results for '%s'\n\n", "total", F.lit(query)), body)).alias("text"))


def scope_requests(code_scopes: list[tuple[str, list[str]]], document_scopes: list[tuple[str, list[str]]], query: str = "") -> list[Request]:
    """One request a scope, code first; no value: no filter, one: equality, more: any of them; no scope at all: all code."""
    out = []
    for key, default, scopes in (("repo_name", "codebase", code_scopes), ("group", "general", document_scopes)):
        for collection, values in scopes:
            where = {} if not values else {key: values[0]} if len(values) == 1 else {"$or": [{key: v} for v in values]}
            out.append(Request(collection or default, query, where=where))
    return out or [Request(DEFAULT_COLLECTION, query, where={})]


def checked(df: DataFrame, where: dict) -> Column:
    """The compiled clause, for callers that delete by it."""
    return compile_filter(df, where)
