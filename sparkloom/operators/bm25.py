"""Sparse retrieval: BM25 weights with a fixed mean length, inverse document frequencies, scores by a join on terms."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx

K1, B, MEAN_LENGTH = 1.2, 0.75, 256.0


def saturation(tf: Column, length: Column) -> Column:
    """J4."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / MEAN_LENGTH))


#: Surface forms of a query's stems that go into a filter; more are joined.
FORMS = 1000


def _terms(text: Column, stemmed: bool) -> Column:
    terms = tx.content_tokens(text)
    if stemmed:
        from sparkloom.functions.stem import term_ids

        terms = term_ids(terms)
    return terms


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once: as an argument of a function it is never copied to where it is used."""
    return F.transform(F.array(value), body)[0]


def counted(terms: Column) -> Column:
    """An array of (term, tf) by rising term: a document's terms are sorted inside its row, and equal ones make a run."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return bound(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s) + 1) - i).cast("bigint").alias("tf"))))

    return bound(F.array_sort(terms), lambda s: F.when(F.size(s) > 0, runs(s)))


def _documents(docs: DataFrame, id_col: str, terms: Column, chosen=lambda x: x) -> DataFrame:
    """(id, d): d holds the number of all terms (length) and the counts of the chosen ones."""
    return docs.select(F.col(id_col).alias("id"), bound(terms, lambda x: F.struct(F.size(x).alias("length"), counted(chosen(x)).alias("counts"))).alias("d"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stemmed: bool = False) -> DataFrame:
    """(id, term, tf, length, weight): one row per document and term; length counts the tokens left after stop words.

    Terms are tokens, or identifiers of their stems. No shuffle: each document's postings come out of its own row.
    """
    return _weighted(_documents(docs, id_col, _terms(F.col(text_col), stemmed)).select("id", "d.length", F.inline("d.counts")))


def _weighted(rows: DataFrame) -> DataFrame:
    return rows.select("id", "term", "tf", "length", saturation(F.col("tf"), F.col("length")).alias("weight"))


def write_postings(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", stemmed: bool = True) -> None:
    """Postings as a table sorted by term, written at ingest: a query's terms prune files and row groups by their bounds."""
    postings(docs, id_col, text_col, stemmed).repartitionByRange("term", F.xxhash64("id")).sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def stem_forms(docs: DataFrame, terms: list, beginnings: list[str], text_col: str = "text") -> DataFrame:
    """(token, term): the corpus's tokens whose stems have these identifiers, of stems with these beginnings.

    A stem's first two characters (or its only one) are those of the word, but for the stemmer's listed exceptions, so other tokens are
    dropped inside their rows; what is left is stemmed once for each distinct token.
    """
    from sparkloom.functions.stem import EXCEPTIONS, term_id

    may = F.filter(F.array_distinct(tx.content_tokens(F.col(text_col))), lambda x: F.substring(x, 1, 2).isin(beginnings) | F.substring(x, 1, 1).isin(beginnings) | x.isin(EXCEPTIONS))
    tokens = docs.select(F.explode(may).alias("token")).distinct()
    return tokens.withColumn("term", term_id("token")).where(F.col("term").isin(terms))


def hits(docs: DataFrame, terms: list, id_col: str = "doc_id", text_col: str = "text", forms: list[tuple] | DataFrame | None = None) -> DataFrame:
    """The postings of some terms only, straight from the texts. With forms, (token, term) pairs, tokens count as the terms they stand for.

    Tokens that aren't asked for are dropped inside the row; only what is left is counted and comes out of it.
    """
    tokens = tx.content_tokens(F.col(text_col))
    if isinstance(forms, DataFrame):  # too many for a filter
        rows = docs.select(F.col(id_col).alias("id"), bound(tokens, lambda x: F.struct(F.size(x).alias("length"), x.alias("all"))).alias("d"))
        found = rows.select("id", "d.length", F.explode("d.all").alias("token")).join(forms, "token")
        return _weighted(found.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length")))
    asked = [t for t, _ in forms] if forms is not None else terms

    def chosen(x: Column) -> Column:
        if not asked:
            return F.array().cast("array<string>")
        own = F.filter(x, lambda t: t.isin(asked))
        return F.transform(own, lambda t: F.element_at(F.create_map(*(F.lit(v) for pair in forms for v in pair)), t)) if forms else own

    return _weighted(_documents(docs, id_col, tokens, chosen).select("id", "d.length", F.inline("d.counts")))


def forms_of(docs: DataFrame, query: str, text_col: str = "text") -> list[tuple] | DataFrame:
    """stem_forms() for a query's words as a list while they are FORMS at most, else as a table."""
    from sparkloom.functions.stem import term_of

    terms = query_terms(query, True)
    if not terms:
        return []
    beginnings = sorted({term_of(w)[0][:2] for w in query_terms(query)})
    found = stem_forms(docs, terms, beginnings, text_col)
    some = found.limit(FORMS + 1).collect()
    return [tuple(r) for r in some] if len(some) <= FORMS else found


def sparse_column(text: Column) -> Column:
    """A text's (indices, values): term identifiers ascending with their weights, as points store them; empty arrays without terms."""
    empty = F.array().cast("array<struct<term:bigint,tf:bigint>>")
    counts = bound(_terms(text, True), lambda x: F.struct(F.size(x).alias("length"), F.coalesce(counted(x), empty).alias("counts")))
    return bound(counts, lambda d: F.struct(F.transform(d["counts"], lambda c: c["term"]).alias("indices"), F.transform(d["counts"], lambda c: saturation(c["tf"], d["length"]).cast("float")).alias("values")))


def sparse_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, indices, values) of a table of texts."""
    return docs.select(F.col(id_col).alias("id"), sparse_column(F.col(text_col)).alias("s")).select("id", "s.indices", "s.values")


def query_terms(text: str, stemmed: bool = False) -> list:
    """Distinct terms in order, each of weight one; made by the driver, as a query is one row."""
    import re

    stop = set(tx.STOP_WORDS)
    words = [t for t in re.findall(r"\w+", text.lower()) if len(t) <= tx.MAX_TOKEN and t not in stop]
    if stemmed:
        from sparkloom.functions.stem import term_of

        words = [term_of(t)[1] for t in words]
    return sorted(set(words))


def idf(df: Column, n: Column) -> Column:
    """F8: ln(1 + (N - n + 0.5) / (n + 0.5))."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_statistics(posted: DataFrame) -> DataFrame:
    """(term, df): documents that have the term."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) straight from texts: each document's distinct terms, counted before the shuffle."""
    return docs.select(F.explode(F.array_distinct(tx.content_tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def scores(posted: DataFrame, total: DataFrame, terms: list) -> DataFrame:
    """(id, score) of the documents that share a term with the query.

    The query's terms are a filter on the postings, which a table clustered by term prunes with; `total` is one row (n) and joins
    the few terms' statistics, never the postings. Statistics and scores read the same exchange of what the filter leaves.
    """
    hit = posted.where(F.col("term").isin(terms)) if terms else posted.where(F.lit(False))
    hit = hit.select("id", "term", "weight").repartition("id")
    weights = term_statistics(hit).join(F.broadcast(total.select("n").limit(1)), how="cross").select("term", idf(F.col("df"), F.col("n")).alias("idf"))
    return hit.join(F.broadcast(weights), "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))


def search(spark: SparkSession, docs: DataFrame, query: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The best documents by BM25, ties by id (E5, G-23)."""
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    terms = query_terms(query)
    return scores(hits(docs, terms, id_col, text_col), total, terms).orderBy(F.desc("score"), "id").limit(limit)


class SparseEmbed(Protocol):
    """Vectors of documents, as a column; of a query, its terms. By default a query is embedded as documents are."""

    def documents(self, text: Column) -> Column: ...

    def query(self, text: str) -> list: ...


class Bm25:
    """The default."""

    def documents(self, text: Column) -> Column:
        return sparse_column(text)

    def query(self, text: str) -> list:
        return query_terms(text, stemmed=True)
