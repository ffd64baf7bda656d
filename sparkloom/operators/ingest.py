"""End-to-end ingest: files, archives and pages become points of a collection."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.paths import is_code, is_skipped, skipped
from sparkloom.functions.text import repo_of_zip
from sparkloom.functions.urls import website_url
from sparkloom.operators import chunk, dense
from sparkloom.operators.bm25 import Bm25, SparseEmbed
from sparkloom.operators.collection import Store, replacement_clause
from sparkloom.schema import SPARSE
from sparkloom.sources import loaders
from sparkloom.sources.code import dispatch

PAYLOAD = "file_name string, doc_type string, page bigint, chunk_index bigint, repo_name string, group string, url string, website_key string, zip_filename string, created_at string, metadata string"
POINT = f"id string, document string, dense array<float>, sparse {SPARSE}, {PAYLOAD}"
_CODE = "file_name string, doc_type string, chunk_index bigint, document string, text string, metadata string"


def point_id(*parts: Column) -> Column:
    """A UUID of what a chunk is, so that a task that runs again makes the same points."""
    h = F.md5(F.concat_ws("\0", *parts))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def points_of(rows: DataFrame, make: Callable[[], dense.EncodeDocuments] = dense.HashEncoder, sparse: SparseEmbed | None = None) -> DataFrame:
    """Points of rows (id, document, text, payload columns): both vectors are those of `text`; payload that a row lacks is null."""
    encoded = dense.encode_documents(rows, "text", "dense", make).withColumn("sparse", (sparse or Bm25()).documents(F.col("text")))
    columns = [x.split() for x in PAYLOAD.split(", ")]
    return encoded.select("id", "document", "dense", "sparse", *((F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in columns))


def document_rows(files: DataFrame, at: str, group: str | None = None, **payload: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows for points, errors) of files (path, content) by their loaders."""
    loaded = loaders.load_files(files)
    parts = loaded.where("error IS NULL").select("file_name", "doc_type", "page", "source_idx", "content", "metadata")
    chunks = chunk.chunk_documents(parts).withColumnRenamed("content", "document")
    text = chunk.embedding_text(F.col("file_name"), F.col("doc_type"), F.col("page"), F.col("document"))
    user = F.create_map(*(F.lit(x) for k, v in {"group": group, **payload}.items() if v is not None for x in (k, v))) if group or any(payload.values()) else None
    base = F.create_map(F.lit("file_name"), F.col("file_name"), F.lit("doc_type"), F.col("doc_type"))
    rows = chunks.withColumns({
        "id": point_id(F.col("file_name"), F.col("chunk_index").cast("string"), F.lit(at)), "text": text, "created_at": F.lit(at), "group": F.lit(group),
        "metadata": F.to_json(chunk.merged_metadata(base, F.col("metadata"), *([user] if user is not None else []))), **{k: F.lit(v) for k, v in payload.items()},
    })
    return rows, loaded.where("error IS NOT NULL").select("file_name", "error")


def code_rows(files: DataFrame, at: str, repo: str | None = None, **payload: str | None) -> DataFrame:
    """Rows for points of code files (path, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                for i, r in enumerate(dispatch.code_chunks(path, bytes(data), repo, at) if not is_skipped(path) else []):
                    d = dispatch.document_chunk(r, i)
                    rows.append((path, d["doc_type"], i, r["code"], dispatch.embedding_text(r), d["metadata"]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CODE.split(", ")])

    rows = files.select("path", "content").mapInPandas(run, _CODE)
    return rows.withColumns({"id": point_id(F.col("file_name"), F.col("chunk_index").cast("string"), F.lit(at)), "created_at": F.lit(at), "repo_name": F.lit(repo), **{k: F.lit(v) for k, v in payload.items()}})


def file_rows(files: DataFrame, collection: str, at: str, repo: str | None = None, group: str | None = None, **payload: str | None) -> tuple[DataFrame, DataFrame]:
    """Code by its chunkers where the collection is one of code, all else by the loaders."""
    if collection != "codebase":
        return document_rows(files, at, group, **payload)
    code = is_code(F.col("path"))
    rows, errors = document_rows(files.where(~code), at, None, repo_name=repo, **payload)
    return code_rows(files.where(code), at, repo, **payload).unionByName(rows, allowMissingColumns=True), errors


def page_rows(pages: DataFrame, group: str, at: str) -> DataFrame:
    """Rows for points of pages (url, html) of one website."""
    chunks = chunk.chunk_pages(pages, group, at)
    text = chunk.embedding_text(F.col("url"), F.lit("website"), F.lit(None).cast("bigint"), F.col("content"))
    meta = F.to_json(F.struct("url", "page_id", "page_title", "content_type", "language", "heading_path", "chunk_hash", "total_chunks", "prev_chunk_id", "next_chunk_id", "links", "navigation_links"))
    return chunks.select("id", F.col("content").alias("document"), text.alias("text"), F.col("url").alias("file_name"), F.lit("website").alias("doc_type"), "chunk_index", F.lit(group).alias("group"), "url", "website_key", F.col("embedded_at").alias("created_at"), meta.alias("metadata"))


def progress_marks(total: int, every: int = 100) -> list[tuple[int, int]]:
    """Q14: (documents done, percentage) at every so many of them and at the end."""
    return [(n, n * 100 // total) for n in [*range(every, total, every), *([total] if total else [])]]


def total_bytes(files: DataFrame) -> DataFrame:
    """the sum of the files' sizes (path, content)."""
    return files.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))


class Ingestor:
    """The four tasks over a store of collections. A task's parameters name files in storage that Spark reads; nothing is fetched to the driver
    but counts and errors."""

    def __init__(self, spark: SparkSession, store: Store, make: Callable[[], object] = dense.HashEncoder):
        self.spark, self.store, self.make = spark, store, make

    def tasks(self) -> dict[str, Callable[[dict, Callable[[int, str], None]], str]]:
        return {"process_zip": self.zip, "process_documents_upload": self.documents, "process_code_file_upload": self.code, "process_website_scrape": self.website}

    def _files(self, path: str) -> DataFrame:
        return self.spark.read.format("binaryFile").load(path).select("path", "content")

    def _stored(self, collection: str, clauses: list[dict], rows: DataFrame, errors: DataFrame | None, progress: Callable) -> str:
        """Replace before insert: what the clauses match goes, then the points come."""
        points = points_of(rows, self.make)
        self.store.ensure(collection, POINT)
        for where in clauses:
            self.store.delete(collection, where=where)
        progress(50, "embedding")
        before = self.store.table(collection).count()
        self.store.upsert(collection, points, "chunk_index")
        added = self.store.table(collection).count() - before
        progress(95, f"{added} chunks")
        failed = sorted(f"{r.file_name}: {r.error}" for r in errors.collect()) if errors is not None else []
        return json.dumps({"chunks": added, "errors": failed})

    def zip(self, p: dict, progress: Callable) -> str:
        """Members of an archive; a repository is named after the archive unless a name is given."""
        members = loaders.read_zips(self._files(p["path"])).select("path", "content")
        collection, name = p.get("collection") or "general", p.get("zip_filename") or p["path"].rpartition("/")[2]
        repo = (p.get("repo_name") or "").strip() or self.spark.range(1).select(repo_of_zip(F.lit(name)).alias("r")).first().r
        repo = repo if collection == "codebase" else None
        progress(10, "reading")
        rows, errors = file_rows(members, collection, p["at"], repo, p.get("group"), zip_filename=name)
        return self._stored(collection, [replacement_clause(collection, zip_name=name, repo=repo)], rows, errors, progress)

    def documents(self, p: dict, progress: Callable) -> str:
        """Files named by their base names, which replace earlier ones of the same name and group."""
        files = self._files(p["path"]).withColumn("path", F.lit(p.get("file_name") or p["path"].rpartition("/")[2]))
        rows, errors = document_rows(files.where(~skipped(F.col("path"))), p["at"], p.get("group"))
        name = p.get("file_name") or p["path"].rpartition("/")[2]
        return self._stored(p.get("collection") or "general", [replacement_clause("general", file_name=name, group=p.get("group"))], rows, errors, progress)

    def code(self, p: dict, progress: Callable) -> str:
        name = p.get("file_name") or p["path"].rpartition("/")[2]
        files = self._files(p["path"]).withColumn("path", F.lit(name))
        return self._stored("codebase", [{"$and": [{"file_name": name}, {"repo_name": p.get("repo_name") or ""}]}], code_rows(files, p["at"], p.get("repo_name") or ""), None, progress)

    def website(self, p: dict, progress: Callable) -> str:
        """One job for all its pages, a table (url, html) in storage; every address must be one of a website."""
        wanted = [website_url(u) for u in p["urls"]]
        pages = self.spark.read.parquet(p["pages"]).where(F.col("url").isin(wanted)).select("url", "html")
        clauses = [{"$and": [{"url": u}, {"group": p.get("group") or "default"}]} for u in wanted]
        return self._stored("general", clauses, page_rows(pages, p.get("group") or "default", p["at"]), None, progress)
