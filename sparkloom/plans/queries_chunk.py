"""Chunks, pages and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import chunk, jobs, views
from sparkloom.plans.common import FILES, JOBS, files, t
from sparkloom.plans.common import jobs as job_rows
from sparkloom.sources import crawl, html
from sparkloom.streaming import tracker

NOW, CUTOFF = "2024-05-01T23:59:59Z", "2024-05-01T09:30:00Z"
AT = "2024-01-01T00:00:00Z"


def _turns(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("chunk_index"), F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.coalesce("text", F.lit("")).alias("content"))


def g1_neighbours(spark, sf):
    return chunk.neighbours(_turns(spark, sf)).drop("content")


def g3_running_index(spark, sf):
    """Positions over all lines of a source's documents."""
    d = t(spark, sf, "documents").select(F.col("source").alias("file_name"), F.col("doc_id").alias("source_idx"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))
    placed = chunk.running_offsets(d, "file_name", "source_idx", "n")
    rows = placed.select("file_name", "source_idx", "offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"))
    return rows.select("file_name", "source_idx", "piece", (F.col("offset") + F.col("piece")).cast("int").alias("chunk_index"))


def n7_merge(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return d.select("doc_id", F.posexplode(chunk.merge_small_column(F.col("lines"), 100)).alias("i", "c")).select("doc_id", "i", F.octet_length("c").alias("bytes"))


def c10_embedding_text(spark, sf):
    d = t(spark, sf, "documents")
    page = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 5)
    text = chunk.embedding_text(F.concat(F.lit("f"), F.col("doc_id")), F.col("lang"), page, F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.substring(F.sha2(text, 256), 1, 16).alias("digest"))


def c7_metadata(spark, sf):
    d = t(spark, sf, "documents")
    base = F.create_map(F.lit("file_name"), F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.lit("doc_type"), F.lit("txt"))
    user = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("doc_type"), F.lit("own"), F.lit("group"), F.col("source")))
    m = chunk.merged_metadata(base, user)
    return d.select("doc_id", m["file_name"].alias("file_name"), m["doc_type"].alias("doc_type"), m["group"].alias("grp"), F.size(m).alias("keys"))


def e8_matched_links(spark, sf):
    """Links of a conversation are the words of its first turn that have four bytes or more; a turn has those that it contains."""
    turns = _turns(spark, sf)
    words = turns.where("chunk_index = 0").select("page_id", F.posexplode(F.array_distinct(F.filter(F.split("content", " "), lambda w: F.octet_length(w) >= 4))).alias("pos", "anchor_text"))
    links = words.withColumn("href", F.concat(F.lit("https://e/"), "pos"))
    got = chunk.matched_links(turns, links)
    return got.select("page_id", "chunk_index", F.size("links").alias("links"))


def n4_chunks(spark, sf):
    d = t(spark, sf, "documents").select(F.concat(F.lit("f"), F.col("doc_id") % 100).alias("file_name"), F.when(F.col("doc_id") % 4 == 0, "md").otherwise("txt").alias("doc_type"), F.col("doc_id").alias("source_idx"), F.lit(None).cast("bigint").alias("page"), F.col("text").alias("content"))
    return chunk.chunk_documents(d).select("file_name", "chunk_index", F.char_length("content").alias("chars"))


def n9_web_chunks(spark, sf):
    return chunk.chunk_pages(t(spark, sf, "pages"), "g", AT).select("url", "chunk_index", "content_type", "heading_path", "chunk_hash", "total_chunks", F.size("links").alias("links"))


def m1_sections(spark, sf):
    found = chunk.arrow_lists(lambda h: [{"heading_path": s["heading_path"], "content": s["content"]} for s in html.sections(h or "")[1]], "array<struct<heading_path: array<string>, content: string>>")
    rows = t(spark, sf, "pages").select("page_id", F.posexplode(found("html")).alias("i", "s"))
    return rows.select("page_id", "i", F.array_join("s.heading_path", " > ").alias("path"), F.char_length("s.content").alias("chars"))


def _page_links(h, u):
    try:
        return html.page_links(h or "", u or "")
    except ValueError:
        return []


def m5_page_links(spark, sf):
    found = chunk.arrow_lists(_page_links, "array<string>")
    return t(spark, sf, "pages").select("page_id", F.explode(found("html", "url")).alias("link"))


def m9_crawl(spark, sf):
    """A site of one page for each row of `pages`, page k leading to 2k + 1 and 2k + 2: six levels from page 0."""
    k = F.col("page_id")
    link = lambda n: F.concat(F.lit('<p><a href="/'), n.cast("string"), F.lit('">next</a></p>'))
    site = t(spark, sf, "pages").select(F.concat(F.lit("https://h/"), F.when(k > 0, k.cast("string")).otherwise("")).alias("url"), F.concat(link(k * 2 + 1), link(k * 2 + 2), F.lit('<a href="https://other/">out</a>')).alias("html"))
    return crawl.crawl(spark, site, "https://h/", 6, max_pages=0).select("url", "depth", "pos")


def a6_html_text(spark, sf):
    text = chunk.arrow_lists(lambda h: html.loader_text(h or ""), "string")
    return t(spark, sf, "pages").select("page_id", F.char_length(text("html")).alias("chars"))


def q3_claim(spark, sf):
    return jobs.claimed(job_rows(spark, sf), 25, NOW).select("id", "status", "updated_at", "progress_percentage")


def q4_reclaim(spark, sf):
    return jobs.reclaimed(job_rows(spark, sf), CUTOFF, NOW).select("id", "status", "updated_at", "error_message")


def q5_reset(spark, sf):
    return jobs.reset(job_rows(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def b11_progress(spark, sf):
    j = job_rows(spark, sf).withColumn("result", F.lit(None).cast("string"))
    u = j.where("id % 3 = 0").select("job_id", F.col("progress_percentage").alias("percentage"), F.when(F.col("id") % 2 == 0, "FINISHED").alias("status"), F.lit("ok").alias("result"), F.lit(None).cast("string").alias("error"))
    return jobs.progressed(j, u).select("id", "status", "progress_percentage", "result")


def e11_file_status(spark, sf):
    return jobs.files_after(files(spark, sf), job_rows(spark, sf)).select("id", "status")


def t9_active_jobs(spark, sf):
    return jobs.active_jobs(job_rows(spark, sf)).select("id", "status").agg(F.count(F.lit(1)).alias("active"), F.sum("id").alias("ids"))


def _events(spark, sf):
    return _event_rows(t(spark, sf, "events"))


def _event_rows(e):
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("job-"), F.col("user_id") % 500).alias("job_id"), F.when(F.col("event_id") % 37 == 0, "job_finished").when(F.col("event_id") % 41 == 0, "job_failed").otherwise("job_progress").alias("event"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 101).cast("int")).alias("percentage"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("message"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("f"), F.col("event_id") % 9)).alias("file_name"), F.when(F.col("event_id") % 2 == 0, "RUNNING").alias("status"), F.lit(None).cast("string").alias("result"), F.when(F.col("event_id") % 41 == 0, "bad").alias("error"),
    )


def q10_tracker(spark, sf):
    return tracker.fold(_events(spark, sf))


def q10_changes(spark, sf):
    return tracker.changes(_events(spark, sf)).select("seq", "job_id")


def q10_stream(spark, sf):
    """The tracker as a stream that runs until its input is done; the last state of every job."""
    schema = t(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = f"tracked_{uuid.uuid4().hex}"
    query = tracker.track(_event_rows(events)).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    w = W.partitionBy("job_id").orderBy(F.desc("events"))
    return spark.table(name).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def s3_path_tree(spark, sf):
    return views.path_tree(t(spark, sf, "pages").where("url IS NOT NULL"))


def s7_options(spark, sf):
    p = t(spark, sf, "part").select(F.when(F.col("p_partkey") == 7, "default").otherwise(F.col("p_brand")).alias("name"))
    return views.options(p, "name", "D")


def k28_labels(spark, sf):
    f = files(spark, sf)
    return f.select("id", views.day_label(F.col("created_at")).alias("day"))


def b13_snapshots(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("table"), F.col("o_orderkey").alias("stamp"))
    return views.kept_snapshots(o)


def i3_scope_union(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.array(F.col("p_brand"), F.lit("x"))).alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("x"), F.col("p_type"))).alias("b"))
    return views.scope_union(p, "a", "b").select("p_partkey", F.array_join("scope", ",").alias("scope"))


def k26_progress(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", jobs.linear_progress(F.col("p_size"), F.lit(50), 10, 95).alias("progress"))
    return p


QUERIES = {f.__name__: f for f in (g1_neighbours, g3_running_index, n7_merge, c10_embedding_text, c7_metadata, e8_matched_links, n4_chunks, n9_web_chunks, m1_sections, m5_page_links, m9_crawl, a6_html_text, q3_claim, q4_reclaim, q5_reset, b11_progress, e11_file_status, t9_active_jobs, q10_tracker, q10_changes, q10_stream, s3_path_tree, s7_options, k28_labels, b13_snapshots, i3_scope_union, k26_progress)}

_EVENTS = """e AS (SELECT event_id AS seq, 'job-' || (user_id % 500) AS job_id, CASE WHEN event_id % 37 = 0 THEN 'job_finished' WHEN event_id % 41 = 0 THEN 'job_failed' ELSE 'job_progress' END AS event, CASE WHEN event_id % 3 != 0 THEN CAST(event_id % 101 AS INTEGER) END AS percentage,
    CASE WHEN event_id % 5 = 0 THEN event_type END AS message, CASE WHEN event_id % 7 = 0 THEN 'f' || (event_id % 9) END AS file_name, CASE WHEN event_id % 2 = 0 THEN 'RUNNING' END AS status, CAST(NULL AS VARCHAR) AS result, CASE WHEN event_id % 41 = 0 THEN 'bad' END AS error FROM events)"""
_FIELD = "arg_max({0}, seq) FILTER ({0} IS NOT NULL) AS {0}"
_LAG = " AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER w" for c in ("event", *tracker.FIELDS))

ORACLE_SQL = {
    "m9_crawl": """WITH RECURSIVE r AS (SELECT 0::BIGINT AS k, 0 AS depth UNION ALL SELECT unnest([2 * r.k + 1, 2 * r.k + 2]), depth + 1 FROM r WHERE depth < 6 AND r.k IN (SELECT page_id FROM pages))
        SELECT 'https://h/' || CASE WHEN k > 0 THEN CAST(k AS VARCHAR) ELSE '' END AS url, depth, row_number() OVER (ORDER BY depth, k) - 1 AS pos FROM r""",
    "g1_neighbours": "SELECT conv_id AS page_id, turn AS chunk_index, 'c' || conv_id || '-' || turn AS id, lag('c' || conv_id || '-' || turn) OVER w AS prev_chunk_id, lead('c' || conv_id || '-' || turn) OVER w AS next_chunk_id, count(*) OVER (PARTITION BY conv_id) AS total_chunks, substr(sha256(coalesce(text, '')), 1, 16) AS chunk_hash FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "g3_running_index": "WITH l AS (SELECT source AS file_name, doc_id AS source_idx, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), p AS (SELECT file_name, source_idx, unnest(range(0, len(lines))) AS piece FROM l) SELECT file_name, source_idx, CAST(piece AS INTEGER) AS piece, CAST(row_number() OVER (PARTITION BY file_name ORDER BY source_idx, piece) - 1 AS INTEGER) AS chunk_index FROM p",
    "n7_merge": """WITH d AS (SELECT doc_id, list_reduce(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: [strlen(l)]), lambda a, x: CASE WHEN a[len(a)] >= 400 THEN list_concat(a, x) ELSE list_concat(a[1:len(a) - 1], [a[len(a)] + 1 + x[1]]) END) AS b FROM documents)
        SELECT doc_id, CAST(unnest(range(0, len(b))) AS INTEGER) AS i, CAST(unnest(b) AS INTEGER) AS bytes FROM d""",
    "c10_embedding_text": "SELECT doc_id, substr(sha256(concat_ws(chr(10), 'File_name: f' || doc_id, 'Type: ' || lang, CASE WHEN doc_id % 2 = 0 THEN 'Page: ' || (doc_id % 5) END, 'Content:' || chr(10) || coalesce(text, ''))), 1, 16) AS digest FROM documents",
    "c7_metadata": "SELECT doc_id, 'f' || doc_id AS file_name, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'txt' END AS doc_type, CASE WHEN doc_id % 3 = 0 THEN source END AS grp, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS keys FROM documents",
    "e8_matched_links": """WITH w AS (SELECT conv_id, list_distinct(list_filter(string_split(coalesce(text, ''), ' '), lambda x: strlen(x) >= 4)) AS all_words, list_filter(string_split(coalesce(text, ''), ' '), lambda x: strlen(x) >= 4) AS words FROM conversations WHERE turn = 0),
        o AS (SELECT conv_id, x, min(pos) AS pos FROM (SELECT conv_id, unnest(words) AS x, unnest(range(0, len(words))) AS pos FROM w) GROUP BY conv_id, x)
        SELECT c.conv_id AS page_id, c.turn AS chunk_index, CAST(count(o.x) FILTER (contains(coalesce(c.text, ''), o.x)) AS INTEGER) AS links FROM conversations c LEFT JOIN o ON o.conv_id = c.conv_id GROUP BY 1, 2""",
    "q3_claim": f"WITH {JOBS}, m AS (SELECT id FROM jobs WHERE status = 'PENDING' AND task_name IS NOT NULL ORDER BY created_at, id LIMIT 25) SELECT j.id, CASE WHEN m.id IS NULL THEN status ELSE 'RUNNING' END AS status, CASE WHEN m.id IS NULL THEN updated_at ELSE '{NOW}' END AS updated_at, CASE WHEN m.id IS NULL THEN progress_percentage ELSE 0 END AS progress_percentage FROM jobs j LEFT JOIN m ON m.id = j.id",
    "q4_reclaim": f"WITH {JOBS} SELECT id, CASE WHEN s THEN 'FAILED' ELSE status END AS status, CASE WHEN s THEN '{NOW}' ELSE updated_at END AS updated_at, CASE WHEN s THEN '{jobs.STALE_MESSAGE}' END AS error_message FROM (SELECT *, status = 'RUNNING' AND updated_at < '{CUTOFF}' AS s FROM jobs)",
    "q5_reset": f"WITH {JOBS} SELECT CASE status WHEN 'RUNNING' THEN 'PENDING' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1",
    "b11_progress": f"WITH {JOBS} SELECT id, CASE WHEN id % 6 = 0 THEN 'FINISHED' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN least(greatest(progress_percentage, 0), 100) ELSE progress_percentage END AS progress_percentage, CASE WHEN id % 6 = 0 THEN 'ok' END AS result FROM jobs",
    "e11_file_status": f"WITH {JOBS}, {FILES} SELECT f.id, CASE j.status WHEN 'FINISHED' THEN 'completed' WHEN 'FAILED' THEN 'failed' ELSE f.status END AS status FROM files f JOIN jobs j USING (storage_object_id)",
    "t9_active_jobs": f"WITH {JOBS} SELECT count(*) AS active, CAST(sum(id) AS BIGINT) AS ids FROM jobs WHERE status IN ('PENDING', 'RUNNING')",
    "q10_tracker": f"WITH {_EVENTS} SELECT job_id, {', '.join(_FIELD.format(c) for c in tracker.FIELDS)}, bool_or(event IN ('job_finished', 'job_failed')) AS completed, count(*) AS events FROM e GROUP BY job_id",
    "q10_changes": f"WITH {_EVENTS}, x AS (SELECT seq, job_id, row_number() OVER w > 1 AND {_LAG} AS same FROM e WINDOW w AS (PARTITION BY job_id ORDER BY seq)) SELECT seq, job_id FROM x WHERE NOT same",
    "q10_stream": f"WITH {_EVENTS} SELECT job_id, {', '.join(_FIELD.format(c) for c in tracker.FIELDS)}, bool_or(event IN ('job_finished', 'job_failed')) AS completed, count(*) AS events FROM e GROUP BY job_id",
    "s3_path_tree": """WITH p AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages WHERE url IS NOT NULL),
        n AS (SELECT host, parts, unnest(range(1, len(parts) + 1)) AS depth FROM p)
        SELECT host, '/' || array_to_string(parts[1:depth], '/') AS full_path, parts[depth] AS segment, CAST(depth AS INTEGER) AS depth, count(*) AS pages, bool_or(len(parts) > depth) AS is_branch, bool_or(len(parts) = depth) AS is_page FROM n GROUP BY ALL""",
    "s7_options": "SELECT DISTINCT CASE WHEN p_partkey = 7 THEN 'default' ELSE p_brand END AS name FROM part WHERE contains(lower(CASE WHEN p_partkey = 7 THEN 'default' ELSE p_brand END), 'd')",
    "k28_labels": f"WITH {FILES} SELECT id, strftime(strptime(created_at, '%Y-%m-%dT%H:%M:%SZ'), '%b %-d, %Y') AS day FROM files",
    "b13_snapshots": "SELECT o_orderstatus AS \"table\", o_orderkey AS stamp FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) <= 5",
    "i3_scope_union": "SELECT p_partkey, CASE WHEN p_partkey % 3 != 0 AND p_partkey % 2 = 0 THEN p_brand || ',x,' || p_type WHEN p_partkey % 3 != 0 THEN p_brand || ',x' WHEN p_partkey % 2 = 0 THEN 'x,' || p_type ELSE '' END AS scope FROM part",
    "k26_progress": "SELECT p_partkey, CAST(least(greatest(floor(p_size * 85 / 50.0) + 10, 10), 95) AS INTEGER) AS progress FROM part",
}
