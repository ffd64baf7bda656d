"""Collections and catalog: facets, joins, mutations, listings, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import catalog, collection
from sparkloom.plans.common import FILES, POINTS, SERVERS, TOOLS, files, points, scopes, scopes_sql, servers, t, tools


def _zip_points(spark, sf):
    d = t(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(
        F.concat(F.lit("p"), k).alias("id"), F.when(k % 6 != 0, F.concat(F.lit("repo"), k % 40, F.when(k % 40 % 3 == 0, ".zip").otherwise(".ZIP"))).alias("zip_filename"), F.when(k % 40 % 5 == 0, "other").when(k % 40 % 5 == 1, F.concat(F.lit("repo"), k % 40)).when(k % 2 == 0, "").alias("repo_name"),
    )


_ZIP = """z AS (SELECT 'p' || doc_id AS id, CASE WHEN doc_id % 6 != 0 THEN 'repo' || (doc_id % 40) || CASE WHEN doc_id % 40 % 3 = 0 THEN '.zip' ELSE '.ZIP' END END AS zip_filename,
    CASE WHEN doc_id % 40 % 5 = 0 THEN 'other' WHEN doc_id % 40 % 5 = 1 THEN 'repo' || (doc_id % 40) WHEN doc_id % 2 = 0 THEN '' END AS repo_name FROM documents)"""


def _web_points(spark, sf):
    e = t(spark, sf, "events")
    key = F.concat(F.lit('["https://w'), F.col("user_id") % 37, F.lit('.example","g'), F.col("user_id") % 5, F.lit('","2024-0'), F.col("event_id") % 9 + 1, F.lit('-01T00:00:00Z"]'))
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 4 != 0, "website").otherwise("txt").alias("doc_type"), F.concat(F.lit("https://w"), F.col("user_id") % 37, F.lit(".example")).alias("url"), F.concat(F.lit("g"), F.col("user_id") % 5).alias("group"),
        F.when(F.col("event_id") % 11 == 0, '["broken"').when(F.col("event_id") % 13 == 0, '["a","b"]').otherwise(key).alias("website_key"),
    )


_WEB = """w AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 != 0 THEN 'website' ELSE 'txt' END AS doc_type, 'https://w' || (user_id % 37) || '.example' AS url, 'g' || (user_id % 5) AS "group",
    event_id % 11 != 0 AND event_id % 13 != 0 AS good, '2024-0' || (event_id % 9 + 1) || '-01T00:00:00Z' AS stamp FROM events)"""


def f2_facet(spark, sf):
    return collection.facet(points(spark, sf), "group", F.col("lang") == "en")


def f3_website_facet(spark, sf):
    return collection.facet(_web_points(spark, sf), "website_key", catalog.is_website(), catalog.WEBSITE_FACETS)


def f4_websites(spark, sf):
    return catalog.list_websites(_web_points(spark, sf)).select("url", "pages", "embedded_at")


def b3_upsert(spark, sf):
    p = points(spark, sf).select("id", "group", "size")
    new = points(spark, sf).where("size % 3 = 0").select("id", F.lit("new").alias("group"), (F.col("size") + 1).alias("size")).unionByName(spark.sql("SELECT 'added' AS id, 'new' AS `group`, CAST(1 AS BIGINT) AS size"))
    return collection.upserted(p, new)


def b4_delete(spark, sf):
    return collection.deleted(points(spark, sf), where={"$or": [{"group": "src0"}, {"doc_type": "website"}]}).select("id")


def b6_replace(spark, sf):
    p = points(spark, sf)
    return collection.deleted(p, where=collection.replacement_clause("general", file_name="doc_8.txt", group="src0")).select("id", "file_name")


def b7_repair(spark, sf):
    return collection.repaired_repo_names(_zip_points(spark, sf))


def b8_set_payload(spark, sf):
    return collection.set_payload(points(spark, sf), F.col("doc_type") == "txt", {"group": "moved"}).select("id", "group")


def c5_files(spark, sf):
    return catalog.file_rows(files(spark, sf))


def t1_documents(spark, sf):
    return catalog.list_documents(files(spark, sf))


def e4_repos(spark, sf):
    f = files(spark, sf)
    p = _zip_points(spark, sf)
    return catalog.list_repos(catalog.repo_names(p, f), f)


def t3_delete_repo(spark, sf):
    return catalog.without_repo(_zip_points(spark, sf), files(spark, sf), "repo3")[1].select("id", "status")


def t4_delete_document(spark, sf):
    return catalog.document_to_delete(files(spark, sf), "f4.pdf").select("id", "full_path")


def t5_delete_group(spark, sf):
    return catalog.without_group(_web_points(spark, sf), "g1").select("id")


def t6_clear(spark, sf):
    return catalog.cleared(_web_points(spark, sf), "general").select("id")


def t7_delete_website(spark, sf):
    return catalog.without_websites(_web_points(spark, sf), url="https://w3.example").select("id")


def t8_values(spark, sf):
    p = points(spark, sf)
    return catalog.metadata_values(p, "doc_type").unionByName(catalog.metadata_values(p, "even"))


def e1_active_tools(spark, sf):
    return catalog.active_tools(tools(spark, sf), servers(spark, sf)).select("id", "name", "server_name", "created_at")


def e2_tool_scopes(spark, sf):
    got = catalog.with_scopes(tools(spark, sf), scopes(spark, sf, "code"), scopes(spark, sf, "document"))
    one = lambda c: F.array_join(F.flatten(F.transform(c, lambda s: s["names"])), ",")
    return got.select("id", F.size("code_scopes").alias("code"), one("code_scopes").alias("repos"), F.size("document_scopes").alias("documents"), one("document_scopes").alias("groups"))


def e3_servers(spark, sf):
    return catalog.list_servers(servers(spark, sf), tools(spark, sf)).select("id", "name", F.array_join("tools", ",").alias("tools"))


def t11_delete_server(spark, sf):
    left = catalog.without_server(servers(spark, sf), tools(spark, sf), scopes(spark, sf, "code"), scopes(spark, sf, "document"), 3)
    return left[0].agg(F.count(F.lit(1)).alias("servers")).join(left[1].agg(F.count(F.lit(1)).alias("tools")), how="cross").join(left[2].agg(F.count(F.lit(1)).alias("code")), how="cross").join(left[3].agg(F.count(F.lit(1)).alias("documents")), how="cross")


def s4_group_options(spark, sf):
    p, f = _web_points(spark, sf).withColumn("repo_name", F.lit("")), files(spark, sf)
    o = catalog.scope_options(p.withColumn("group", F.when(F.col("doc_type") == "txt", F.concat("group", F.lit("t"))).otherwise(F.col("group"))), f)
    tag = lambda k, c: o[k].select(F.lit(k).alias("kind"), F.col(c).alias("value"))
    return tag("repos", "repo_name").unionByName(tag("groups", "group")).unionByName(tag("websites", "group"))


def f14_dashboard(spark, sf):
    f = files(spark, sf)
    return catalog.dashboard(catalog.repo_names(_zip_points(spark, sf), f), catalog.list_documents(f), catalog.list_websites(_web_points(spark, sf)), servers(spark, sf), tools(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (f2_facet, f3_website_facet, f4_websites, b3_upsert, b4_delete, b6_replace, b7_repair, b8_set_payload, c5_files, t1_documents, e4_repos, t3_delete_repo, t4_delete_document, t5_delete_group, t6_clear, t7_delete_website, t8_values, e1_active_tools, e2_tool_scopes, e3_servers, t11_delete_server, s4_group_options, f14_dashboard)
}

_NAMES = f"""{FILES}, {_ZIP}, names AS (SELECT DISTINCT repo_name FROM (SELECT repo_name FROM z UNION ALL SELECT repo_name FROM files WHERE status = 'completed' AND collection = 'codebase') WHERE trim(repo_name) <> '')"""

ORACLE_SQL = {
    "f2_facet": f"WITH {POINTS} SELECT \"group\" AS value, count(*) AS n FROM points WHERE lang = 'en' AND \"group\" IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 1000",
    "f3_website_facet": """WITH k AS (SELECT CASE WHEN event_id % 11 = 0 THEN '["broken"' WHEN event_id % 13 = 0 THEN '["a","b"]' ELSE '["https://w' || (user_id % 37) || '.example","g' || (user_id % 5) || '","2024-0' || (event_id % 9 + 1) || '-01T00:00:00Z"]' END AS value FROM events WHERE event_id % 4 != 0) SELECT value, count(*) AS n FROM k GROUP BY value ORDER BY n DESC, value LIMIT 10000""",
    "f4_websites": f"WITH {_WEB} SELECT url, CAST(count(*) AS BIGINT) AS pages, max(stamp) AS embedded_at FROM w WHERE doc_type = 'website' AND good GROUP BY url",
    "b3_upsert": f"WITH {POINTS} SELECT id, \"group\", size FROM points WHERE size % 3 <> 0 UNION ALL SELECT id, 'new', size + 1 FROM points WHERE size % 3 = 0 UNION ALL SELECT 'added', 'new', 1",
    "b4_delete": f"WITH {POINTS} SELECT id FROM points WHERE NOT (coalesce(\"group\" = 'src0', false) OR coalesce(doc_type = 'website', false))",
    "b6_replace": f"WITH {POINTS} SELECT id, file_name FROM points WHERE NOT coalesce(file_name = 'doc_8.txt' AND \"group\" = 'src0', false)",
    "b7_repair": f"""WITH {_ZIP}, g AS (SELECT zip_filename, regexp_replace(zip_filename, '\\.(zip|ZIP)$', '') AS wanted, count(*) FILTER (trim(coalesce(repo_name, '')) <> '' AND repo_name <> regexp_replace(zip_filename, '\\.(zip|ZIP)$', '')) AS others FROM z WHERE zip_filename IS NOT NULL GROUP BY 1, 2)
        SELECT z.id, z.zip_filename, CASE WHEN g.others = 0 THEN g.wanted ELSE z.repo_name END AS repo_name FROM z LEFT JOIN g USING (zip_filename)""",
    "b8_set_payload": f"WITH {POINTS} SELECT id, CASE WHEN doc_type = 'txt' THEN 'moved' ELSE \"group\" END AS \"group\" FROM points",
    "c5_files": f"WITH {FILES} SELECT split_part(full_path, '/', -1) AS filename, file_type, size_bytes, created_at, storage_object_id, coalesce(group_id, '') AS \"group\" FROM files",
    "t1_documents": f"WITH {FILES} SELECT split_part(full_path, '/', -1) AS filename, file_type, size_bytes, created_at, storage_object_id, coalesce(group_id, '') AS \"group\" FROM files WHERE status = 'completed' AND collection = 'general' ORDER BY coalesce(created_at, '') DESC, storage_object_id",
    "e4_repos": f"WITH {_NAMES}, last AS (SELECT * FROM files WHERE status = 'completed' AND collection = 'codebase' QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY id DESC) = 1) SELECT n.repo_name, l.storage_object_id, l.size_bytes, l.created_at FROM names n LEFT JOIN last l USING (repo_name)",
    "t3_delete_repo": f"WITH {FILES} SELECT id, status FROM files WHERE NOT coalesce(repo_name = 'repo3' AND status = 'completed', false)",
    "t4_delete_document": f"WITH {FILES} SELECT id, full_path FROM files WHERE status = 'completed' AND split_part(full_path, '/', -1) = 'f4.pdf' ORDER BY id LIMIT 1",
    "t5_delete_group": f"WITH {_WEB} SELECT id FROM w WHERE NOT (\"group\" = 'g1' AND doc_type <> 'website')",
    "t6_clear": f"WITH {_WEB} SELECT id FROM w WHERE doc_type = 'website'",
    "t7_delete_website": f"WITH {_WEB} SELECT id FROM w WHERE NOT (doc_type = 'website' AND url = 'https://w3.example')",
    "t8_values": f"WITH {POINTS} SELECT DISTINCT doc_type AS value FROM points WHERE doc_type IS NOT NULL UNION ALL SELECT DISTINCT CAST(even AS VARCHAR) FROM points",
    "e1_active_tools": f"WITH {SERVERS}, {TOOLS} SELECT t.id, t.name, s.name AS server_name, t.created_at FROM tools t JOIN servers s ON s.id = t.server_id WHERE t.active AND s.active",
    "e2_tool_scopes": f"""WITH {TOOLS}, {scopes_sql("code")}, {scopes_sql("document")} SELECT t.id, CAST((c.tool_id IS NOT NULL) AS INTEGER) AS code, coalesce(replace(replace(replace(c.repo_names, '[', ''), ']', ''), '"', ''), '') AS repos,
        CAST((d.tool_id IS NOT NULL) AS INTEGER) AS documents, coalesce(replace(replace(replace(d.group_ids, '[', ''), ']', ''), '"', ''), '') AS groups FROM tools t LEFT JOIN code_scopes c ON c.tool_id = t.id LEFT JOIN document_scopes d ON d.tool_id = t.id""",
    "e3_servers": f"WITH {SERVERS}, {TOOLS} SELECT s.id, s.name, coalesce(string_agg(t.name, ',' ORDER BY t.created_at, t.id), '') AS tools FROM servers s LEFT JOIN tools t ON t.server_id = s.id GROUP BY s.id, s.name",
    "t11_delete_server": f"""WITH {SERVERS}, {TOOLS}, {scopes_sql("code")}, {scopes_sql("document")}, gone AS (SELECT id FROM tools WHERE server_id = 3) SELECT (SELECT count(*) FROM servers WHERE id <> 3) AS servers, (SELECT count(*) FROM tools WHERE server_id <> 3) AS tools,
        (SELECT count(*) FROM code_scopes WHERE tool_id NOT IN (SELECT id FROM gone)) AS code, (SELECT count(*) FROM document_scopes WHERE tool_id NOT IN (SELECT id FROM gone)) AS documents""",
    "s4_group_options": f"WITH {FILES}, {_WEB} SELECT DISTINCT 'repos' AS kind, repo_name AS value FROM files WHERE status = 'completed' AND collection = 'codebase' AND trim(repo_name) <> '' UNION ALL SELECT DISTINCT 'groups', \"group\" || 't' FROM w WHERE doc_type = 'txt' UNION ALL SELECT DISTINCT 'websites', \"group\" FROM w WHERE doc_type = 'website'",
    "f14_dashboard": f"WITH {_NAMES}, {_WEB}, {SERVERS}, {TOOLS} SELECT 'repos' AS what, (SELECT count(*) FROM names) AS n UNION ALL SELECT 'documents', (SELECT count(*) FROM files WHERE status = 'completed' AND collection = 'general') UNION ALL SELECT 'websites', (SELECT count(DISTINCT url) FROM w WHERE doc_type = 'website' AND good) UNION ALL SELECT 'servers', (SELECT count(*) FROM servers) UNION ALL SELECT 'tools', (SELECT count(*) FROM tools)",
}
