"""Text, path and URL scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import paths, urls
from sparkloom.functions import text as tx
from sparkloom.plans.common import FILES, files, t

START = "https://site0.example/"


def _pages(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))


def k7_normalize(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.regexp_replace("text", r"\. ", ".  \t\r\n\n\n\n"), F.lit("\n")).alias("code"))
    n = tx.normalize_code(F.col("code"))
    return d.select("doc_id", F.char_length(n).alias("chars"), F.substring(F.sha2(n, 256), 1, 12).alias("digest"))


def k10_hard_split(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(tx.hard_split(F.coalesce("text", F.lit("")), 600)).alias("i", "piece"))
    return d.select("doc_id", "i", F.char_length("piece").alias("chars"), F.substring(F.sha2("piece", 256), 1, 12).alias("digest"))


def k6_clamp(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.char_length(tx.clamp(F.coalesce("text", F.lit("")))).alias("chars"))


def k19_names(spark, sf):
    f = files(spark, sf)
    zip_name = F.concat(F.lit("a\\b/"), F.col("storage_object_id"), F.when(F.col("id") % 2 == 0, ".ZIP").otherwise(".zip"))
    job = F.concat(F.when(F.col("id") % 2 == 0, "0123abcd-0123-0123-0123-0123456789ab_").otherwise("0123abcd0123012301230123456789ab_"), tx.basename(F.col("full_path")))
    return f.select(
        "id", tx.basename(F.col("full_path")).alias("base"), tx.extension(F.col("full_path")).alias("ext"), tx.repo_of_zip(zip_name).alias("repo"), tx.strip_zip(zip_name).alias("stripped"),
        tx.strip_job_prefix(job).alias("plain"), tx.strip_job_prefix(job, strict=True).alias("strict"), tx.size_label(F.col("size_bytes")).alias("label"),
    )


def k21_collapse(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.substring(F.sha2(tx.collapse_space(F.coalesce("text", F.lit(""))), 256), 1, 12).alias("digest"))


def p4_content_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


def d9_skip_rules(spark, sf):
    names = F.array(*map(F.lit, ("src/main.rs", "a/Node_Modules/x.js", "dist\\x.js", "lib/a.min.js", "Cargo.lock", "img/logo.PNG", "b/Tests/t.py", "docs/index.md", "data.tar", "c/.DS_Store", "x/spec.rb")))
    p = t(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 11 + 1).cast("int")).alias("path"))
    return p.select("p_partkey", "path", paths.skipped(F.col("path")).alias("skip"), paths.is_code(F.col("path")).alias("code"), paths.language_column(F.col("path")).alias("language"))


def d11_scope(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", urls.scope_column(F.col("url"), "https://site1.example/a").alias("scoped"))


def d12_ignored_hosts(spark, sf):
    hosts = F.array(*map(F.lit, ("x.com", "www.x.com", "ax.com", "docs.python.org", "m.facebook.com", "outlook.live.com", "live.com")))
    p = t(spark, sf, "part").select("p_partkey", F.element_at(hosts, (F.col("p_partkey") % 7 + 1).cast("int")).alias("host"))
    return p.select("p_partkey", "host", urls.ignored_column(F.col("host")).alias("ignored"))


def l3_canonical(spark, sf):
    p = _pages(spark, sf).withColumn("u", F.concat("url", F.when(F.col("page_id") % 3 == 0, "///#frag").when(F.col("page_id") % 3 == 1, "/?q=1#x").otherwise("")))
    u = F.col("u")
    return p.select("page_id", urls.canonical_column(u).alias("canonical"), urls.origin_column(u).alias("origin"), urls.host_column(u).alias("host"), urls.depth_column(u).alias("depth"))


def l10_website_key(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", urls.website_key(F.col("url"), F.concat(F.lit("g"), F.col("page_id") % 5), F.lit("2024-01-01T00:00:00Z")).alias("website_key"))


def s2_hosts(spark, sf):
    """Pages by host: the start's first, others by name; URLs by depth, then text."""
    p = _pages(spark, sf).select("url", urls.host_column(F.col("url")).alias("host"), urls.depth_column(F.col("url")).alias("depth"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.element_at(F.array_sort(F.collect_list(F.struct("depth", "url"))), 1)["url"].alias("first_url"))


def d13_html(spark, sf):
    p = t(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    head = F.lower(F.substring("html", 1, 64))
    return p.select("page_id", ((F.octet_length("html") >= 64) & (head.contains("<html") | head.contains("<!doctype html"))).alias("is_html"))


QUERIES = {f.__name__: f for f in (k7_normalize, k10_hard_split, k6_clamp, k19_names, k21_collapse, p4_content_hash, d9_skip_rules, d11_scope, d12_ignored_hosts, l3_canonical, l10_website_key, s2_hosts, d13_html)}

_PATHS = "['src/main.rs', 'a/Node_Modules/x.js', 'dist\\x.js', 'lib/a.min.js', 'Cargo.lock', 'img/logo.PNG', 'b/Tests/t.py', 'docs/index.md', 'data.tar', 'c/.DS_Store', 'x/spec.rb']"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_P = "p AS (SELECT page_id, coalesce(url, '') AS url FROM pages)"

ORACLE_SQL = {
    "k7_normalize": r"""WITH d AS (SELECT doc_id, replace(text, '. ', '.  ' || chr(9) || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) || chr(10) AS code FROM documents),
        a AS (SELECT doc_id, regexp_replace(replace(code, chr(13) || chr(10), chr(10)), '\n\z', '') AS code FROM d), b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(code, '[ \t\r\f\v]+\n', chr(10), 'g'), '[ \t\r\f\v]+\z', ''), '\n{3,}', chr(10) || chr(10), 'g') AS code FROM a),
        c AS (SELECT doc_id, CASE WHEN regexp_replace(code, '\s+', '', 'g') = '' THEN chr(10) ELSE code END AS code FROM b) SELECT doc_id, length(code) AS chars, substr(sha256(code), 1, 12) AS digest FROM c""",
    "k10_hard_split": "SELECT doc_id, CAST(i AS INTEGER) AS i, length(piece) AS chars, substr(sha256(piece), 1, 12) AS digest FROM (SELECT doc_id, i, substr(x, CAST(i * 600 + 1 AS BIGINT), 600) AS piece FROM (SELECT doc_id, coalesce(text, '') AS x, unnest(range(0, greatest(length(coalesce(text, '')) - 1, 0) // 600 + 1)) AS i FROM documents))",
    "k6_clamp": "SELECT doc_id, length(substr(coalesce(text, ''), 1, 4000)) AS chars FROM documents",
    "k19_names": f"""WITH {FILES}, z AS (SELECT *, split_part(full_path, '/', -1) AS base, 'a\\b/' || storage_object_id || CASE WHEN id % 2 = 0 THEN '.ZIP' ELSE '.zip' END AS zip FROM files)
        SELECT id, base, CASE WHEN id % 3 = 0 THEN 'rs' ELSE 'pdf' END AS ext, storage_object_id AS repo, 'a\\b/' || storage_object_id AS stripped, base AS plain,
        CASE WHEN id % 2 = 0 THEN base ELSE '0123abcd0123012301230123456789ab_' || base END AS strict, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' ELSE printf('%.1f', round(size_bytes / 1024.0, 1)) || ' KB' END AS label FROM z""",
    "k21_collapse": r"SELECT doc_id, substr(sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), 1, 12) AS digest FROM documents",
    "p4_content_hash": "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash FROM documents",
    "d9_skip_rules": f"""WITH p AS (SELECT p_partkey, {_PATHS}[CAST(p_partkey % 11 + 1 AS INTEGER)] AS path FROM part), q AS (SELECT *, lower(replace(path, '\\', '/')) AS l FROM p), r AS (SELECT *, split_part(l, '/', -1) AS name FROM q), e AS (SELECT *, regexp_extract(l, '[^/.]\\.([^./]+)$', 1) AS ext FROM r)
        SELECT p_partkey, path, ext IN {_in(paths.IMAGES + paths.SKIP_EXTENSIONS)} OR name IN {_in(paths.SKIP_NAMES)} OR regexp_matches(name, '(\\.min\\.(js|mjs|cjs|css)|\\.bundle\\.js)$') OR list_has_any(string_split(l, '/'), [{_in(paths.SKIP_FOLDERS)[1:-1]}]) AS skip,
        ext IN {_in(paths.LANGUAGES)} AS code, CASE ext WHEN 'rs' THEN 'Rust' WHEN 'js' THEN 'JavaScript' WHEN 'py' THEN 'Python' END AS language FROM e""",
    "d11_scope": f"WITH {_P} SELECT page_id, regexp_matches(url, '^https://site1\\.example(:443)?/a/*([?#].*)?$') OR regexp_matches(url, '^https://site1\\.example(:443)?/a/') AS scoped FROM p",
    "d12_ignored_hosts": "SELECT p_partkey, host, host IN ('x.com', 'www.x.com', 'm.facebook.com', 'outlook.live.com') AS ignored FROM (SELECT p_partkey, ['x.com', 'www.x.com', 'ax.com', 'docs.python.org', 'm.facebook.com', 'outlook.live.com', 'live.com'][CAST(p_partkey % 7 + 1 AS INTEGER)] AS host FROM part)",
    "l3_canonical": f"""WITH {_P}, q AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '///#frag' WHEN 1 THEN '/?q=1#x' ELSE '' END AS u FROM p)
        SELECT page_id, regexp_replace(regexp_replace(u, '#.*$', ''), '/+$', '') AS canonical, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' AS origin, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
        CAST(len(list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS INTEGER) AS depth FROM q""",
    "l10_website_key": f"WITH {_P} SELECT page_id, '[\"' || url || '\",\"g' || (page_id % 5) || '\",\"2024-01-01T00:00:00Z\"]' AS website_key FROM p",
    "s2_hosts": f"""WITH {_P}, q AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, len(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS depth FROM p)
        SELECT host, count(*) AS pages, first(url ORDER BY depth, url) AS first_url FROM q GROUP BY host""",
    "d13_html": "SELECT page_id, strlen(coalesce(html, '')) >= 64 AND (contains(lower(substr(html, 1, 64)), '<html') OR contains(lower(substr(html, 1, 64)), '<!doctype html')) AS is_html FROM pages",
}
