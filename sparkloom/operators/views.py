"""What users' views are made of: path trees, option lists, forms and payloads, labels, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.functions.text import strip_job_prefix

KEPT_SNAPSHOTS = 5


def by_depth(pages: DataFrame) -> DataFrame:
    """URLs by depth of their path, then as text."""
    return pages.orderBy(urls.depth_column(F.col("url")), "url")


def by_host(pages: DataFrame, base: str) -> DataFrame:
    """(host, urls), the base's host first, others by name. The list of a host is what one view shows."""
    host = urls.host_column(F.col("url"))
    lists = pages.groupBy(host.alias("host")).agg(F.sort_array(F.collect_list("url")).alias("urls"))
    return lists.orderBy(F.when(F.col("host") == base.lower(), 0).otherwise(1), "host")


def path_tree(pages: DataFrame) -> DataFrame:
    """S3: every prefix of every path once: (host, full_path, segment, depth, pages below, is_branch, is_page)."""
    parts = F.filter(F.split(urls.path_column(F.col("url")), "/"), lambda x: x != "")
    rows = pages.select(urls.host_column(F.col("url")).alias("host"), parts.alias("parts")).distinct()
    nodes = rows.where(F.size("parts") > 0).select("host", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    named = nodes.select("host", F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).alias("full_path"), F.element_at("parts", F.col("depth")).alias("segment"), "depth", (F.size("parts") == F.col("depth")).alias("end"))
    return named.groupBy("host", "full_path", "segment", "depth").agg(F.count(F.lit(1)).alias("pages"), F.max(~F.col("end")).alias("is_branch"), F.max("end").alias("is_page"))


def options(df: DataFrame, column: str, search: str = "", first: str | None = "default") -> DataFrame:
    """Options that contain the text in any case, the default one first, others by name."""
    rows = df.where(F.lower(F.col(column)).contains(search.lower())) if search else df
    return rows.select(column).distinct().orderBy(F.when(F.col(column) == first, 0).otherwise(1), column)


def query_payload(query: str, collection: str, key: str, selected: list[str], limit: int | None = None) -> dict:
    """Trimmed query, any of the selected values."""
    where = {} if not selected else {key: selected[0]} if len(selected) == 1 else {"$or": [{key: v} for v in selected]}
    return {"collection": collection, "query": query.strip(), "limit": limit, "where": where}


def tool_scopes(repos: list[str], groups: list[str], websites: list[str]) -> list[dict]:
    """Scopes of a tool's form; websites and groups of documents are one list, each value once."""
    out = [{"collection": "codebase", "repo_names": repos}] if repos else []
    both = list(dict.fromkeys([*groups, *websites]))
    return out + ([{"collection": "general", "group_ids": both}] if both else [])


def tool_form(scopes: list[dict], website_groups: set[str]) -> dict[str, list[str]]:
    """S6, the other way."""
    groups = [g for s in scopes for g in s.get("group_ids", [])]
    return {"repos": [r for s in scopes for r in s.get("repo_names", [])], "groups": [g for g in groups if g not in website_groups], "websites": [g for g in groups if g in website_groups]}


def scope_union(tools: DataFrame, a: str, b: str) -> DataFrame:
    """I3 as a column: the union of two lists."""
    return tools.withColumn("scope", F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def day_label(time: Column) -> Column:
    """`Mon d, yyyy` of an ISO text; what is no time stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(time), "MMM d, yyyy"), time)


def shown_name(name: Column) -> Column:
    """A stored file's name without its job's id."""
    return strip_job_prefix(name)


def kept_snapshots(snapshots: DataFrame, keep: int = KEPT_SNAPSHOTS) -> DataFrame:
    """The newest snapshots (table, stamp) of every table; others may be deleted."""
    w = W.partitionBy("table").orderBy(F.desc("stamp"))
    return snapshots.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
