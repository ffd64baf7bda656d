"""The catalog: listings of files, repositories and websites, deletions, servers, tools and their scopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.limits import max_chunk_limit
from sparkloom.functions.text import basename
from sparkloom.plans.predicate import but_not

WEBSITE_FACETS = 10_000


def is_website() -> Column:
    return F.col("doc_type") == "website"


def file_rows(files: DataFrame) -> DataFrame:
    """What users see of a file."""
    return files.select(basename(F.col("full_path")).alias("filename"), "file_type", "size_bytes", "created_at", "storage_object_id", F.coalesce("group_id", F.lit("")).alias("group"))


def list_documents(files: DataFrame) -> DataFrame:
    """Completed files of the general collection, newest first."""
    rows = file_rows(files.where("status = 'completed' AND collection = 'general'"))
    return rows.orderBy(F.desc(F.coalesce("created_at", F.lit(""))), "storage_object_id")


def repo_names(points: DataFrame, files: DataFrame) -> DataFrame:
    """Names in the collection or among the completed code files."""
    a = points.select("repo_name")
    b = files.where("status = 'completed' AND collection = 'codebase'").select("repo_name")
    return a.union(b).where("trim(repo_name) <> ''").distinct()


def list_repos(names: DataFrame, files: DataFrame) -> DataFrame:
    """Each name with its last completed file row, if it has one."""
    w = W.partitionBy("repo_name").orderBy(F.desc("id"))
    last = files.where("status = 'completed' AND collection = 'codebase' AND repo_name IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return names.join(last.select("repo_name", "storage_object_id", "size_bytes", "created_at"), "repo_name", "left")


def list_websites(points: DataFrame, limit: int = WEBSITE_FACETS) -> DataFrame:
    """By URL the pages of all its versions, the latest time and that version's group (ties: the first key)."""
    keys = points.where(is_website() & F.col("website_key").isNotNull()).groupBy("website_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "website_key").limit(limit)
    parts = F.from_json("website_key", "array<string>")
    known = keys.withColumn("p", parts).where((F.size("p") >= 3) & ~F.exists("p", lambda x: x.isNull()))
    rows = known.select(F.element_at("p", 1).alias("url"), F.element_at("p", 2).alias("g"), F.element_at("p", 3).alias("at"), "n", "website_key")
    best = F.max_by("g", F.struct("at", "n", "website_key"))
    return rows.groupBy("url").agg(F.sum("n").alias("pages"), F.max("at").alias("embedded_at"), best.alias("group")).orderBy("url")


def without_group(points: DataFrame, group: str) -> DataFrame:
    """T5: a group's points go, its websites stay."""
    return points.where(~but_not(F.coalesce(F.col("group") == group, F.lit(False)), is_website()))


def without_repo(points: DataFrame, files: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Points and completed file rows."""
    gone = (F.col("repo_name") == repo) & (F.col("status") == "completed")
    return points.where(~F.coalesce(F.col("repo_name") == repo, F.lit(False))), files.where(~F.coalesce(gone, F.lit(False)))


def document_to_delete(files: DataFrame, name: str) -> DataFrame:
    """T4: the first completed row of that base name."""
    return files.where((F.col("status") == "completed") & (basename(F.col("full_path")) == name)).orderBy("id").limit(1)


def without_document(points: DataFrame, files: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """T4: (points of the general collection without that file's, files without its first completed row)."""
    gone = document_to_delete(files, name)
    kept = points.where(~F.coalesce(F.col("file_name") == name, F.lit(False)))
    return kept, files.join(gone.select("id"), "id", "left_anti")


def cleared(points: DataFrame, collection: str) -> DataFrame:
    """Of the general collection websites stay."""
    return points.where(F.coalesce(is_website(), F.lit(False))) if collection == "general" else points.where(F.lit(False))


def without_websites(points: DataFrame, url: str | None = None, group: str | None = None) -> DataFrame:
    """One website, a group's, or all."""
    gone = is_website()
    if url is not None:
        gone = gone & (F.col("url") == url)
    if group is not None:
        gone = gone & (F.col("group") == group)
    return points.where(~F.coalesce(gone, F.lit(False)))


def metadata_values(points: DataFrame, key: str) -> DataFrame:
    """Distinct values of a key as text."""
    kind = dict(points.dtypes)[key]
    text = F.col(key) if kind == "string" else F.to_json(key) if kind.startswith(("struct", "array", "map")) else F.col(key).cast("string")
    return points.where(F.col(key).isNotNull()).select(text.alias("value")).distinct()


def active_tools(tools: DataFrame, servers: DataFrame, server: str | None = None) -> DataFrame:
    """Active tools of active servers, oldest first. Spark broadcasts the servers where their size allows."""
    s = servers.where("active").select(F.col("id").alias("server_id"), F.col("name").alias("server_name"))
    if server is not None:
        s = s.where(F.col("server_name") == server)
    return tools.where("active").join(s, "server_id").orderBy("created_at", "id")


def with_scopes(tools: DataFrame, code: DataFrame, documents: DataFrame) -> DataFrame:
    """Each tool with the lists of its scopes, empty if there are none; lists are JSON text."""
    out = tools
    for name, scopes, key in (("code_scopes", code, "repo_names"), ("document_scopes", documents, "group_ids")):
        one = F.struct("collection", F.coalesce(F.from_json(key, "array<string>"), F.array().cast("array<string>")).alias("names"))
        lists = scopes.groupBy(F.col("tool_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias(name))
        empty = F.array().cast("array<struct<collection:string,names:array<string>>>")
        out = out.join(lists, "id", "left").withColumn(name, F.coalesce(name, empty))
    return out


def list_servers(servers: DataFrame, tools: DataFrame) -> DataFrame:
    """Servers with their tools' names in order of creation."""
    own = tools.groupBy(F.col("server_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("tid"), "name"))), lambda x: x["name"]).alias("tools"))
    return servers.join(own, "id", "left").withColumn("tools", F.coalesce("tools", F.array().cast("array<string>"))).orderBy("created_at", "id")


def valid_server_name(name: str) -> str:
    """D21."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name.strip()):
        raise ValueError("a server's name has letters, digits and underscores only")
    return name.strip()


def with_server(servers: DataFrame, row: dict) -> DataFrame:
    """Names are unique."""
    name = valid_server_name(row["name"])
    if servers.where(F.col("name") == name).limit(1).count():
        raise ValueError(f"there is a server {name}")
    return servers.unionByName(servers.sparkSession.createDataFrame([row | {"name": name}], servers.schema))


def without_server(servers: DataFrame, tools: DataFrame, code: DataFrame, documents: DataFrame, server_id: int) -> tuple[DataFrame, ...]:
    """With its tools and their scopes."""
    gone = tools.where(F.col("server_id") == server_id).select(F.col("id").alias("tool_id"))
    return servers.where(F.col("id") != server_id), tools.where(F.col("server_id") != server_id), code.join(gone, "tool_id", "left_anti"), documents.join(gone, "tool_id", "left_anti")


def with_tool(tools: DataFrame, row: dict) -> DataFrame:
    """A new tool, or another version of one with its id."""
    if not (row.get("name") or "").strip():
        raise ValueError("a tool has a name")
    row = row | {"name": row["name"].strip(), "max_chunk_limit": max_chunk_limit(row.get("max_chunk_limit"))}
    return tools.where(F.col("id") != row["id"]).unionByName(tools.sparkSession.createDataFrame([row], tools.schema))


def toggled(tools: DataFrame, tool_id: int) -> DataFrame:
    return tools.withColumn("active", F.when(F.col("id") == tool_id, ~F.col("active")).otherwise(F.col("active")))


def replaced_scopes(scopes: DataFrame, tool_id: int, rows: DataFrame) -> DataFrame:
    """A tool's scopes are replaced all together."""
    return scopes.where(F.col("tool_id") != tool_id).unionByName(rows)


#: Where clients' configuration files keep a server, and what they say of it beside its address.
CLIENTS = {"claude_desktop": ("mcpServers", {}), "opencode": ("mcp", {"type": "remote"}), "vscode": ("servers", {"type": "http"})}


def connection_info(server: str, port: int = 18651) -> dict:
    """A server's address, and what each client's configuration needs."""
    base = f"http://127.0.0.1:{port}/mcp"
    address = f"{base}?server_id={server}"
    snippets = {client: {section: {server: {**more, "url": address}}} for client, (section, more) in CLIENTS.items()}
    return {"mcp_url": base, "server_id": server, "server_name": server, "full_url": address, "config_snippets": snippets}


def scope_options(points: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Repositories, groups that aren't a website's, groups of websites."""
    web = points.where(is_website()).select("group").where("group IS NOT NULL").distinct()
    groups = points.select("group").where("group IS NOT NULL").distinct()
    return {"repos": repo_names(points, files), "groups": groups.join(web, "group", "left_anti"), "websites": web}


def dashboard(repos: DataFrame, documents: DataFrame, websites: DataFrame, servers: DataFrame, tools: DataFrame) -> DataFrame:
    """F14, S10."""
    counts = {"repos": repos, "documents": documents, "websites": websites, "servers": servers, "tools": tools}
    rows = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows
