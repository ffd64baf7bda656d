"""Schemas of the engine: points, chunks, relational tables, events."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, INT, BOOL, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


def names_of(spec: str) -> list[str]:
    """The columns of a schema, for places without a session."""
    plain, depth = "", 0
    for c in spec:
        depth += (c == "<") - (c == ">")
        plain += c if depth == 0 else ""
    return [x.split()[0] for x in plain.split(",")]


SPARSE = "struct<indices array<bigint>, values array<float>>"
POINT = f"id string, document string, dense array<float>, sparse {SPARSE}, payload string"
DOCUMENT_CHUNK = "id string, file_name string, content string, doc_type string, chunk_index bigint, page bigint, metadata string, created_at string"
PARAMETER = "struct<name string, type string>"
#: The nullable superset of the eleven shapes of code chunks.
KIND_FIELDS = (
    f"class_name string, interface_name string, function_name string, parameters array<{PARAMETER}>, return_type string, namespace string, "
    f"properties array<{PARAMETER}>, is_method boolean, is_async boolean, is_generator boolean, component_name string, is_functional boolean, "
    "hooks_used array<string>, props array<string>, component_type string, parent_component string, is_exported boolean, alias_name string, "
    "alias_target string, decorators array<string>, type_parameters array<string>, bases array<string>, is_type_alias boolean, "
    "statement_type string, object_name string, schema_name string, database_name string"
)
CODE_CHUNK = f"id string, repo_name string, file_name string, type string, code string, dependencies array<string>, created_at string, kind string, {KIND_FIELDS}"
FILE_METADATA = "id bigint, storage_object_id string, full_path string, file_type string, size_bytes bigint, repo_name string, group_id string, status string, error_message string, created_at string, collection string"
JOB_STATUS = "id bigint, job_id string, status string, created_at string, updated_at string, result string, error_message string, progress_percentage int, file_name string, storage_object_id string, task_name string, task_params string"
SERVERS = "id bigint, name string, description string, active boolean, created_at string, updated_at string"
TOOLS = "id bigint, name string, description string, active boolean, server_id bigint, created_at string, updated_at string, max_chunk_limit int"
CODE_SCOPES = "id bigint, tool_id bigint, collection string, repo_names string, created_at string, updated_at string"
DOCUMENT_SCOPES = "id bigint, tool_id bigint, collection string, group_ids string, created_at string, updated_at string"
JOB_EVENT = "seq bigint, job_id string, event string, percentage int, message string, file_name string, status string, result string, error string"

#: Collections that may be created, and the keys that may be filtered on in each (the first is the tenant, the partition column).
COLLECTIONS = {
    "codebase": {"repo_name": "keyword", "file_name": "keyword", "created_at": "datetime"},
    "general": {"group": "keyword", "file_name": "keyword", "url": "keyword", "website_key": "keyword", "zip_filename": "keyword", "doc_type": "keyword", "created_at": "datetime"},
}
INDEX_TYPES = {"keyword": "string", "integer": "bigint", "float": "double", "text": "string", "datetime": "timestamp", "bool": "boolean", "uuid": "string", "geo": "struct<lon double, lat double>"}

#: Fields that later versions of the tables added, with their defaults.
MIGRATIONS = {"tools": [("max_chunk_limit", "int", 5)]}


def migrated(df, table: str):
    """A table of an older version with the columns it lacks."""
    from pyspark.sql import functions as F

    for name, kind, default in MIGRATIONS.get(table, []):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def validate(df, spec: str) -> None:
    """Raises if a column of the schema is missing or has another type."""
    found = dict(df.dtypes)
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in struct(spec).fields if found.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
