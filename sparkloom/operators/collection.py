"""Collections as tables: creation, upsert, deletion, updates, facets, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import repo_of_zip
from sparkloom.plans.predicate import compile_filter
from sparkloom.schema import COLLECTIONS, INDEX_TYPES

FACET_LIMIT = 1000


def checked_name(name: str) -> str:
    if name not in COLLECTIONS:
        raise ValueError(f"no such collection: {name}")
    return name


class Store:
    """Collections in the session's catalog, partitioned by tenant. Every change writes the next version of a table and switches the view."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), {}

    def list_collections(self) -> list[str]:
        return sorted(self.versions)

    def ensure(self, name: str, schema: str) -> bool:
        """Creates an allowed collection if it isn't there; is it new?"""
        if checked_name(name) in self.versions:
            return False
        self.replace(name, self.spark.createDataFrame([], schema))
        return True

    def replace(self, name: str, rows: DataFrame) -> None:
        version = self.versions.get(name, 0) + 1
        tenant = next(iter(COLLECTIONS[name]))
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(tenant) if tenant in rows.columns and len(rows.columns) > 1 else writer).parquet(path := f"{self.folder}/{name}/v{version}")
        self.versions[name] = version
        self.spark.read.schema(rows.schema).parquet(path).createOrReplaceTempView(name)
        if version > 2:  # the version before this one may still be read
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/v{version - 2}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def upsert(self, name: str, rows: DataFrame, position: str | None = None) -> None:
        """Of rows that repeat an id the last one stays, by a column of positions or in the order that the rows are read in."""
        if position is None:
            rows, position = rows.withColumn("_position", F.monotonically_increasing_id()), "_position"
        self.replace(name, upserted(self.table(name), rows, position))

    def delete(self, name: str, ids: list[str] | None = None, where: dict | None = None) -> None:
        self.replace(name, deleted(self.table(name), ids, where))


def check_index(name: str, kind: str) -> str:
    """The Spark type of an index type, or an error."""
    if kind not in INDEX_TYPES:
        raise ValueError(f"no such index type: {kind}")
    return INDEX_TYPES[kind]


def check_indexes(collection: str, df: DataFrame) -> list[str]:
    """B2: filterable columns that are missing; one of another type is an error."""
    found, missing = dict(df.dtypes), []
    for key, kind in COLLECTIONS[checked_name(collection)].items():
        if key not in found:
            missing.append(key)
        elif found[key] != check_index(key, kind) and (kind, found[key]) != ("datetime", "string"):  # times are kept as ISO text
            raise ValueError(f"{key} is {found[key]}, wanted {kind}")
    return missing


def last_of_batch(rows: DataFrame, position: str | None = None) -> DataFrame:
    """Of rows that repeat an id the last one."""
    if position is None:
        return rows.dropDuplicates(["id"])
    w = W.partitionBy("id").orderBy(F.desc(position))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, position: str | None = None) -> DataFrame:
    """New rows replace old ones with their id."""
    new = last_of_batch(new, position)
    if position and position not in old.columns:
        new = new.drop(position)
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(points: DataFrame, ids: list[str] | None = None, where: dict | None = None) -> DataFrame:
    """Without the ids, if there are any, else without what matches the clause; an empty clause deletes all, none is an error."""
    if ids:
        return points.where(~F.coalesce(F.col("id").isin(ids), F.lit(False)))
    if where is None:
        raise ValueError("ids or a where clause")
    return points.where(~compile_filter(points, where))


def without_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    """B4 for a table of ids."""
    return points.join(ids.select("id"), "id", "left_anti")


def replacement_clause(collection: str, zip_name: str | None = None, repo: str | None = None, file_name: str | None = None, group: str | None = None, user_id: str | None = None) -> dict:
    """What goes before something is taken in again."""
    if file_name is not None:
        keys = {"file_name": file_name} | ({"group": group} if group else {}) | ({"user_id": user_id} if user_id else {})
        return keys if len(keys) == 1 else {"$and": [{k: v} for k, v in keys.items()]}
    return {"repo_name": repo} if collection == "codebase" else {"zip_filename": zip_name}


def set_payload(points: DataFrame, where: Column, values: dict[str, object]) -> DataFrame:
    """New values of some keys where the condition holds."""
    return points.withColumns({k: F.when(F.coalesce(where, F.lit(False)), F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def repaired_repo_names(points: DataFrame) -> DataFrame:
    """Points of an archive that names no repository but the archive's own get that name. Per archive two counts, no lists."""
    own = repo_of_zip(F.col("zip_filename"))
    other = F.coalesce((F.trim("repo_name") != "") & (F.col("repo_name") != own), F.lit(False))
    zips = points.where(F.coalesce("zip_filename", F.lit("")) != "").groupBy("zip_filename").agg(F.count_if(other).alias("others"))
    wanted = zips.where("others = 0").select("zip_filename", own.alias("wanted"))
    joined = points.join(wanted, "zip_filename", "left")
    return joined.withColumn("repo_name", F.coalesce("wanted", "repo_name")).drop("wanted").select(*points.columns)


def count_items(points: DataFrame) -> int:
    """exact."""
    return points.count()


def facet(points: DataFrame, key: str, where: Column | None = None, limit: int = FACET_LIMIT) -> DataFrame:
    """(value, n) of the commonest values, ties by value."""
    rows = points if where is None else points.where(where)
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)
