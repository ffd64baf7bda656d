"""What the operators of this subpackage share: scratch tables, files in the shared folder, document input."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_release: list[Callable[[], None]] = []
_scopes: list[list[str]] = []


def on_release(clear: Callable[[], None]) -> None:
    """Registers what frees a table that a Python worker keeps between tasks."""
    _release.append(clear)


def give_back() -> None:
    """Gives free memory back to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def release_kept() -> None:
    """Frees such tables, and gives free memory back. For tasks of other operators: workers live on from stage to stage."""
    for clear in _release:
        clear()
    give_back()


@contextlib.contextmanager
def collector_paused() -> Iterator[None]:
    """Without Python's search for reference cycles, which makes none here but walks millions of kept objects again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile hands Python workers at most so many rows at a time: a batch is held by the JVM and by the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if not 0 < int(was) <= most:
        spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, for local masters only:
    on a cluster each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="sparkloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no one else uses."""
    path = f"{shared_dir(spark)}/sparkloom/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table or folder; nothing may read it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: the rows are written as a Parquet table in the shared folder and read from there; and the table's path.

    Files in the shared folder survive the loss of any executor.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    return written(df, label)[0]


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """written(make()), and the scratch tables and files that make() left are deleted."""
    _scopes.append([])
    try:
        found, path = written(make(), label)
    finally:
        made = _scopes.pop()
    for x in made:
        if x != path:
            drop(spark, x)
    if _scopes:
        _scopes[-1].append(path)
    return found, path


def salted_join(rows: DataFrame, key: str, classes: DataFrame, how: str = "inner") -> DataFrame:
    """rows (with a column `salt`) joined with their key's class, without salt. Any part of the rows may share a key: classes are joined to
    the distinct (key, salt) first, of which a key has few, and rows meet those, so a common key's rows are spread by their salts."""
    runs = rows.select(key, "salt").distinct().join(classes, key, how)
    return rows.join(runs, [key, "salt"]).drop("salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or plain path; for use inside tasks. Hadoop's names of S3 are S3's."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def write_bytes(path: str, data: bytes) -> None:
    """Writes under a name of its own first: a task that dies half-way or runs twice leaves no half file."""
    system, name = filesystem(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> object:
    """Column: is the row kept out of training? crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def byte_rows(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, back to back, and the offsets of the rows (one more than rows). Null counts as empty."""
    column = batch.column(name)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    start, n = column.offset, len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[start : start + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of the named column (a longer single row comes alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum([0 if v is None else v for v in pc.binary_length(batch.column(name)).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
