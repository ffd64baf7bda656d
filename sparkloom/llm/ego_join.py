"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c are at most eps = sqrt(2 - 2c) apart. The vectors are turned onto their principal axes, and sorted
by the cells of a grid of width eps on the leading ones (the epsilon grid order). The sorted sequence is written in intervals, one
file each, made of blocks with their bounding boxes. Pairs of intervals are joined recursively: a pair of subsequences whose boxes
are more than eps apart is skipped, others are halved down to blocks, and blocks are compared in double precision. The recursion
over intervals is a table of pairs of tree nodes that each level refines; below an interval it runs inside a task. Equal vectors
are one entry. A joined pair of intervals gives counts of links and a spanning forest, never all its links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import filesystem, materialize, salted_join, scratch, shuffle_partitions, table
from sparkloom.llm.components import connected_components, forest

COSINE = 0.9
LEADING = 8
BLOCK = 1024
#: Rounding: boxes closer than eps plus this are compared; cosines closer to the limit than this are taken again from the vectors.
SLACK = 1e-9
STAT_TASKS = 8
INTERVALS = "part int, seq long, path string, n long, low array<double>, high array<double>"
#: Bytes of vectors in an interval at most; a range of the order may give several.
INTERVAL_BYTES = 32 << 20
#: Children of a node of the tree of intervals: 2 to this power.
FAN = 3


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """Usable vectors of one dimension, each scaled by a power of two so that nothing overflows or vanishes."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None]) if len(m) else m


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1)[:, None]


def _moments(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dim + 1, dim + 1))
    for batch in batches:
        u = np.pad(unit(vectors_of(batch.column("embedding"), dim)), ((0, 0), (0, 1)), constant_values=1)
        total += u.T @ u
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])


def _added(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dim + 1, dim + 1))
    for batch in batches:
        total += sum(np.frombuffer(x).reshape(total.shape) for x in batch.column("m").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal axes by falling variance, from sums over all vectors; the driver gets STAT_TASKS matrices at most."""
    parts = vectors.select("embedding").mapInArrow(lambda it: _moments(it, dim), "m binary").repartition(STAT_TASKS).mapInArrow(lambda it: _added(it, dim), "m binary")
    total = sum((np.frombuffer(r.m).reshape(dim + 1, dim + 1) for r in parts.collect()), np.zeros((dim + 1, dim + 1)))
    n = max(total[-1, -1], 1)
    mean = total[:-1, -1] / n
    return np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1].copy()


def _ordered(batches: Iterator[pa.RecordBatch], dim: int, axes: np.ndarray, eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = vectors_of(batch.column("embedding"), dim)
        cells = np.floor(unit(m) @ axes[:, :LEADING] / eps).astype(np.int64) + 128  # within one byte: coordinates are in [-1, 1] and eps > 1/64
        keys = np.clip(cells, 0, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], names=["rep", "copies", "cells", "vector"])


def _intervals(batches: Iterator[pa.RecordBatch], folder: str, dim: int, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Files of blocks: (ids, copies, vectors) of each, then per block its size and box, then the number of blocks."""
    from pyspark import TaskContext

    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    part, seq, held, count = TaskContext.get().partitionId(), 0, [], 0
    most = max(BLOCK, INTERVAL_BYTES // (8 * (dim + 2)))

    def written(rep, copies, m):
        name, boxes = f"{uuid.uuid4().hex}.ego", []
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            for i in range(0, len(rep), BLOCK):
                x = m[i : i + BLOCK]
                for a in (rep[i : i + BLOCK], copies[i : i + BLOCK], x):
                    out.write(np.ascontiguousarray(a).tobytes())
                turned = unit(x) @ axes
                boxes.append(np.concatenate([[len(x)], turned.min(axis=0), turned.max(axis=0)]))
            out.write(np.array(boxes).tobytes() + np.int64(len(boxes)).tobytes())
        low, high = np.array(boxes)[:, 1 : dim + 1].min(axis=0), np.array(boxes)[:, dim + 1 :].max(axis=0)
        row = (part, seq, f"{folder}/{name}", len(rep), low[:LEADING].tolist(), high[:LEADING].tolist())
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in INTERVALS.split(", ")])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("rep").to_numpy(), batch.column("copies").to_numpy(), np.frombuffer(b"".join(batch.column("vector").to_pylist())).reshape(-1, dim)))
            count += batch.num_rows
        if count >= most:
            yield written(*(np.concatenate(x) for x in zip(*held, strict=True)))
            seq, held, count = seq + 1, [], 0
    if held:
        yield written(*(np.concatenate(x) for x in zip(*held, strict=True)))


class Interval:
    """Reads the boxes of a file at once and its blocks when they are asked for."""

    def __init__(self, path: str, dim: int):
        system, name = filesystem(path)
        with system.open_input_file(name) as f:
            self.data = f.read()
        n, wide = int(np.frombuffer(self.data[-8:], np.int64)[0]), 2 * dim + 1
        boxes = np.frombuffer(self.data, np.float64, n * wide, len(self.data) - 8 - 8 * n * wide).reshape(n, wide)
        self.sizes, self.low, self.high, self.dim = boxes[:, 0].astype(int), boxes[:, 1 : dim + 1], boxes[:, dim + 1 :], dim
        self.starts = np.r_[0, np.cumsum(self.sizes * 8 * (dim + 2))]

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, n = int(self.starts[i]), int(self.sizes[i])
        return np.frombuffer(self.data, np.int64, n, at), np.frombuffer(self.data, np.int64, n, at + 8 * n), np.frombuffer(self.data, np.float64, n * self.dim, at + 16 * n).reshape(n, self.dim)


def box_gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The least distance between points of two boxes."""
    apart = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    return np.sqrt((apart**2).sum(axis=-1))


def near_blocks(a: Interval, b: Interval, same: bool, eps: float) -> Iterator[tuple[int, int]]:
    """Pairs of blocks that aren't provably distant, by recursion over halves of both sequences."""

    def join(i0: int, i1: int, j0: int, j1: int) -> Iterator[tuple[int, int]]:
        if same and j1 <= i0:
            return
        if box_gap(a.low[i0:i1].min(axis=0), a.high[i0:i1].max(axis=0), b.low[j0:j1].min(axis=0), b.high[j0:j1].max(axis=0)) > eps + SLACK:
            return
        if i1 - i0 == 1 == j1 - j0:
            if not same or i0 <= j0:
                yield i0, j0
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            yield from join(i0, m, j0, j1)
            yield from join(m, i1, j0, j1)
        else:
            m = (j0 + j1) // 2
            yield from join(i0, i1, j0, m)
            yield from join(i0, i1, m, j1)

    return join(0, len(a.sizes), 0, len(b.sizes))


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs have at least this cosine; those next to the limit are decided with more digits, rounded to double precision."""
    found = unit(a) @ unit(b).T
    near = found >= cosine
    x, y = np.nonzero(np.abs(found - cosine) < SLACK)
    for i in range(0, len(x), BLOCK):
        p, q = (m[at[i : i + BLOCK]].astype(np.longdouble) for m, at in ((a, x), (b, y)))
        again = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
        near[x[i : i + BLOCK], y[i : i + BLOCK]] = again.astype(np.float64) >= cosine
    return near


def join_intervals(a: Interval, b: Interval, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, other rows it links to in this pair, an entry it hangs together with)."""
    ids, counts, links = [], [], []
    for i, j in near_blocks(a, b, same, eps):
        ra, ca, ma = a.block(i)
        rb, cb, mb = b.block(j)
        near = linked(ma, mb, cosine)
        if same and i == j:
            np.fill_diagonal(near, False)
        x, y = np.nonzero(near)
        if not len(x):
            continue
        ids.append(ra)
        counts.append(near @ cb)
        if not (same and i == j):
            ids.append(rb)
            counts.append(ca @ near)
        links.append(forest(ra[x], rb[y]))
    if not links:
        return (np.zeros(0, np.int64),) * 3
    low, high = forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
    nodes, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    n = np.bincount(inverse, np.concatenate(counts).astype(np.float64), len(nodes)).astype(np.int64)
    root = nodes.copy()
    root[np.searchsorted(nodes, low)] = high
    return nodes[n > 0], n[n > 0], root[n > 0]


def _join(batches: Iterator[pa.RecordBatch], dim: int, cosine: float, eps: float) -> Iterator[pa.RecordBatch]:
    load = lru_cache(maxsize=2)(lambda path: Interval(path, dim))
    for batch in batches:
        for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True):
            found = join_intervals(load(p), load(q), p == q, cosine, eps)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "n", "root"])


def near_intervals(listed: DataFrame, eps: float) -> DataFrame:
    """(p, q) paths of the pairs of intervals that may hold near vectors, by recursion over a tree of intervals, level by level.

    The driver learns how many intervals each partition has, nothing more; a level's pairs are a table.
    """
    spark = listed.sparkSession
    counts = sorted(tuple(r) for r in listed.groupBy("part").count().collect())
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    first = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "part int, start long")
    box = [x for d in range(LEADING) for x in (f"low{d}", f"high{d}")]
    sides = [F.coalesce(F.get(side, F.lit(d)), F.lit(0.0)).alias(f"{side}{d}") for d in range(LEADING) for side in ("low", "high")]
    level = listed.join(first, "part").select((F.col("start") + F.col("seq")).alias("node"), "path", *sides)
    levels, total = [level], starts[-1]
    while total > 1:
        total = -(-total >> FAN)
        level = level.groupBy(F.shiftright("node", FAN).alias("node")).agg(*(F.min(c).alias(c) if c.startswith("low") else F.max(c).alias(c) for c in box))
        levels.append(level)
    pairs = levels[-1].select(F.col("node").alias("p"), F.col("node").alias("q"))
    for level in levels[-2::-1]:
        a, b = (level.select(F.col("node").alias(f"{x}_node"), F.shiftright("node", FAN).alias(x), *(F.col(c).alias(f"{x}_{c}") for c in box)) for x in "pq")
        apart = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"q_low{d}") - F.col(f"p_high{d}"), F.col(f"p_low{d}") - F.col(f"q_high{d}")), 2.0) for d in range(LEADING))
        both = pairs.join(a, "p").join(b, "q").where((F.col("p_node") <= F.col("q_node")) & (apart <= (eps + SLACK) ** 2))
        pairs = both.select(F.col("p_node").alias("p"), F.col("q_node").alias("q"))
    paths = levels[0].select("node", "path")
    return pairs.join(paths.toDF("p", "p_path"), "p").join(paths.toDF("q", "q_path"), "q").select(F.col("p_path").alias("p"), F.col("q_path").alias("q"))


def _links_of_width(entries: DataFrame, dim: int, cosine: float, eps: float) -> DataFrame:
    """(node, n, root) rows of the links between entries of one dimension."""
    spark = entries.sparkSession
    axes, folder = principal_axes(entries, dim), scratch(spark, "ego")
    turned = entries.mapInArrow(lambda it: _ordered(it, dim, axes, max(eps, 1 / 64)), "rep long, copies long, cells binary, vector binary")
    ordered = materialize(turned, "turned").repartitionByRange("cells", "rep").sortWithinPartitions("cells", "rep")
    listed = materialize(ordered.mapInArrow(lambda it: _intervals(it, folder, dim, axes), INTERVALS), "intervals")
    asked = materialize(near_intervals(listed, eps), "interval-pairs").repartition(4 * shuffle_partitions(spark), "p", "q")
    return materialize(asked.mapInArrow(lambda it: _join(it, dim, cosine, eps), "node long, n long, root long"), "ego-links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors of one dimension link when their cosine is at least `cosine` (0.5 to 1). Vectors that are null, zero or hold null or
    non-finite components link with nothing, as do rows with a null id (their component is null). Rows that repeat a vector link
    with each other; rows that repeat an id too count as links of their own. An empty table gives an empty result. Other columns
    are ignored.
    """
    eps = float(np.sqrt(max(0, 2 - 2 * cosine)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = rows.where(F.col("vec_id").isNotNull() & _usable())
    key = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))
    # Equal vectors: by 128 bits of hashes, so that no wide key is shuffled; negative zeros are zeros.
    plain = usable.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    salts = max(64, shuffle_partitions(vectors.sparkSession))
    entries = materialize(plain.groupBy(key.alias("key")).agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    found = None
    for r in entries.select(F.size("embedding").alias("dim")).distinct().collect():
        own = _links_of_width(entries.where(F.size("embedding") == r.dim), r.dim, cosine, eps)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node long, n long, root long")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("node != root"), "node", "root").withColumnRenamed("node", "rep")
    classes = entries.select("key", "rep", "copies").join(counts, F.col("rep") == F.col("node"), "left").join(comps, "rep", "left")
    classes = classes.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    members = plain.select("vec_id", key.alias("key"), F.pmod(F.xxhash64("vec_id") + F.spark_partition_id(), F.lit(salts)).alias("salt"))
    members = materialize(members, "members")  # the salts have to be the same wherever they are read
    linked_rows = salted_join(members, "key", classes).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    others = rows.where(F.col("vec_id").isNull() | ~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _usable():
    """Column: may this vector have links at all? Never null."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Cosines of all pairs and a transitive closure.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
     r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component AS component_id, v.vec_id = c.component AS kept
FROM v JOIN (SELECT a, min(b) AS component FROM r GROUP BY a) c ON c.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id
"""
