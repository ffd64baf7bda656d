"""Near duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, exact sets decide.

A pair of similarity 0.8 misses all 32 bands of 5 values with probability 3e-6, a closer one less often. Pairs that meet in a band
are dropped early only where sizes or parity sketches prove that they are further apart: each sketch bit is the parity of the
shingles that fall on it, so that differing bits never exceed differing shingles. Buckets of more than PART sets, and of more than
SHORT if many of their pairs are left, first yield chains, as their rows stream by; a second round then compares all their sets that
the links found so far leave in different components, in pairs of parts of at most about PART sets: no task holds a bucket, however
many copies meet in it. Other indexes of sets can take the place of the bands (wide_simhash has one).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, release_kept, salted_join, shuffle_partitions, sliced, texts
from sparkloom.llm.components import connected_components
from sparkloom.llm.simhash import BLOCK, shingles

BANDS, ROWS = 32, 5
SHORT, CHAIN = 16, 2
#: Of a bucket of more than SHORT sets, pairs left a set that make it a long one.
MANY = 2
#: Sets of a long bucket that are held, and that are compared with as many others, at a time; long buckets that are told to all tasks.
PART, TOLD = 1024, 100_000
_rng = np.random.default_rng(42)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_M = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer than `width` words make one, no words none."""
    return np.unique(shingles(text, width))


def band_keys(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), BLOCK):  # bounded memory for texts of any length
        np.minimum(least, (high[i : i + BLOCK, None] * _A + _B).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * _M).sum(axis=1, dtype=np.uint64) ^ _C


def sketch(grams: np.ndarray) -> bytes:
    return np.packbits(np.bincount((grams & np.uint64(255)).astype(np.int64), minlength=256) & 1).tobytes()


def _digest(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(grams.tobytes())


def _signatures(batches: Iterator[pa.RecordBatch], width: int, salts: int, index: Index) -> Iterator[pa.RecordBatch]:
    release_kept()
    seen = 0
    for batch in sliced(batches, "text"):
        sets = [shingle_set(t, width) for t in texts(batch)]
        sig = np.array([_digest(g) for g in sets], np.uint64).view(np.int64)
        prints = pa.array([index.signature(g) for g in sets], pa.binary())
        columns = [batch.column("doc_id"), pa.array(sig), pa.array([len(g) for g in sets], pa.int64()), prints, pa.array(((seen + np.arange(len(sets))) % salts).astype(np.int32))]
        seen += len(sets)
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sig", "n", "print", "salt"])


def _postings(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Rows (sig, n, print, perhaps label) to a row for each of their keys, with what index.near compares."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            prints = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            keys = index.keys(prints)
            each = np.repeat(np.arange(part.num_rows), keys.shape[1])
            held = [c for c in ("sig", "n", "label") if c in part.schema.names and (c != "n" or index.sized)]
            marks = index.marks(prints).view(np.int64)[each]
            columns = [pa.array(keys.reshape(-1))] + [part.column(c).take(pa.array(each)) for c in held] + [pa.array(marks[:, k]) for k in range(index.words)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *held, *(f"mark{k}" for k in range(index.words))])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        sets = [shingle_set(t, width) for t in texts(batch)]
        sig = np.array([_digest(g) for g in sets], np.uint64).view(np.int64)
        grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(sig), grams], names=["sig", "grams"])


def _near(n: np.ndarray, marks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs may have Jaccard >= 0.8, that is, 9 x differing <= sum of sizes; False is proof that they don't."""
    keep = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
    i, j = i[keep], j[keep]
    keep[keep] = 9 * np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
    return keep


class Index(NamedTuple):
    """Finds candidates among sets: bytes of a set; of rows of such bytes the keys of their buckets and the `words` 64-bit words that
    `near` compares, with the sets' sizes if `sized`."""

    signature: Callable[[np.ndarray], bytes]
    keys: Callable[[np.ndarray], np.ndarray]
    marks: Callable[[np.ndarray], np.ndarray]
    near: Callable[[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    words: int
    sized: bool


def _banded(grams: np.ndarray) -> bytes:
    return band_keys(grams).tobytes() + sketch(grams)


def _band_columns(prints: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(prints[:, : 8 * BANDS]).view(np.int64)


def _sketches(prints: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(prints[:, 8 * BANDS :]).view(np.uint64)


MINHASH = Index(_banded, _band_columns, _sketches, _near, words=4, sized=True)


def _bucket_pairs(key: np.ndarray, n: np.ndarray | None, marks: np.ndarray, near: Callable = _near) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Indices of candidate pairs with equal keys, and the keys of long buckets; keys are sorted. All pairs, but of long buckets chains."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    bucket, whole, left, pairs = np.repeat(np.arange(len(sizes)), sizes), sizes <= PART, np.zeros(len(sizes), np.int64), []
    step, at = 1, np.arange(len(key))
    while len(at := at[at + step < len(key)]) and len(at := at[(key[at] == key[at + step]) & (whole[bucket[at]] | (step <= CHAIN))]):
        hit = at[near(n, marks, at, at + step)]
        pairs.append((hit, hit + step))
        left += np.bincount(bucket[hit], minlength=len(sizes))
        whole &= (sizes <= SHORT) | (left <= MANY * sizes)
        step += 1
    return pairs, key[starts[~whole]]


def _part_pairs(key: np.ndarray, n: np.ndarray | None, marks: np.ndarray, label: np.ndarray, side: np.ndarray, near: Callable = _near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for pairs of parts of long buckets: sets of different labels, of different sides (side 2: a part with itself)."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for s, e in zip(starts.tolist(), np.r_[starts[1:], len(key)].tolist()):
        for i in range(s, e, BLOCK):
            for j in range(i, e, BLOCK):
                a, b = slice(i, min(e, i + BLOCK)), slice(j, min(e, j + BLOCK))
                p, q = np.nonzero((label[a, None] != label[None, b]) & ((side[a, None] != side[None, b]) | (side[a, None] == 2)))
                p, q = p + i, q + j
                p, q = p[p < q], q[p < q]
                keep = near(n, marks, p, q)
                yield p[keep], q[keep]


def _candidates(batches: Iterator[pa.RecordBatch], index: Index, parts: bool) -> Iterator[pa.RecordBatch]:
    """Rows of postings sorted by key (of parts with label and side) to pairs of sets; of whole buckets also the keys of long ones
    (`long` is true)."""
    release_kept()
    names = ["key", "sig", *(["n"] if index.sized else []), *(["label", "side"] if parts else [])]

    def found(columns, marks):
        of = dict(zip(names, columns, strict=True))
        if parts:
            hits, own = list(_part_pairs(of["key"], of.get("n"), marks, of["label"], of["side"], index.near)), of["key"][:0]
        else:
            hits, own = _bucket_pairs(of["key"], of.get("n"), marks, index.near)
        pairs = [(of["sig"][i], of["sig"][j]) for i, j in hits]
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else (a, b)
        is_key = np.repeat([False, True], [len(a), len(own)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, own])), pa.array(np.concatenate([b, own])), pa.array(is_key)], names=["a", "b", "long"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        new.append(np.stack([batch.column(f"mark{k}").to_numpy(zero_copy_only=False) for k in range(index.words)], axis=1).view(np.uint64))
        rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last key may go on
        if not parts and len(rest[0]) - cut > 4 * PART:  # a long bucket: its chain goes on from its last sets
            yield found(rest[:-1], rest[-1])
            rest = [x[-CHAIN:] for x in rest]
        elif cut:
            yield found([x[:cut] for x in rest[:-1]], rest[-1][:cut])
            rest = [x[cut:] for x in rest]
    if rest is not None:
        yield found(rest[:-1], rest[-1])


def _links(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets have Jaccard >= 0.8, in whole numbers; sets are made again for candidates only, and compared where they are
    joined: batches of pairs of long sets would fill the workers' memory."""
    used = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    used = materialize(nodes.join(used, "sig").select("sig", "rep"), "candidates")
    held = rows.join(used.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("text")
    sets = held.mapInArrow(lambda it: _sets(it, width), "sig long, grams array<long>").join(used, "sig", "left_semi").dropDuplicates(["sig"])
    sets = materialize(sets, "sets")
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("sig").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return materialize(both.where(9 * shared >= 4 * (F.size("ga") + F.size("gb"))).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, index: Index = MINHASH) -> DataFrame:
    """One row per input row: doc_id, component_id (smallest id reachable by links of Jaccard >= 0.8).

    Words are lowered in A-Z and split at white space of ASCII. Equal sets are one node of the graph. Rows with a null id get the
    component of their set's other rows, null if there are none. `index` finds the candidates.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    salts = max(64, shuffle_partitions(docs.sparkSession))
    marked = materialize(rows.mapInArrow(lambda it: _signatures(it, width, salts, index), "doc_id long, sig long, n long, print binary, salt int"), "signatures")
    nodes = materialize(marked.where("doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "print"))), "sets-once")
    marks = [f"mark{k}" for k in range(index.words)]
    compared = ["key", "sig", *(["n"] if index.sized else []), *marks]

    def postings(sets: DataFrame) -> DataFrame:
        held = ["key", "sig", *(["n"] if index.sized else []), *(["label"] if "label" in sets.columns else []), *marks]
        return sets.mapInArrow(lambda it: _postings(it, index), ", ".join(f"{c} long" for c in held))

    def candidates(dealt: DataFrame, parts: bool) -> DataFrame:
        return materialize(dealt.mapInArrow(lambda it: _candidates(it, index, parts), "a long, b long, long boolean"), "pairs")

    first = candidates(postings(nodes.select("sig", "n", "print")).repartition("key").sortWithinPartitions("key", F.xxhash64("sig", "key")), False)  # chains differ between keys
    links = _links(rows, nodes, first.where("not long").select("a", "b").distinct(), width)
    comps = materialize(connected_components(links), "components")
    long = materialize(first.where("long").select(F.col("a").alias("key")).distinct(), "long-keys")
    if many := long.count():
        label = nodes.join(comps, nodes.sig == comps.node, "left").select("sig", "n", "print", F.coalesce("component", "sig").alias("label"))
        again = materialize(postings(label).join(F.broadcast(long) if many <= TOLD else long, "key", "left_semi"), "long-buckets")
        mixed = again.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        mixed = materialize(mixed.select("key", F.ceil(F.col("sets") / PART).cast("int").alias("parts")), "mixed-buckets")
        told = F.broadcast(mixed) if mixed.count() <= TOLD else mixed
        mine = again.join(told, "key").withColumn("p", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
        paired = mine.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        side = F.when(F.col("p") == F.col("q"), 2).otherwise((F.col("p") > F.col("q")).cast("int"))
        dealt = paired.select(F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("key"), *compared[1:], "label", side.alias("side"))
        pairs = candidates(dealt.repartition("key").sortWithinPartitions("key"), True).select("a", "b").distinct().join(first.where("not long").select("a", "b"), ["a", "b"], "left_anti")
        comps = materialize(connected_components(links.unionByName(_links(rows, nodes, materialize(pairs, "pairs"), width))), "components")
    own = nodes.select("sig", "rep")
    least = own.join(comps, own.sig == comps.node).groupBy("component").agg(F.min("rep").alias("least"))
    placed = salted_join(comps.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts))), "component", least)
    classes = own.join(placed, own.sig == F.col("node"), "left").select("sig", F.coalesce("least", "rep").alias("component_id"))
    return salted_join(marked.select("doc_id", "sig", "salt"), "sig", classes, "left").select("doc_id", "component_id")
