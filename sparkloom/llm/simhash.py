"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes. The index has a posting for the
bytes at three positions: the positions fall into two halves, and any 5 put 3 into one half, so the 8 triples inside the halves
bring every such pair together (a single byte's posting would hold 1/256 of all documents). In a posting the shared positional
bytes of each pair are tallied, pairs below the guaranteed minimum of 5 are dropped, and the others are verified bit by bit.

A posting of more than LONG fingerprints is divided, exactly: a pair that counts shares two of the five other positions as well, so
ten finer postings have it; and where those are long too, of the six half-bytes left three agree, so twenty postings have it, of at
most 2^12 = LONG fingerprints each. No task holds more than LONG of one posting.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, release_kept, salted_join, shuffle_partitions, sliced, table, texts
from sparkloom.llm.components import connected_components, forest

SEED = 42
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Postings longer than this are divided by further positions.
LONG = 4096
BLOCK = 1024
PAIRS, HALVES = [*combinations(range(5), 2)], [*combinations(range(6), 3)]


def shingles(text: str, width: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles in their order; fewer than `width` words make one, no words none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only; splits at 20 and 09-0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    hashes = shingles(text, width)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, salts: int) -> Iterator[pa.RecordBatch]:
    """The salt counts rows: equal fingerprints, however many, fall into as many parts."""
    release_kept()
    seen = 0
    for batch in sliced(batches, "text"):
        found = np.array([fingerprint(t, width) for t in texts(batch)], np.uint64).view(np.int64)
        salt = ((seen + np.arange(len(found))) % salts).astype(np.int32)
        seen += len(found)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array(salt)], names=["doc_id", "fp", "salt"])


def _octets(fp: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)


def _verified(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.bitwise_count(fp[i] ^ fp[j]) <= MAX_BITS
    return i[keep], j[keep]


def _posting_pairs(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of linked pairs with equal keys; keys are sorted. Shared positional bytes are tallied, then bits are compared."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    octets = _octets(fp)
    short = np.repeat(sizes <= 64, sizes)
    step, at = 1, np.flatnonzero(short)
    while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
        tally = (octets[at] == octets[at + step]).sum(axis=1)
        hit = at[tally >= MIN_SHARED]
        yield _verified(fp, hit, hit + step)
        step += 1
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        columns = np.ascontiguousarray(octets[s : s + n].T)
        for i in range(0, n, BLOCK):
            for j in range(i, n, BLOCK):
                a, b = columns[:, i : i + BLOCK], columns[:, j : j + BLOCK]
                tally = np.zeros((a.shape[1], b.shape[1]), np.uint8)
                for p in range(8):
                    tally += a[p, :, None] == b[p, None, :]
                p, q = np.nonzero(tally >= MIN_SHARED)
                p, q = p + s + i, q + s + j
                yield _verified(fp, p[p < q], q[p < q])


def _finer(level: int, key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """(entries, finer keys): after 3 positions 2 of the other 5, then 3 half-bytes of the 3 bytes left.

    A key is: 3 bits for the triple, its 3 bytes; from the second level 4 bits for the pair, its 2 bytes; on the third 5 bits for
    the half-bytes, 12 bits of them.
    """
    octets = _octets(fp).astype(np.int64)
    triple = (key >> 24 if level == 1 else key >> 44) & 7
    out = np.zeros((len(key), len(PAIRS if level == 1 else HALVES)), np.int64)
    for k in np.unique(triple).tolist():
        own = np.flatnonzero(triple == k)
        left = [p for p in range(8) if p not in TRIPLES[k]]
        o = octets[own]
        if level == 1:
            for c, (x, y) in enumerate(PAIRS):
                out[own, c] = key[own] >> 24 << 44 | c << 40 | (key[own] & 0xFFFFFF) << 16 | o[:, left[x]] << 8 | o[:, left[y]]
            continue
        for pair in np.unique(key[own] >> 40 & 15).tolist():
            at = own[(key[own] >> 40 & 15) == pair]
            rest = [p for n, p in enumerate(left) if n not in PAIRS[pair]]
            half = np.stack([octets[at, p] >> shift & 15 for p in rest for shift in (0, 4)])
            for c, (x, y, z) in enumerate(HALVES):
                out[at, c] = (key[at] * 32 + c) << 12 | half[x] << 8 | half[y] << 4 | half[z]
    return out


def _postings(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp, rep) rows to links (a, b; no key), of each stretch a spanning forest, not all pairs; and, of postings of more
    than LONG fingerprints, rows (fp, rep, finer key) for the next level."""
    release_kept()
    none = np.zeros(0, np.int64)

    def links(key, fp, rep):
        found = [(rep[i], rep[j]) for i, j in _posting_pairs(key, fp) if len(i)]
        a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (none, none)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    def divided(key, fp, rep):
        for i in range(0, len(key), LONG):
            finer = _finer(level, key[i : i + LONG], fp[i : i + LONG])
            of = np.repeat(np.arange(i, i + len(finer)), finer.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(fp[of].view(np.int64)), pa.array(rep[of]), pa.array(finer.reshape(-1))], names=["a", "b", "key"])

    rest, flowing = [none, none.view(np.uint64), none], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep"))
        rest = [np.concatenate(x) for x in zip(rest, (key, fp.view(np.uint64), rep), strict=True)]
        if flowing is not None:  # a long posting goes on
            n = int(np.searchsorted(rest[0], flowing, side="right"))
            yield from divided(*(x[:n] for x in rest))
            rest = [x[n:] for x in rest]
            if not len(rest[0]):
                continue
            flowing = None
        last = int(np.searchsorted(rest[0], rest[0][-1]))  # the last key may go on
        if level < 3 and len(rest[0]) - last > LONG:
            flowing, last = rest[0][-1], len(rest[0])
        key = rest[0][:last]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if last else none
        sizes = np.diff(np.r_[starts, last])
        long = np.repeat(sizes > LONG, sizes) if level < 3 else np.zeros(last, np.bool_)
        if last:
            yield links(*(x[:last][~long] for x in rest))
            yield from divided(*(x[:last][long] for x in rest))
        rest = [x[last:] for x in rest]
    if len(rest[0]):
        yield links(*rest)


def links_of(postings: DataFrame) -> DataFrame:
    """(a, b) links between the reps of (key, fp, rep) postings on the first level."""
    spark, found = postings.sparkSession, None
    for level in (1, 2, 3):
        dealt = postings.repartition("key").sortWithinPartitions("key")
        out = materialize(dealt.mapInArrow(lambda it, level=level: _postings(it, level), "a long, b long, key long"), f"simhash-links-{level}")
        links = out.where("key is null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        postings = out.where("key is not null").select("key", F.col("a").alias("fp"), F.col("b").alias("rep"))
        if postings.isEmpty():
            break
    return found


def components_of(nodes: DataFrame) -> DataFrame:
    """(node, component) of distinct fingerprints (fp, rep): the reps that have links, and the smallest rep reachable."""
    octet = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = F.array(*(F.lit(k << 24).cast("long") + octet[t[0]] * 65536 + octet[t[1]] * 256 + octet[t[2]] for k, t in enumerate(TRIPLES)))
    return connected_components(links_of(nodes.where("rep is not null").select(F.explode(keys).alias("key"), "fp", "rep")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    A null text is an empty text; texts without words have fingerprint zero and link like any other; fewer than `width` words
    make one shingle. Equal fingerprints are one node of the graph, however many rows have them. Rows with a null id get the
    component of their fingerprint's other rows, null if there are none. An empty table gives an empty result, very long texts are
    read whole in bounded memory, rows that repeat stay as they are. Other columns are ignored.
    """
    salts = max(64, shuffle_partitions(docs.sparkSession))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(rows.mapInArrow(lambda it: _fingerprints(it, width, salts), "doc_id long, fp long, salt int"), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    comps = components_of(nodes)
    classes = nodes.join(comps, nodes.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return salted_join(marked, "fp", classes).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
