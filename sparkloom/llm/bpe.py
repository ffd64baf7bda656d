"""Byte-level BPE encoding and decoding with numpy: length-bucketed matrices, one merge per row and round.

The pieces of a batch that aren't known yet are laid out by length in padded matrices of ids. Each round looks up the changed
neighbour pairs in a hash table, every row merges its leftmost pair of least rank, and the row is compacted; rows without a pair
leave the matrix. Encoded pieces are kept in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import byte_rows, on_release, sliced, table
from sparkloom.llm.tokens import Learn, PieceEncoder, flat_index

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes are merged one by one with a heap: a row of a matrix would take as many rounds as it has bytes.
MATRIX_BYTES = 256
#: Ids in a matrix at most.
CELLS = 1 << 20
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PairTable:
    """(left id, right id) to the id of both together: a hash table with linear probing over two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]] << 31 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(pairs, np.int64).T if pairs else np.zeros((2, 0), np.int64)
        bits = max(8, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        spot, left, self.probes = self._spots(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.keys[spot[left]] < 0
            self.keys[spot[left[free]]] = keys[left[free]]  # of those that meet, the last one stays
            placed = self.keys[spot[left]] == keys[left]
            self.values[spot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            spot[left] = spot[left] + 1 & self.mask
            self.probes += 1

    def _spots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE where the pair isn't in the table, or an id is negative."""
        shape, keys = a.shape, (a.astype(np.int64) << 31 | b).ravel()
        keys[(a < 0).ravel() | (b < 0).ravel()] = -2
        out, left, spot = np.full(len(keys), NONE, np.int32), np.flatnonzero(keys >= 0), self._spots(keys)
        for _ in range(self.probes):
            at = spot[left]
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (there >= 0)]
            if not len(left):
                break
            spot[left] = spot[left] + 1 & self.mask
        return out.reshape(shape)


class ByteBpe:
    """Encodes pieces (byte strings that the pattern doesn't cut) and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pairs, self.pattern = ranks, PairTable(ranks), regex.compile(pattern)
        self.packed = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        self.bytes_of = {r: t for t, r in ranks.items()}
        known = sorted(self.bytes_of)
        #: For decoding: where each id's bytes start in a pool, and how many they are (-1: no such id).
        self.sizes, self.starts = np.full(known[-1] + 1, -1, np.int64), np.zeros(known[-1] + 1, np.int64)
        self.sizes[known] = [len(self.bytes_of[r]) for r in known]
        self.starts[known] = np.cumsum(self.sizes[known]) - self.sizes[known]
        self.pool = np.frombuffer(b"".join(self.bytes_of[r] for r in known), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes | None] = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(self.packed.itemsize, "little")
            elif len(p) > MATRIX_BYTES:
                out[i] = np.array(self._merge_long(p), self.packed).tobytes()
            else:
                by_length.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for width, of in by_length.items():
            for start in range(0, len(of), max(1, CELLS // width)):
                rows = of[start : start + max(1, CELLS // width)]
                for i, ids in zip(rows, self._merge([pieces[i] for i in rows], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        sizes = np.array([len(p) for p in pieces])
        ids = self.single[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)]
        ids[np.arange(width) >= sizes[:, None]] = -1
        ranks = self.pairs.of(ids[:, :-1], ids[:, 1:])
        live, out = np.arange(len(pieces)), [b""] * len(pieces)
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(live)), at]
            if (over := least == NONE).any():
                for i, row in zip(live[over].tolist(), ids[over], strict=True):
                    out[i] = row[row >= 0].astype(self.packed).tobytes()
                live, ids, ranks, at, least = (x[~over] for x in (live, ids, ranks, at, least))
            if not len(live):
                return out
            rows = np.arange(len(live))
            ids[rows, at] = least
            keep = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])  # without the pair's right half
            ids = np.take_along_axis(ids, keep, 1)
            ranks = np.take_along_axis(ranks, np.minimum(keep[:, : width - 2], width - 2), 1)
            width -= 1
            if width < 2:
                ranks = np.full((len(live), 1), NONE, np.int32)
                width = 2
                ids = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)
                continue
            right = np.minimum(at + 1, width - 1)
            ranks[rows[at < width - 1], at[at < width - 1]] = self.pairs.of(ids[rows, at], ids[rows, right])[at < width - 1]
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.of(ids[left, at[left] - 1], ids[left, at[left]])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same order of merges for one long piece: a heap of pairs over a linked list."""
        ids, n = self.single[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        joined, bytes_of = self.ranks.get, self.bytes_of
        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (r := joined(bytes_of[ids[i]] + bytes_of[ids[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        for i in range(n):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            push(before[i])
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any()):
            raise ValueError("an id outside the vocabulary")
        return self.pool[flat_index(self.starts[ids], self.sizes[ids])].tobytes()


def matrix_learner(bpe: ByteBpe) -> Learn:
    """Words go to the matrices as they are; the pattern cuts other pieces, and each of their parts goes once."""

    def learn(data, starts, sizes, word):
        pieces = [data[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        parts = [[p] if w else [x.encode() for x in bpe.pattern.findall(p.decode())] for p, w in zip(pieces, word.tolist(), strict=True)]
        distinct = list({x for xs in parts for x in xs})
        ids = dict(zip(distinct, bpe.encode_pieces(distinct), strict=True))
        packed = [b"".join(map(ids.__getitem__, xs)) for xs in parts]
        return np.frombuffer(b"".join(packed), bpe.packed).astype(np.uint32), np.fromiter(map(len, packed), np.int64, len(packed)) // bpe.packed.itemsize

    return learn


@lru_cache(maxsize=2)
def matrix_encoder(path: str, pattern: str) -> tuple[PieceEncoder, ByteBpe]:
    """One per Python worker; path is that of a file of ranks."""
    with open(path, "rb") as lines:
        bpe = ByteBpe(read_ranks(lines), pattern)
    encoder = PieceEncoder(matrix_learner(bpe), max(bpe.ranks.values()) + 1)
    on_release(encoder.forget)
    return encoder, bpe


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder, bpe = matrix_encoder(path, pattern)
    for batch in sliced(batches, "text"):
        found = encoder.ids(*byte_rows(batch))
        columns = [
            batch.column("doc_id"),
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
            pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in found], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder, _ = matrix_encoder(path, pattern)
    for batch in sliced(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in encoder.ids(*byte_rows(batch))], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = matrix_encoder(path, pattern)[1]
    for batch in batches:
        rows = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "decoded"])


def _two_columns(docs: DataFrame, second: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(second))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row; null text counts as empty and gives no ids, texts of any length are encoded whole, rows stay as they are,
    repeated or not, with or without an id. An empty table gives an empty result; other columns, whatever their names, are ignored."""
    return _two_columns(docs, "text").mapInArrow(lambda it: _encode(it, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded bytes) of every row of (doc_id, ids); null ids give null, an id outside the vocabulary is an error."""
    return _two_columns(encoded, "ids").mapInArrow(lambda it: _decode(it, path, pattern), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every whole text and decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256. Cases as in encode()."""
    return _two_columns(docs, "text").mapInArrow(lambda it: _round_trip(it, path, pattern), RESULT)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
