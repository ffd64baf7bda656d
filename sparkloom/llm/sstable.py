"""Sorted-string-table shards of token ids: documents keyed by identifier, looked up by binary search.

A shard is: data blocks, index block, Bloom filter, footer. A data block holds entries in key order, each `shared prefix length,
rest length, value length` (variable-length integers), the rest of the key and the value; every 16th entry has its key in full
and its place is listed at the block's end. Blocks are compressed with zstd and end with a CRC-32. The index lists each block's
last key, offset and length; the footer says where index and filter are. Keys are the ids as 8 big-endian bytes with the sign bit
flipped, so that bytes sort as the ids do; a null id has the empty key.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import byte_rows, filesystem, materialize, scratch, sliced, table
from sparkloom.llm.tokens import library_encoder

BLOCK_BYTES = 64 << 10
SHARD_BYTES = 256 << 20
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"SLSSTAB2"
FOOTER = struct.Struct("<QQQQQQQQ8s")
END_ID = 2
MANIFEST = "part int, seq int, path string, docs long, tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_spots(keys: list[bytes], bits: int) -> np.ndarray:
    halves = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys), "<u8").reshape(-1, 2)
    steps = np.arange(BLOOM_HASHES, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)


class ShardWriter:
    """Writes entries that come in key order; values are arrays of unsigned ids of `width` bytes."""

    def __init__(self, stream, width: int = 2):
        import zstandard

        self.width = width
        self.stream, self.pack = stream, zstandard.ZstdCompressor(level=1).compress
        self.at = self.docs = self.tokens = 0
        self.index, self.keys = [], []
        self._start()

    def _start(self):
        self.block, self.size, self.restarts, self.count, self.last = [], 0, [], 0, b""

    def add(self, key: bytes, value: np.ndarray) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(self.size)
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        data = value.tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(data)) + key[shared:] + data
        self.block.append(entry)
        self.size += len(entry)
        self.count, self.last = self.count + 1, key
        self.keys.append(key)
        self.docs, self.tokens = self.docs + 1, self.tokens + len(value)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _put(self, raw: bytes) -> tuple[int, int]:
        data = self.pack(raw)
        data += struct.pack("<I", zlib.crc32(data))
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self):
        if self.count:
            tail = struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.index.append((self.last, *self._put(b"".join(self.block) + tail)))
            self._start()

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index))
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 64) * 64)
        flags = np.zeros(bits, np.bool_)
        for i in range(0, len(self.keys), 1 << 16):
            flags[_bloom_spots(self.keys[i : i + (1 << 16)], bits)] = True
        bloom = self._put(np.packbits(flags, bitorder="little").tobytes())
        self.stream.write(FOOTER.pack(*index, *bloom, bits, self.docs, self.tokens, self.width, MAGIC))
        self.stream.close()


class ShardReader:
    """Reads footer, index and filter once; lookups read one block, scans read all in order."""

    def __init__(self, path: str):
        system, name = filesystem(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        *places, self.bits, self.docs, self.tokens, width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.kind = np.dtype(f"<u{width}")
        raw, at, self.index = self._block(*places[:2]), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        self.bloom = np.frombuffer(self._block(*places[2:]), np.uint8)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _block(self, offset: int, length: int) -> bytes:
        import zstandard

        data = self._at(offset, length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        return zstandard.ZstdDecompressor().decompress(data[:-4])

    def _entries(self, raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, self.kind, size // self.kind.itemsize, at)
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, offset, length in self.index:
            raw = self._block(offset, length)
            restarts = struct.unpack("<I", raw[-4:])[0]
            yield from self._entries(raw, 0, len(raw) - 4 - 4 * restarts)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The value of the first entry with this id, None if there is none."""
        key = key_of(doc_id)
        spots = _bloom_spots([key], self.bits)[0].astype(np.int64)
        if not (self.bloom[spots >> 3] >> (spots & 7) & 1).all():
            return None
        i = bisect_left(self.index, (key,))
        if i == len(self.index):
            return None
        raw = self._block(*self.index[i][1:])
        n = struct.unpack("<I", raw[-4:])[0]
        restarts = struct.unpack(f"<{n}I", raw[-4 - 4 * n : -4])
        lo, hi = 0, n - 1
        while lo < hi:  # the last restart whose key is below the one looked for
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if next(self._entries(raw, restarts[mid], len(raw)))[0] < key else (lo, mid - 1)
        for found, value in self._entries(raw, restarts[lo], len(raw) - 4 - 4 * n):
            if found >= key:
                return value if found == key else None
        return None


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, writer, path, seq = TaskContext.get().partitionId(), None, "", 0
    encoder = library_encoder(tokenizer)
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    end = np.array([END_ID], encoder.kind)

    def closed():
        writer.close()
        row = (part, seq, path, writer.docs, writer.tokens)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    for batch in sliced(batches, "text"):
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(*byte_rows(batch)), strict=True):
            if writer is not None and writer.at >= shard_bytes:
                yield closed()
                writer, seq = None, seq + 1
            if writer is None:
                name = f"{uuid.uuid4().hex}.sst"  # a task that runs twice leaves an unlisted shard, never a torn one
                path, writer = f"{folder}/{name}", ShardWriter(system.open_output_stream(f"{base}/{name}", compression=None), encoder.kind.itemsize)
            writer.add(key_of(doc_id), np.concatenate([ids, end]))
    if writer is not None:
        yield closed()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of every whole text, each with END_ID at its end, in ascending order of doc_id; returns the list of shards.

    Null text is empty and gives END_ID alone; rows with a null id come first; rows that repeat an id are next to each other, in
    one shard or in shards that follow each other. An empty table gives an empty list. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.withColumn("deal", F.xxhash64("text") + F.spark_partition_id())  # rows that repeat an id, or have none, may fall into several shards
    ordered = dealt.repartitionByRange("doc_id", "deal").drop("deal").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(lambda it: _write(it, folder, tokenizer, shard_bytes), MANIFEST), "sst-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows = []
            for key, ids in ShardReader(path).scan():
                rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver handles one row per shard (of up to SHARD_BYTES), never one per document.
    """
    spark = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: (r.part, r.seq))
    starts = np.cumsum([0] + [r.tokens for r in shards]).tolist()
    rows = [(r.path, s) for r, s in zip(shards, starts, strict=False)]
    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), scratch(spark, "sst"), public_tokenizers.path("byte_bpe_50k.json")))
