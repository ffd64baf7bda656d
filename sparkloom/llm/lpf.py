"""Repeated passages over the whole corpus, by suffix order and longest-previous-factor arrays.

A passage is any run of `least` bytes (200) that starts at two places; matches never cross documents. No machine can hold the
suffix array of the corpus, so the corpus is dealt out such that equal windows of `least` bytes meet:

1. The documents are written to the shared folder in chunks of some MB. Every window has one anchor, the gram of `gram` bytes in it
   with the least hash; equal windows have equal anchors. Chunks send the hashes of their anchors, each once, to the bucket of the
   hash, and learn which occur elsewhere too. Most of the corpus ends here.
2. For the others a chunk sends, each once, the text around the anchor: its windows. A bucket sorts the suffixes that start windows,
   takes previous and next smaller positions in suffix order and from them the longest previous factor of every window. Anchors
   with very many occurrences (a passage in a third of all documents has them) are divided by window: these send the 128-bit
   hash of each window once a chunk, dealt out by that hash.
3. Chunks learn which of their windows are repeated, and which are first, and cut them from the texts.

A chunk sends any anchor, text or window once however often it holds it, so what meets in one task about a common passage is at
most one entry a chunk.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import byte_rows, filesystem, give_back, materialize, release_kept, scratch, shuffle_partitions, sliced, table, write_bytes

LEAST, GRAM = 200, 100
CHUNK_BYTES = 8 << 20
#: Window starts hashed at a time.
PIECE = 1 << 19
#: Anchors with more occurrences are divided by window.
HOT = 2000
#: Bytes of text in one suffix order.
ORDER_BYTES = 1 << 20
BASE, BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
MESSAGE = "bucket int, chunk string, kind int, data binary"
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- suffix order and longest previous factors ---------------------------------------------------------------------------------


def smaller_before(position: np.ndarray) -> np.ndarray:
    """For each entry the nearest earlier entry with a smaller position, -1 if there is none. All entries at once: candidates jump
    along candidates, which skip only larger positions."""
    found = np.arange(-1, len(position) - 1)
    open_ = np.flatnonzero((found >= 0) & (position[found] > position))
    while len(open_):
        found[open_] = found[found[open_]]
        at = found[open_]
        open_ = open_[(at >= 0) & (position[at] > position[open_])]
    return found


def smaller_after(position: np.ndarray) -> np.ndarray:
    """The same to the right; -1 if there is none."""
    found = len(position) - 1 - smaller_before(position[::-1])[::-1]
    return np.where(found == len(position), -1, found)


class SuffixOrder:
    """The suffixes of a text that start at given places, in the order of their first `least` bytes (all there), ties by place."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, least: int):
        if least < 8:
            raise ValueError("at least 8 bytes")
        padded = np.concatenate([text, np.zeros(8 + least, np.uint8)])
        key = np.zeros(len(text) + least, np.uint64)
        for i in range(8):
            key = key << np.uint64(8) | padded[i : i + len(key)]
        self.levels, size = {8: np.unique(key, return_inverse=True)[1].astype(np.int64)}, 8
        while size * 2 <= least and size < 64:
            rank = self.levels[size]
            both = rank << 32 | np.r_[rank[size:], np.zeros(size, np.int64)]
            size *= 2
            self.levels[size] = np.unique(both, return_inverse=True)[1].astype(np.int64)
        rank, done = np.zeros(len(starts), np.int64), 0
        while done < least:
            step = next(s for s in sorted(self.levels, reverse=True) if s <= least - done or s == 8)
            at = done if step <= least - done else least - 8
            rank = np.unique(rank << 32 | self.levels[step][starts + at], return_inverse=True)[1].astype(np.int64)
            done = at + step
        self.text, self.least, self.starts = padded, least, starts
        self.order = np.argsort(rank, kind="stable")
        self.rank = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at places a and b, `least` at most."""
        n = np.zeros(len(a), np.int64)
        open_ = np.ones(len(a), np.bool_)
        for size in sorted(self.levels, reverse=True):
            level = self.levels[size]
            for _ in range(-(-self.least // size) if size == max(self.levels) else 1):
                i = np.flatnonzero(open_ & (n + size <= self.least))
                i = i[level[a[i] + n[i]] == level[b[i] + n[i]]]
                n[i] += size
        for _ in range(8):
            i = np.flatnonzero(open_ & (n < self.least))
            same = self.text[a[i] + n[i]] == self.text[b[i] + n[i]]
            n[i[same]] += 1
            open_[i[~same]] = False
        return n

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each start, in the order given: the longest previous factor up to `least`, and the index of the start it matches."""
        position = self.order  # starts are given in text order
        best, source = np.zeros(len(position), np.int64), np.full(len(position), -1)
        for side in (smaller_before(position), smaller_after(position)):
            i = np.flatnonzero(side >= 0)
            mine, other = position[i], position[side[i]]
            n = self.common(self.starts[mine], self.starts[other])
            better = n > best[mine]
            best[mine[better]], source[mine[better]] = n[better], other[better]
        return best, source


# --- anchors -------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of any substring of some bytes, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int, room: int):
        up, self.down = _powers(base, room + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x


def window_runs(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> Iterator[tuple[int, Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the data: (where the piece starts, its hashes, then by run of windows with one anchor: the anchor's hash, its
    place, the first window's start, the number of windows); places count from the piece's start."""
    count, room = least - gram + 1, PIECE + least
    for low in range(0, len(data), PIECE):
        part = data[low : low + room - 1]
        first, last = np.maximum(offsets[:-1], low) - low, np.minimum(offsets[1:] - least, low + PIECE - 1) - low
        fits = last >= first
        if not fits.any():
            continue
        first, last = first[fits], last[fits]
        sizes = last - first + 1
        starts = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        rolling = Rolling(part, BASE, room)
        hashes = _grams(rolling, len(part), gram)
        bits = np.uint64(int(room).bit_length())
        best = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
        size = 1
        while size * 2 <= count:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if size < count:
            best = np.minimum(best[: len(best) - (count - size)], best[count - size :])
        anchor = (best[starts] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
        at = anchor[cuts]
        # Least hashes are all small: times an odd number they are spread over all buckets again.
        yield low, rolling, hashes[at] * np.uint64(BASE), at, starts[cuts], np.diff(np.r_[cuts, len(starts)])


def _grams(rolling: Rolling, n: int, gram: int) -> np.ndarray:
    x = (rolling.sums[gram:] - rolling.sums[:-gram]) * rolling.down[: n - gram + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


# --- chunks and messages -------------------------------------------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _messages(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in MESSAGE.split(", ")])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _write_chunks(batches: Iterator[pa.RecordBatch], folder: str, text_col: str) -> Iterator[pa.RecordBatch]:
    release_kept()
    held, size = [], 0

    def written() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in held:
                out.write_batch(b)
        name = uuid.uuid4().hex
        write_bytes(f"{folder}/{name}", sink.getvalue())
        return pa.RecordBatch.from_arrays([pa.array([name])], names=["chunk"])

    for batch in sliced(batches, text_col, CHUNK_BYTES // 4):
        held.append(batch)
        size += byte_rows(batch, text_col)[1][-1]
        if size >= CHUNK_BYTES:
            yield written()
            held, size = [], 0
    if held:
        yield written()


def _read_chunk(folder: str, name: str) -> pa.RecordBatch:
    give_back()  # what the chunk before took
    system, base = filesystem(folder)
    with system.open_input_file(f"{base}/{name}") as f, pa.ipc.open_stream(f) as rows:
        return rows.read_all().combine_chunks().to_batches()[0]


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int, bytes]]]]:
    """(chunk, its (bucket, kind, data) rows) of rows sorted by chunk."""
    name, rows = None, []
    for batch in batches:
        for bucket, chunk, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "data")), strict=True):
            if chunk != name and rows:
                yield name, rows
                rows = []
            name = chunk
            rows.append((bucket, kind, data))
    if rows:
        yield name, rows


def _send_anchors(batches: Iterator[pa.RecordBatch], folder: str, text_col: str, least: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    release_kept()
    for batch in batches:
        for name in batch.column("chunk").to_pylist():
            found = [h for _, _, h, _, _, _ in window_runs(*byte_rows(_read_chunk(folder, name), text_col), least, gram)]
            hashes, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            cuts = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1)).tolist()
            counts = np.minimum(counts, 65535).astype(np.uint16)
            # kind -1: a row that every chunk gets back, anchors or not
            yield _messages([(b, name, 0, _packed(hashes[i:j], counts[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j] + [(zlib.crc32(name.encode()) % buckets, name, -1, b"")])


def _answer_anchors(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """0: occurs once, 1: again, 2: very often. One bucket, or several whole ones, in a task."""
    release_kept()
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "data")), strict=True)]
    sent = [(b, c, *_unpacked(d)) for b, c, k, d in rows if k == 0]
    yield _messages([r for r in rows if r[2] < 0])
    if not sent:
        return
    hashes, inverse = np.unique(np.concatenate([s[2] for s in sent]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([s[3] for s in sent]), len(hashes))
    answer = ((total > 1).astype(np.uint8) + (total > hot))[inverse]
    at = 0
    for b, c, h, _ in sent:
        yield _messages([(b, c, 0, _packed(answer[at : at + len(h)]))])
        at += len(h)


def _send_windows(batches: Iterator[pa.RecordBatch], folder: str, text_col: str, id_col: str, least: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: texts around anchors, kind 1: hashes of windows. What the chunk needs to understand the answers is kept beside it."""
    release_kept()
    for name, answers in _by_chunk(batches):
        batch = _read_chunk(folder, name)
        data, offsets = byte_rows(batch, text_col)
        ids = batch.column(id_col).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        pieces = [(low, r, *(x for x in rest)) for low, r, *rest in window_runs(data, offsets, least, gram)]
        yield _messages([(zlib.crc32(name.encode()) % buckets, name, -1, b"")])
        if not pieces:
            write_bytes(f"{folder}/{name}.runs", _packed(*[np.zeros(0, np.int64)] * 6))
            continue
        known = np.unique(np.concatenate([p[2] for p in pieces]))
        code = np.concatenate([_unpacked(d)[0] for _, k, d in sorted(answers, key=lambda r: r[0]) if k == 0])
        # Each run, or each window of a hot run: hash pair, bytes from and to, windows, place of the anchor in it
        cool, warm = [], []
        for low, rolling, h, at, first, n in pieces:
            c = code[np.searchsorted(known, h)]
            i = np.flatnonzero(c == 1)
            cool.append((h[i], rolling.of(first[i], first[i] + n[i] + least - 1) + (at[i] - first[i]).astype(np.uint64), low + first[i], n[i]))
            i = np.flatnonzero(c == 2)
            if len(i):
                q = np.repeat(first[i] - np.r_[0, np.cumsum(n[i])[:-1]], n[i]) + np.arange(n[i].sum())
                other = Rolling(data[low : low + PIECE + least - 1], BASE_2, PIECE + least)
                warm.append((rolling.of(q, q + least), other.of(q, q + least), low + q, np.ones(len(q), np.int64)))
        kept, out = [], []
        for kind, found in enumerate((cool, warm)):
            a, b, start, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
            doc = np.searchsorted(offsets, start, side="right") - 1
            order = np.lexsort((start, ids[doc], b, a))
            a, b, start, n, doc = a[order], b[order], start[order], n[order], doc[order]
            lead = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, np.bool_)
            entry, one = np.cumsum(lead) - 1, np.flatnonzero(lead)
            copies = np.minimum(np.diff(np.r_[one, len(a)]), 2).astype(np.uint8)
            kept += [start, n, entry * 2 + lead]
            cuts = np.searchsorted(_bucket(a[one], buckets), np.arange(buckets + 1)).tolist()
            for bucket, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    e = one[i:j]
                    sent = [a[e], b[e], n[e].astype(np.uint8), copies[i:j], ids[doc[e]], start[e]]
                    if kind == 0:
                        sizes = n[e] + least - 1
                        sent.append(data[np.repeat(start[e] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())])
                    out.append((bucket, name, kind, _packed(*sent)))
        write_bytes(f"{folder}/{name}.runs", _packed(*kept))
        yield _messages(out)


def _judge_texts(h: np.ndarray, windows: np.ndarray, multiple: np.ndarray, text: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of different texts in the order of their first occurrence, by window: repeated anywhere? the first of its kind?"""
    repeated, first = np.repeat(multiple, windows), np.ones(windows.sum(), np.bool_)
    ends = np.cumsum(windows)
    by_anchor = np.argsort(h, kind="stable")
    cuts = np.r_[np.flatnonzero(np.r_[True, h[by_anchor][1:] != h[by_anchor][:-1]]), len(h)]
    group: list[int] = []
    size = 0

    def judge() -> None:
        own = np.sort(np.array(group))
        sizes = windows[own] + least - 1
        base = np.r_[0, np.cumsum(sizes)[:-1]]
        n = windows[own]
        spread = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        longest, source = SuffixOrder(np.concatenate([text[i] for i in own.tolist()]), np.repeat(base, n) + spread, least).previous_factors()
        at = np.repeat(ends[own] - n, n) + spread
        later = longest >= least
        first[at[later]] = False
        repeated[at[later]] = repeated[at[source[later]]] = True

    for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
        if j - i < 2:
            continue  # one text alone: repeated if it has copies
        group += by_anchor[i:j].tolist()
        size += int((windows[by_anchor[i:j]] + least - 1).sum())
        if size >= ORDER_BYTES:
            judge()
            group, size = [], 0
    if group:
        judge()
    return repeated, first


def _answer_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """For each entry of a chunk: bits of repeated windows, bits of first ones, and whether the chunk holds the entry's first occurrence."""
    release_kept()
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "data")), strict=True)]
    yield _messages([r for r in rows if r[2] < 0])
    for kind in (0, 1):
        sent = [(b, c, _unpacked(d)) for b, c, k, d in rows if k == kind]
        if not sent:
            continue
        a, b, n, copies, ids, start = (np.concatenate([s[2][i] for s in sent]) for i in range(6))
        chunk = np.repeat(np.argsort(np.argsort([s[1] for s in sent])), [len(s[2][0]) for s in sent])
        n = n.astype(np.int64)
        order = np.lexsort((start, chunk, ids, b, a))
        lead = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
        entry = np.empty(len(a), np.int64)
        entry[order] = np.cumsum(lead) - 1
        one = order[lead]  # of each entry its first occurrence
        multiple = np.bincount(entry, copies, len(one)) > 1
        if kind == 0:
            ends = np.cumsum(np.concatenate([s[2][2].astype(np.int64) + least - 1 for s in sent]))
            text = np.concatenate([s[2][6] for s in sent])
            rank = np.lexsort((start[one], chunk[one], ids[one]))  # text order
            back = np.argsort(rank)
            repeated, first = _judge_texts(a[one][rank], n[one][rank], multiple[rank], [text[ends[i] - n[i] - least + 1 : ends[i]] for i in one[rank].tolist()], least)
            spot = np.r_[0, np.cumsum(n[one][rank])[:-1]][back]
        else:
            repeated, first, spot = multiple, np.ones(len(one), np.bool_), np.arange(len(one))
        is_first = np.zeros(len(a), np.bool_)
        is_first[one] = True
        at = 0
        for bucket, name, s in sent:
            e, m = entry[at : at + len(s[0])], s[2].astype(np.int64)
            flat = np.repeat(spot[e] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            yield _messages([(bucket, name, kind, _packed(np.packbits(repeated[flat]), np.packbits(first[flat]), is_first[at : at + len(e)], m))])
            at += len(e)


def _repeats(folder: str, name: str, answers: list[tuple[int, int, bytes]], keep_first: bool) -> np.ndarray:
    """Starts of the chunk's windows to remove, ascending."""
    system, base = filesystem(folder)
    with system.open_input_file(f"{base}/{name}.runs") as f:
        kept = _unpacked(f.read())
    out = []
    for kind in (0, 1):
        start, n, entry = kept[3 * kind : 3 * kind + 3]
        got = [_unpacked(d) for _, k, d in sorted(answers, key=lambda r: r[0]) if k == kind]
        if not got:
            continue
        sizes = np.concatenate([g[3] for g in got])
        repeated, first = (np.concatenate([np.unpackbits(g[i], count=int(g[3].sum())) for g in got]).astype(np.bool_) for i in (0, 1))
        holds = np.concatenate([g[2] for g in got])
        e, local_first = entry >> 1, (entry & 1).astype(np.bool_)
        spread = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        flat = np.repeat((np.cumsum(sizes) - sizes)[e], n) + spread
        remove = repeated[flat]
        if keep_first:
            remove &= ~(np.repeat(local_first & holds[e], n) & first[flat])
        out.append((np.repeat(start, n) + spread)[remove])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _removed_spans(starts: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, from, to) of the maximal runs that the windows cover."""
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    doc = np.searchsorted(offsets, starts, side="right") - 1
    cuts = np.flatnonzero(np.r_[True, (starts[1:] > starts[:-1] + least) | (doc[1:] != doc[:-1])])
    return doc[cuts], starts[cuts], starts[np.r_[cuts[1:] - 1, len(starts) - 1]] + least


def _cut(batches: Iterator[pa.RecordBatch], folder: str, text_col: str, least: int, keep_first: bool, render: Callable) -> Iterator[pa.RecordBatch]:
    release_kept()
    for name, answers in _by_chunk(batches):
        batch = _read_chunk(folder, name)
        data, offsets = byte_rows(batch, text_col)
        doc, low, high = _removed_spans(_repeats(folder, name, answers, keep_first), offsets, least)
        by_doc = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
        kept, raw = [], data.tobytes()
        for k in range(batch.num_rows):
            at, parts = int(offsets[k]), []
            for i in range(by_doc[k], by_doc[k + 1]):
                parts.append(raw[at : low[i]])
                at = int(high[i])
            kept.append(b"".join([*parts, raw[at : offsets[k + 1]]]))
        removed = np.bincount(doc, high - low, batch.num_rows).astype(np.int64)
        yield render(batch, np.diff(offsets), removed, np.diff(by_doc), kept)


def _remove(docs: DataFrame, id_col: str, text_col: str, render: Callable, schema, least: int, gram: int, keep_first: bool, hot: int) -> DataFrame:
    spark = docs.sparkSession
    folder, buckets = scratch(spark, "chunks"), shuffle_partitions(spark)
    chunks = materialize(docs.mapInArrow(lambda it: _write_chunks(it, folder, text_col), "chunk string"), "chunk-list").repartition(buckets, "chunk")

    def to_buckets(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(buckets, F.col("bucket"))

    def to_chunks(rows: DataFrame) -> DataFrame:
        return rows.repartition(buckets, "chunk").sortWithinPartitions("chunk")

    asked = chunks.mapInArrow(lambda it: _send_anchors(it, folder, text_col, least, gram, buckets), MESSAGE)
    known = to_chunks(to_buckets(asked).mapInArrow(lambda it: _answer_anchors(it, hot), MESSAGE))
    sent = known.mapInArrow(lambda it: _send_windows(it, folder, text_col, id_col, least, gram, buckets), MESSAGE)
    judged = to_chunks(to_buckets(sent).mapInArrow(lambda it: _answer_windows(it, least), MESSAGE))
    return judged.mapInArrow(lambda it: _cut(it, folder, text_col, least, keep_first, render), schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after the removal of repeated passages.

    Every byte in a string of `least` bytes that also starts elsewhere goes; with keep_first, the occurrence in the smallest
    document id (then at the smallest place) stays. Null and shorter texts lose nothing. A null id comes before all others.
    Rows that repeat a text are documents of their own. An empty table gives an empty result. Other columns are ignored.
    """

    def render(batch, sizes, removed, spans, kept):
        ids = batch.column("doc_id")
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=[x.split()[0] for x in SPANS.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _remove(rows, "doc_id", "text", render, SPANS, least, gram, keep_first, hot)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, keep_first: bool = True, hot: int = HOT) -> DataFrame:
    """The rows of docs, all columns, with repeated passages removed from the text; a character that is cut through goes whole."""

    def render(batch, sizes, removed, spans, kept):
        old = batch.column(text_col)
        texts = [None if x is None and not len(k) else k.decode("utf-8", "ignore") for x, k in zip(old.to_pylist(), kept, strict=True)]
        return batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, old.type))

    return _remove(docs, id_col, text_col, render, docs.schema, least, gram, keep_first, hot)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


#: Windows by their MD5, islands of windows that overlap or touch, and the bytes between them.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
     w AS (SELECT k, unnest(range(1, octet_length(b) - {LEAST - 2})) AS p, b FROM d WHERE octet_length(b) >= {LEAST}),
     h AS (SELECT k, p, md5(array_slice(b, p, p + {LEAST - 1})) AS m FROM w),
     r AS (SELECT k, p FROM h QUALIFY count(*) OVER (PARTITION BY m) > 1),
     i AS (SELECT k, p, sum(CASE WHEN p > q + {LEAST} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS island FROM (SELECT k, p, lag(p, 1, p) OVER (PARTITION BY k ORDER BY p) AS q FROM r)),
     s AS (SELECT k, min(p) AS a, max(p) + {LEAST} AS z FROM i GROUP BY k, island),
     g AS (SELECT k, a, z, lag(z, 1, 1) OVER (PARTITION BY k ORDER BY a) AS after FROM s),
     t AS (SELECT k, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(array_slice(b, after, a - 1)), '' ORDER BY a) AS head FROM g JOIN d USING (k) GROUP BY k)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN t.k IS NULL THEN b ELSE unhex(head || hex(array_slice(b, last, octet_length(b)))) END) AS kept_sha256
FROM d LEFT JOIN t USING (k)
"""
