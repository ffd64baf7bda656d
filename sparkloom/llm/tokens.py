"""Token ids of whole texts, by pieces: a text falls into pieces that the vocabulary encodes independently, and most pieces recur.

The byte-level pattern lets a space start the piece of the non-space that follows it and never ends a piece there; a comma or full
stop never shares a piece with a letter beside it; a newline alone between two characters that aren't white space is a piece.
A text may therefore be cut there. Cut pieces are encoded once and kept in a table of bounded size. Cutting, hashing, looking up
and putting together are done with arrays over the texts' bytes; only new pieces become strings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sparkloom.llm.common import byte_rows, collector_paused, on_release

#: Pieces kept in a Python worker; when there are more, all are forgotten.
KEPT_PIECES = 1 << 20
#: Longer pieces aren't kept.
KEPT_BYTES = 64
#: Bytes that are cut and looked up at a time.
WINDOW_BYTES = 1 << 20
#: Words that go to the library as one text.
JOINED = 128
SPACE, NEWLINE = 32, 10
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd powers and their inverses modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, np.bool_)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


_ALPHA, _PLAIN, _MARK = _byte_set((65, 90), (97, 122)), _byte_set((33, 126)), _byte_set((44, 44), (46, 46))
#: First bytes of two-byte letters, U+00C0 to U+017F.
_LEAD = _byte_set((0xC3, 0xC5))


def flat_index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans that start there and have these sizes."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def cuts(data: np.ndarray, is_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where pieces may start, which bytes belong to letters); is_start marks texts' first bytes, and nothing is read across those."""
    n = len(data)
    following = np.full(n, SPACE, np.uint8)
    following[:-1] = data[1:]
    following[:-1][is_start[1:]] = SPACE
    lead = _LEAD[data] & (following >= 0x80) & ~((data == 0xC3) & ((following == 0x97) | (following == 0xB7)))  # no times, no division sign
    letter = _ALPHA[data] | lead
    letter[1:] |= lead[:-1]
    begins = _PLAIN[data] | lead  # surely no white space
    begins_next = np.zeros(n, np.bool_)
    begins_next[:-1] = begins[1:] & ~is_start[1:]
    ends_before = np.zeros(n, np.bool_)  # the byte before ends what is surely no white space
    ends_before[1:] = (_PLAIN[data] | letter)[:-1] & ~is_start[1:]
    mark = _MARK[data]
    out = is_start | (data == SPACE) & begins_next
    line = (data == NEWLINE) & begins_next & ends_before
    out |= line
    out[1:] |= line[:-1] | mark[1:] & letter[:-1] | (_ALPHA[data] | lead)[1:] & mark[:-1]
    return out, letter


class PieceTable:
    """Byte strings to id sequences, in arrays: open addressing by a 64-bit hash. Bytes are compared by the caller."""

    def __init__(self):
        self.bits, self.n = 12, 0
        self.spots = np.zeros(1 << self.bits, np.int32)  # entry + 1
        self.hashes = np.zeros(0, np.uint64)
        #: Of bytes and of ids: the pool, where entries start, how long they are, how much of the pool is used.
        self.pools = [np.zeros(0, np.uint8), np.zeros(0, np.uint32)]
        self.starts, self.sizes, self.used = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int32)] * 2, [0, 0]

    def _spot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where there is none."""
        out, spot = np.full(len(h), -1, np.int64), self._spot(h)
        entry = self.spots[spot].astype(np.int64) - 1
        open_ = np.flatnonzero(entry >= 0)
        entry = entry[open_]
        while len(open_):
            hit = self.hashes[entry] == h[open_]
            out[open_[hit]] = entry[hit]
            open_ = open_[~hit]
            spot[open_] = spot[open_] + 1 & len(self.spots) - 1
            entry = self.spots[spot[open_]].astype(np.int64) - 1
            open_, entry = open_[entry >= 0], entry[entry >= 0]
        return out

    def add(self, h: np.ndarray | None, *spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """New entries of distinct hashes that the table lacks, or of none (not to be found again); spans: (elements, sizes) of bytes and ids."""
        entry = np.arange(self.n, self.n + len(spans[0][1]))
        for k, (elements, sizes) in enumerate(spans):
            if self.used[k] + len(elements) > len(self.pools[k]):
                self.pools[k] = np.concatenate([self.pools[k][: self.used[k]], np.empty(self.used[k] // 2 + len(elements), self.pools[k].dtype)])
            self.pools[k][self.used[k] : self.used[k] + len(elements)] = elements
            self.starts[k] = np.concatenate([self.starts[k], self.used[k] + np.cumsum(sizes) - sizes])
            self.sizes[k] = np.concatenate([self.sizes[k], sizes.astype(np.int32)])
            self.used[k] += len(elements)
        self.n += len(entry)
        self.hashes = np.concatenate([self.hashes, np.zeros(len(entry), np.uint64) if h is None else h])
        if h is not None:
            if 2 * self.n > len(self.spots):
                self.bits = int(4 * self.n).bit_length()
                old, self.spots = self.spots[self.spots > 0].astype(np.int64) - 1, np.zeros(1 << self.bits, np.int32)
                self._place(old)
            self._place(entry)
        return entry

    def _place(self, entry: np.ndarray) -> None:
        spot = self._spot(self.hashes[entry])
        while len(entry):
            free = self.spots[spot] == 0
            self.spots[spot[free]] = entry[free] + 1  # of those that meet, one stays
            left = self.spots[spot] != entry + 1
            entry, spot = entry[left], spot[left] + 1 & len(self.spots) - 1


#: (bytes of pieces, their starts, their sizes, which are words) to (ids, how many of each piece).
Learn = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class PieceEncoder:
    """ids() gives the ids of each text, as unsigned numbers of 16 bits where the vocabulary allows it, else of 32."""

    def __init__(self, learn: Learn, vocabulary: int):
        self.vocabulary = vocabulary
        self.learn, self.kind, self.table = learn, np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4"), PieceTable()

    def forget(self) -> None:
        self.table = PieceTable()

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        return self.ids(*byte_rows(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Of texts back to back, given by their UTF-8 bytes and offsets."""
        with collector_paused():
            flat, before, done = [], [np.zeros(0, np.int64)], 0
            at, width = 0, WINDOW_BYTES
            starts_of_texts = offsets[:-1]
            while at < len(data):
                end = min(len(data), at + width)
                is_start = np.zeros(end - at, np.bool_)
                is_start[0] = True
                low, high = np.searchsorted(starts_of_texts, (at, end))
                is_start[starts_of_texts[low:high] - at] = True
                may, letter = cuts(data[at:end], is_start)
                starts = np.flatnonzero(may)
                if end < len(data):
                    if starts[-1] == 0:  # one piece, and it may go on
                        width *= 2
                        continue
                    end, starts = at + int(starts[-1]), starts[:-1]
                    high = int(np.searchsorted(starts_of_texts, end))
                got, counts = self._window(data[at:end], starts, letter[: end - at])
                total = done + np.cumsum(counts) - counts
                # A text's first id: that of the piece at its first byte; empty texts share the byte of the next one.
                before.append(total[np.searchsorted(starts, starts_of_texts[low:high] - at)])
                flat.append(got)
                done += len(got)
                at, width = end, WINDOW_BYTES
            found = np.concatenate(flat) if flat else np.zeros(0, self.kind)
            first = np.concatenate(before)
            first = np.r_[first, np.full(len(offsets) - len(first), done)].tolist()  # texts that begin where the bytes end are empty
            return [found[a:b] for a, b in zip(first, first[1:])]

    def _window(self, data: np.ndarray, starts: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many of each)."""
        sizes = np.diff(np.r_[starts, len(data)])
        if self.table.n > KEPT_PIECES:
            self.forget()
        table = self.table
        up, down = _powers(WINDOW_BYTES + 1 if len(data) <= WINDOW_BYTES else len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = (sums[starts + sizes] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xBF58476D1CE4E5B9) ^ sizes.astype(np.uint64)
        kept = sizes <= KEPT_BYTES
        entry = np.full(len(starts), -1, np.int64)
        entry[kept] = table.find(h[kept])
        letters = np.r_[0, np.cumsum(letter, dtype=np.int32)]
        word = letters[starts + sizes] - letters[starts] == sizes - (data[starts] == SPACE)

        def learnt(of: np.ndarray, hashes: np.ndarray | None) -> np.ndarray:
            ids, counts = self.learn(data, starts[of], sizes[of], word[of] & (sizes[of] > (data[starts[of]] == SPACE)))
            return table.add(hashes, (data[flat_index(starts[of], sizes[of])], sizes[of]), (ids, counts))

        new = np.flatnonzero((entry < 0) & kept)
        if len(new):
            distinct, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            entry[new] = learnt(new[first], distinct)[inverse]
        long = np.flatnonzero(~kept)
        if len(long):
            entry[long] = learnt(long, None)
        # Different pieces with equal hashes: none so far, but nothing rests on that.
        same = table.sizes[0][entry] == sizes
        i = np.flatnonzero(same & kept)
        differ = table.pools[0][flat_index(table.starts[0][entry[i]], sizes[i])] != (data if len(i) == len(starts) else data[flat_index(starts[i], sizes[i])])
        if differ.any():
            same[i[np.unique(np.repeat(np.arange(len(i)), sizes[i])[differ])]] = False
        if not same.all():
            of = np.flatnonzero(~same)
            entry[of] = learnt(of, None)
        counts = table.sizes[1][entry].astype(np.int64)
        return table.pools[1][flat_index(table.starts[1][entry], counts)].astype(self.kind), counts


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def joined_lists(lists: list, dtype=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of some lists, how many of each)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate([np.asarray(x, dtype) for x in lists]) if lists else np.zeros(0, dtype), sizes


def in_order(parts: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, sizes) of n spans that come in parts, each with the places of its spans."""
    where, ids, counts = np.concatenate([w for w, _ in parts]), np.concatenate([x for _, (x, _) in parts]), np.concatenate([c for _, (_, c) in parts])
    back = np.empty(n, np.int64)
    back[where] = np.arange(n)
    return ids[flat_index((np.cumsum(counts) - counts)[back], counts[back])], counts[back]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> PieceEncoder:
    """Of a tokenizers file; one per Python worker. Words go to the library's model without its pattern, other pieces through all its steps."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    # The same model for words that come in the byte alphabet, between newlines: no pattern to match, and where a word ends is plain to see.
    alphabet = byte_alphabet()
    shown = np.array([ord(alphabet[b]) for b in range(256)], "<u2")
    bare, gap = Tokenizer.from_file(path), alphabet[NEWLINE]
    bare.pre_tokenizer, bare.encode_special_tokens = pre_tokenizers.Split(gap, "isolated"), True
    gap_id = bare.token_to_id(gap)

    def words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        room = np.full(int(sizes.sum()) + len(sizes), NEWLINE, np.uint8)
        ends = np.cumsum(sizes + 1)
        room[flat_index(ends - sizes, sizes)] = data[flat_index(starts, sizes)]
        text = shown[room].tobytes().decode("utf-16-le")
        edges = [0, *ends[JOINED - 1 : -1 : JOINED].tolist(), len(text)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in bare.encode_batch_fast([text[a:b] for a, b in zip(edges, edges[1:])], add_special_tokens=False)])
        at = np.flatnonzero(ids == gap_id)
        return ids[ids != gap_id], np.diff(np.r_[at, len(ids)]) - 1

    def others(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = [data[a : a + n].tobytes().decode() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        return joined_lists([e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])

    def learn(data, starts, sizes, word):
        parts = [(of := np.flatnonzero(flag), f(data, starts[of], sizes[of])) for f, flag in ((words, word), (others, ~word)) if flag.any()]
        return in_order(parts, len(starts))

    encoder = PieceEncoder(learn, tokenizer.get_vocab_size())
    on_release(encoder.forget)
    return encoder
