"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. Features of the line and of its two neighbours score its label, a 2x2 matrix scores pairs of
neighbouring labels, and forward-backward gives each line's probability of being good. The mean of these marginals, weighted by
the lines' lengths, is the document's quality; a logistic curve on it, fitted on the same sample, makes it a probability.

Time and memory are linear in bytes and lines, a document of any length included: features are made for some lines at a time and
reduced to their scores, and messages run over strides of all documents at once, which 2x2 products carry from stride to stride.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import byte_rows, held_out, sliced, table

#: Bounds of the fit: labelled rows, lines of a row (longer ones are left out of the fit).
SAMPLE_ROWS, SAMPLE_LINES = 4000, 200
#: Lines whose features are held at a time; steps of a chain that are taken one by one.
PIECE_LINES, STRIDE = 1 << 15, 256
STEPS, RATE, PENALTY = 300, 0.05, 1e-3
FEATURES = ("length", "upper", "symbols", "digits", "stops", "spaces", "wide", "word length", "word repeats", "word variety", "symbol words", "line repeats", "blank", "short")
_UPPER, _DIGIT, _SYMBOL, _STOP, _SPACE, _WIDE = range(1, 7)


def _classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[ord("A") : ord("Z") + 1] = _UPPER
    t[ord("0") : ord("9") + 1] = _DIGIT
    t[list(b"!\"#$%&()*+/<=>?@[\\]^_`{|}~")] = _SYMBOL
    t[list(b".,;:'-")] = _STOP
    t[[9, 11, 12, 13, 32]] = _SPACE
    t[128:] = _WIDE
    return t


CLASS = _classes()


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents back to back: (their bytes with a newline after each, where each line ends, offsets of the documents' lines).

    A newline ends a line; a document has one line more than newlines, an empty document one empty line.
    """
    sizes, docs = np.diff(offsets), len(offsets) - 1
    room = np.full(len(data) + docs, 10, np.uint8)
    at = offsets[1:-1] + np.arange(docs - 1)
    keep = np.ones(len(room), np.bool_)
    keep[at], keep[-1] = False, False
    room[keep] = data
    ends = np.flatnonzero(room == 10)
    return room, ends, np.r_[0, np.searchsorted(ends, offsets[1:] + np.arange(docs)) + 1] if len(sizes) else np.zeros(1, np.int64)


def _piece_features(room: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some whole lines: (features but for repeats of lines, a hash of each line's words, has the line words?)."""
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    n = np.maximum(length, 1)
    kind = CLASS[room]

    def share(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64) / n  # the newline itself is of no class

    out = np.zeros((len(ends), len(FEATURES)))
    out[:, 0] = np.log1p(length) / 8
    for j, k in ((1, _UPPER), (2, _SYMBOL), (3, _DIGIT), (4, _STOP), (5, _SPACE), (6, _WIDE)):
        out[:, j] = share(kind == k)
    blank = (kind == _SPACE) | (room == 10)
    word = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    total, words = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.int64)
    if len(word):
        stop = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
        line = np.searchsorted(ends, word)
        words = np.bincount(line, minlength=len(ends))
        w = np.maximum(words, 1)
        # A hash of each word: bytes times odd powers of their place, summed modulo 2^64.
        place = np.arange(len(room)) - np.repeat(np.r_[0, word], np.diff(np.r_[0, word, len(room)]))
        power = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
        weighted = np.where(blank, np.uint64(0), (room.astype(np.uint64) + np.uint64(1)) * power[place & 255])
        value = np.add.reduceat(weighted, word)
        again = np.r_[False, (value[1:] == value[:-1]) & (line[1:] == line[:-1])]
        mixed = (value ^ value >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        seen = np.unique(mixed >> np.uint64(24) | line.astype(np.uint64) << np.uint64(40)) >> np.uint64(40)
        out[:, 7] = np.bincount(line, stop - word, len(ends)) / w / 16
        out[:, 8] = np.bincount(line, again, len(ends)) / w
        out[:, 9] = np.bincount(seen.astype(np.int64), minlength=len(ends)) / w
        out[:, 10] = np.bincount(line, kind[stop - 1] == _SYMBOL, len(ends)) / w
        np.add.at(total, line, mixed)
    out[:, 12] = length == 0
    out[:, 13] = length < 30
    return out, total, words > 0


def _pieces(room: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Features of PIECE_LINES lines, or of lines of some MB, at a time: (from line, to line, what _piece_features() gives)."""
    low = 0
    while low < len(ends):
        begin = int(ends[low - 1]) + 1 if low else 0
        high = min(low + PIECE_LINES, max(low + 1, int(np.searchsorted(ends, begin + (1 << 22)))))
        yield low, high, _piece_features(room[begin : ends[high - 1] + 1], ends[low:high] - begin)
        low = high


def _line_repeats(total: np.ndarray, worded: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
    """Has the document a line of the same words before?"""
    owner = np.repeat(np.arange(len(by_doc) - 1), np.diff(by_doc))
    order = np.lexsort((total, owner))
    out = np.zeros(len(total), np.bool_)
    out[order[1:]] = (total[order][1:] == total[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & worded[order[1:]]
    return out


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents back to back: (features of every line, lengths of the lines, offsets of the documents' lines)."""
    room, ends, by_doc = lines_of(data, offsets)
    parts = [x for _, _, x in _pieces(room, ends)]
    features, total, worded = (np.concatenate(x) for x in zip(*parts, strict=True))
    features[:, 11] = _line_repeats(total, worded, by_doc)
    return features, np.diff(np.r_[-1, ends]) - 1, by_doc


def with_neighbours(features: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
    """Beside each line's features those of the line before and after (zeros at the ends of a document) and a constant."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[by_doc[:-1]] = 0
    after[by_doc[1:] - 1] = 0
    return np.hstack([features, before, after, np.ones((len(features), 1))])


def _messages(d: np.ndarray, by_doc: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Log odds of the message from the left before every line; d are the lines' own log odds, pairs[i, j] scores label i before j.

    Documents are cut in strides. Products of all whole strides' matrices come first, step by step over all strides at once; they
    carry the message from stride to stride; then the messages inside strides follow, again over all strides at once.
    """
    e, x, out = np.exp(pairs - pairs.max()), np.exp(np.clip(d, -50, 50)), np.zeros(len(d))
    sizes = np.diff(by_doc)
    strides = -(-sizes // STRIDE)
    first = np.r_[0, np.cumsum(strides)]
    turn = np.arange(first[-1]) - np.repeat(first[:-1], strides)  # of a stride in its document
    start = np.repeat(by_doc[:-1], strides) + turn * STRIDE
    size = np.minimum(np.repeat(by_doc[1:], strides) - start, STRIDE)

    def stepped(u: np.ndarray, at: np.ndarray) -> np.ndarray:
        v0, v1 = u[0], u[1] * x[at]
        u = np.stack([e[0, 0] * v0 + e[1, 0] * v1, e[0, 1] * v0 + e[1, 1] * v1])
        return u / u.reshape(-1, len(at)).max(axis=0)

    state = np.ones((2, len(start)))
    if (whole := np.flatnonzero(turn < np.repeat(strides, strides) - 1)).size:
        product = np.zeros((2, 2, len(whole)))
        product[0, 0] = product[1, 1] = 1
        for t in range(STRIDE):
            product = stepped(product, start[whole] + t)
        of = np.full(len(start), -1)
        of[whole] = np.arange(len(whole))
        open_ = first[:-1][strides > 1]
        for k in range(1, int(strides.max())):
            open_ = open_[of[open_ + k - 1] >= 0]
            m, s = product[:, :, of[open_ + k - 1]], state[:, open_ + k - 1]
            s = m[:, 0] * s[0] + m[:, 1] * s[1]
            state[:, open_ + k] = s / s.max(axis=0)
    order = np.argsort(-size, kind="stable")
    falling, start, state = -size[order], start[order], state[:, order]
    for t in range(int(-falling[0]) if len(falling) else 0):
        live = int(np.searchsorted(falling, -t, side="left"))
        at = start[:live] + t
        out[at] = np.log(state[1, :live] / state[0, :live])
        state = stepped(state[:, :live], at)
    return out


def log_odds(d: np.ndarray, pairs: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
    """Of the second label, given the whole document."""
    return d + _messages(d, by_doc, pairs) + _messages(d[::-1], len(d) - by_doc[::-1], pairs.T)[::-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def forward_backward(scores: np.ndarray, pairs: np.ndarray, by_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of both labels for every line, expected numbers of label pairs, logarithm of the normaliser of each document)."""
    d = scores[:, 1] - scores[:, 0]
    left, right = _messages(d, by_doc, pairs), _messages(d[::-1], len(d) - by_doc[::-1], pairs.T)[::-1]
    good = sigmoid(d + left + right)
    inner = np.ones(len(d), np.bool_)
    inner[by_doc[:-1]] = False
    at, e = np.flatnonzero(inner), np.exp(pairs)
    before, after = sigmoid((left + d)[at - 1]), sigmoid((d + right)[at])
    before, after = np.stack([1 - before, before], axis=1), np.stack([1 - after, after], axis=1)
    joint = before[:, :, None] * e * after[:, None, :]
    joint /= joint.sum(axis=(1, 2))[:, None, None]
    own = scores[:, 0] + np.logaddexp(-np.logaddexp(0, left), d - np.logaddexp(0, -left))
    own[at] += np.log((before @ e).sum(axis=1))
    last = np.add.reduceat(own, by_doc[:-1]) + np.log(2) if len(d) else np.zeros(0)
    return np.stack([1 - good, good], axis=1), joint.sum(axis=0), last


@dataclass
class Model:
    weights: np.ndarray
    pairs: np.ndarray
    curve: tuple[float, float]

    def mean(self, d: np.ndarray, length: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
        """The marginals' mean, weighted by length, of documents whose lines have the log odds d of their own."""
        good, weight = sigmoid(log_odds(d, self.pairs, by_doc)), length + 1.0
        return np.clip(np.add.reduceat(good * weight, by_doc[:-1]) / np.add.reduceat(weight, by_doc[:-1]), 1e-9, 1 - 1e-9)

    def raw(self, x: np.ndarray, length: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
        return self.mean(x @ (self.weights[:, 1] - self.weights[:, 0]), length, by_doc)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        room, ends, by_doc = lines_of(data, offsets)
        own, before, after, constant = np.split(self.weights[:, 1] - self.weights[:, 0], [k * len(FEATURES) for k in (1, 2, 3)])
        parts = [np.zeros((len(ends), 3)), np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.bool_)]
        weights = np.stack([own, before, after], axis=1)
        for low, high, (features, total, worded) in _pieces(room, ends):
            parts[0][low:high], parts[1][low:high], parts[2][low:high] = features @ weights, total, worded
        d = parts[0]
        d[_line_repeats(*parts[1:], by_doc)] += weights[11]
        out = d[:, 0] + constant
        joined = np.ones(len(ends), np.bool_)
        joined[by_doc[:-1]] = False  # has a line before it
        out[1:] += np.where(joined[1:], d[:-1, 1], 0)
        out[:-1] += np.where(joined[1:], d[1:, 2], 0)
        q = self.mean(out, np.diff(np.r_[-1, ends]) - 1, by_doc)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))


def train(features: np.ndarray, length: np.ndarray, by_doc: np.ndarray, quality: np.ndarray) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam; the label of a document is that of its lines. Documents weigh alike, labels too."""
    x = with_neighbours(features, by_doc)
    sizes = np.diff(by_doc)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    y = quality[owner]
    truth = np.zeros((len(x), 2))
    truth[np.arange(len(x)), y] = 1
    inner = np.ones(len(x), np.bool_)
    inner[by_doc[:-1]] = False
    pairs_seen = np.zeros((2, 2))
    np.add.at(pairs_seen, (y[inner], y[inner]), 1)
    w, p = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(p), np.zeros_like(p)]
    for step in range(1, STEPS + 1):
        marginal, expected, _ = forward_backward(x @ w, p, by_doc)
        grads = (x.T @ (truth - marginal) / len(x) - PENALTY * w, (pairs_seen - expected) / len(x) - PENALTY * p)
        for k, (v, g) in enumerate(zip((w, p), grads, strict=True)):
            m, s = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model = Model(w, p, (1.0, 0.0))
    q = model.raw(x, length, by_doc)
    z = np.stack([np.clip(np.log(q / (1 - q)), -12, 12), np.ones(len(q))])
    c = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's method
        prob = 1 / (1 + np.exp(-(c @ z)))
        c += np.linalg.solve((z * (prob * (1 - prob))) @ z.T + 1e-3 * np.eye(2), z @ (quality - prob) - 1e-3 * (c - [1, 0]))
    return Model(w, p, (float(c[0]), float(c[1])))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        f, length, by_doc = line_features(*byte_rows(batch))
        rows = [(f[a:b].tobytes(), length[a:b].tobytes()) for a, b in zip(by_doc.tolist(), by_doc[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["quality", "features", "length"])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Of rows (doc_id, text, quality); about sample_rows of them, chosen by a hash of the id, are used. Null labels are left out, as are
    texts of more than SAMPLE_LINES lines: the driver holds SAMPLE_ROWS x SAMPLE_LINES lines' features at most."""
    lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = labelled.where(F.col("quality").isNotNull() & (F.coalesce(lines, F.lit(0)) < SAMPLE_LINES))
    part = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).select("text", F.col("quality").cast("int").alias("quality"))
    found = sample.mapInArrow(_extract, "quality int, features binary, length binary").collect()
    found.sort(key=lambda r: (r.features, r.quality))
    if len({r.quality for r in found}) < 2:  # nothing to tell apart
        p = np.clip(found[0].quality if found else 0.5, 0.01, 0.99)
        return Model(np.zeros((3 * len(FEATURES) + 1, 2)), np.zeros((2, 2)), (1.0, float(np.log(p / (1 - p)))))
    features = np.concatenate([np.frombuffer(r.features).reshape(-1, len(FEATURES)) for r in found])
    length = np.concatenate([np.frombuffer(r.length, np.int64) for r in found])
    by_doc = np.r_[0, np.cumsum([len(r.length) // 8 for r in found])]
    return train(features, length, by_doc, np.array([r.quality for r in found]))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(*byte_rows(batch)))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its whole text alone; null and empty texts are one empty line. Rows that repeat score alike;
    an empty table gives an empty result. A text's bytes and lines may be of any number. Other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, model), "doc_id long, score double")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    keep = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    return keep.join(labels.select("doc_id", "quality"), "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
