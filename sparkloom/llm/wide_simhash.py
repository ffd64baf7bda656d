"""Near duplicates by SimHash at the distance of Jaccard 0.8: wide fingerprints in a byte-position index with a count filter; exact
sets decide.

Two sets of Jaccard 0.8 differ in 15 % of SimHash's bits, 10 of 64, so that 64 bits can leave no byte in common (op9's three bits can't
reach them). A fingerprint here has 352 positional bytes, in 176 groups of two; the index has a posting for the two bytes of each
group. A pair at 0.8 agrees in a group with probability 0.0715, so it shares no posting with probability 2e-6 (3e-5 for four shingles of
five, the least even case), closer ones less often. Pairs in a posting are counted: those of which more than MOST_BITS of the first 128
bits differ are dropped (a pair at 0.8 with probability 1e-6, all but 1e-5 of unrelated ones). The sets of the others are compared.

The hashes of a set's shingles are widened by a mixing function; a bit is the sign of the sum of their +1 and -1 at a position, two
positions turned into each other (weights 2 and 1, which stay orthogonal): sums of few shingles would tie too often.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sparkloom.llm import minhash

GROUPS, MOST_BITS = 176, 40
BITS = 16 * GROUPS
_SEEDS = np.random.default_rng(64).integers(0, 1 << 64, BITS // 64, dtype=np.uint64)
#: Ones of as many shingles are counted in single bytes.
_ROWS = 255


def widened(grams: np.ndarray) -> np.ndarray:
    """BITS // 8 bytes of each 64-bit hash, by the finalizer of SplitMix64."""
    z = grams[:, None] + _SEEDS
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z.view(np.uint8)


def fingerprint(grams: np.ndarray) -> bytes:
    """The positional bytes of a set of hashes; zero bytes for an empty one."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(grams), _ROWS):  # bounded memory for texts of any length
        ones += np.unpackbits(widened(grams[i : i + _ROWS]), axis=1).sum(axis=0, dtype=np.uint8)
    a, b = np.split(2 * ones - len(grams), 2)
    return np.packbits(np.concatenate([2 * a + b, 2 * b - a]) > 0).tobytes()


def position_keys(prints: np.ndarray) -> np.ndarray:
    """The keys of rows of positional bytes: a group's number and its two bytes."""
    pairs = prints.reshape(len(prints), GROUPS, 2).astype(np.int64)
    return np.arange(GROUPS) << 16 | pairs[:, :, 0] << 8 | pairs[:, :, 1]


def first_bits(prints: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(prints[:, :16]).view(np.uint64)


def counted(n: np.ndarray | None, marks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64) <= MOST_BITS


SIMHASH = minhash.Index(fingerprint, position_keys, first_bits, counted, words=2, sized=False)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """minhash.jaccard_components (rows, ids, words and links are as there) with candidates by SimHash."""
    return minhash.jaccard_components(docs, id_col, text_col, width, SIMHASH)
