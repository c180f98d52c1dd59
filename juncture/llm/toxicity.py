"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Texts are read as bytes of Arrow batches. A word is a run of ASCII letters, digits and bytes above 127, lower-cased; its hash is a
difference of prefix sums, so a batch is hashed without a loop over words. Features are words, pairs of
neighbours and pairs with one word between; each counts once per text, and the weights of a text's features add up to its log odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import row_blocks, text_buffers

#: Bits of the feature space; labelled texts that are used for training, at most; updates that training aims at.
BITS, TRAIN_ROWS, UPDATES = 20, 6000, 24_000
#: Step size, smoothing, L1 and L2 of FTRL-proximal.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _letter_codes() -> np.ndarray:
    """Zero for separators, else the lower-cased byte plus one."""
    codes = np.arange(256, dtype=np.uint64) + np.uint64(1)
    for byte in range(256):
        char = chr(byte)
        if byte < 128 and not char.isalnum():
            codes[byte] = 0
        elif "A" <= char <= "Z":
            codes[byte] += np.uint64(32)
    return codes


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = np.full(n, 6364136223846793005, np.uint64)
    inverse = np.full(n, pow(6364136223846793005, -1, 1 << 64), np.uint64)
    base[:1] = inverse[:1] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


class WordHasher:
    """Word hashes and feature numbers of a run of bytes."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.codes = _letter_codes()
        self.powers, self.inverses = _powers(2 * BLOCK)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word."""
        if len(data) > len(self.powers):
            self.powers, self.inverses = _powers(2 * len(data))
        codes = self.codes[data]
        inside = np.concatenate([[False], codes != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.powers[: len(codes)], dtype=np.uint64)])
        return starts, (sums[ends] - sums[starts]) * self.inverses[starts]

    def features(self, hashes: np.ndarray, same_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature number, index of the last word): words, neighbours and pairs one apart, inside one text.

        ``same_text`` holds the text number of each word.
        """
        mixed = (hashes ^ (hashes >> np.uint64(29))) * _ODD
        out, at = [mixed >> self.shift], [np.arange(len(hashes))]
        for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
            if len(hashes) > gap:
                ok = np.flatnonzero(same_text[gap:] == same_text[:-gap])
                pair = (mixed[ok] * np.uint64(salt) ^ mixed[ok + gap]) * _ODD
                out.append((pair ^ (pair >> np.uint64(31))) * _ODD >> self.shift)
                at.append(ok + gap)
        return np.concatenate(out).astype(np.int64), np.concatenate(at)


def distinct_features(data: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """The distinct features of one text of any length, a block at a time."""
    kept, start, carried = [np.zeros(0, np.int64)], 0, np.zeros(0, np.uint64)
    while start < len(data):
        end = min(len(data), start + BLOCK)
        while end < len(data) and hasher.codes[data[end]] != 0:
            gaps = np.flatnonzero(hasher.codes[data[end : end + BLOCK]] == 0)
            end = end + int(gaps[0]) if len(gaps) else min(len(data), end + BLOCK)
        _, hashes = hasher.words(data[start:end])
        hashes = np.concatenate([carried, hashes])
        kept.append(np.unique(hasher.features(hashes, np.zeros(len(hashes), np.int64))[0]))
        carried, start = hashes[-2:], end
    return np.unique(np.concatenate(kept))


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, updates: int = UPDATES) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers and weights that L1 left non-zero, and the bias, from (distinct features, label) pairs.

    ``z`` and ``n`` are FTRL-proximal's two sums per coordinate; a weight is worked out when it is used.
    """
    bias_at = 1 << bits
    z, n = np.zeros(bias_at + 1), np.zeros(bias_at + 1)
    bags = [(np.append(found, bias_at), y) for found, y in rows]

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias_at, 0.0, L1)
        rate = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / rate)

    order = np.random.default_rng(5)
    for _ in range(max(4, min(24, updates // max(1, len(bags))))):
        for i in order.permutation(len(bags)):
            at, y = bags[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    at = np.flatnonzero(n[:bias_at] > 0)
    w = weights(at)
    kept = w != 0
    bias = float(weights(np.array([bias_at]))[0]) if rows else 0.0
    return at[kept], w[kept], bias


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> list[tuple[np.ndarray, int]]:
    """(features of the whole text, label) of at most about ``most`` labelled texts, as evenly from both classes as they allow.

    A hash of the identifier picks them and tasks hash their texts. Labels other than 0 and 1 are left out; of repeated labels the larger holds.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    sizes = dict(known.groupBy("_y").count().collect())
    half = most // 2
    share = {y: min(1.0, max(half, most - sizes.get(1 - y, 0)) / k) for y, k in sizes.items()}
    if not share:
        return []
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    limit = F.when(F.col("_y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    picked = known.filter(draw < limit)

    @F.arrow_udf("binary")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for texts in batches:
            offsets, data = text_buffers(texts)
            yield pa.array([distinct_features(data[a:b], hasher).astype(np.int32).tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())

    # about ``most`` identifiers, so they are broadcast in place of a shuffle of all texts
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(picked), id_col)
    found = rows.select(F.col("_y"), features("_t").alias("_f")).limit(2 * most).collect()
    return [(np.frombuffer(f, np.int32).astype(np.int64), int(y)) for y, f in sorted((r["_y"], bytes(r["_f"])) for r in found)]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All rows and columns plus the score, from 0 to 1; a text without words gets the bias's."""
    at, w, bias = model
    # compact: only the weights that L1 left, some tens of kilobytes, go to the tasks
    sparse = docs.sparkSession.sparkContext.broadcast((at, w.astype(np.float32), bias))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        where, values, base = sparse.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[where] = values
        hasher = WordHasher()
        for texts in batches:
            offsets, data = text_buffers(texts)
            total = np.zeros(len(offsets) - 1)
            for first, last in row_blocks(offsets, BLOCK):
                total[first:last] = block_sums(offsets[first : last + 1], data, hasher, dense)
            yield pa.array(1 / (1 + np.exp(-np.clip(total + base, -35, 35))))

    return docs.withColumn(out_col, scored(F.col(text_col)))


def block_sums(offsets: np.ndarray, data: np.ndarray, hasher: WordHasher, dense: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's distinct features. A long text is read in pieces that overlap by two words."""
    sums = np.zeros(len(offsets) - 1)
    if len(offsets) == 2 and offsets[1] - offsets[0] > 4 * BLOCK:
        sums[0] = dense[distinct_features(data[offsets[0] : offsets[1]], hasher)].sum()
        return sums
    piece = data[offsets[0] : offsets[-1]]
    # words don't run on from one text into the next: each text is set apart by a separator byte
    apart = np.insert(piece, (offsets[1:-1] - offsets[0]), 32) if len(offsets) > 2 else piece
    begins = offsets[:-1] - offsets[0] + np.arange(len(offsets) - 1)
    starts, hashes = hasher.words(apart)
    text = np.searchsorted(begins, starts, "right") - 1
    found, last = hasher.features(hashes, text)
    weighty = np.flatnonzero(dense[found])
    # each feature counts once per text
    pairs = np.unique(text[last[weighty]] * dense.size + found[weighty])
    np.add.at(sums, pairs // dense.size, dense[pairs % dense.size])
    return sums


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from at most about ``most`` labelled texts, whole; without labels its score is one half."""
    return train(labelled_rows(docs, labels, id_col, text_col, label_col, most))
