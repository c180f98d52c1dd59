"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over a fixed-length window, the largest value of each filter goes
through a softmax layer. The network is trained in numpy on windows of labelled texts. A text is cut into windows
from end to end; its probabilities are the means over them, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import text_buffers

#: Bytes of a window; embedding size; filter widths and filters of each.
WINDOW, EMBED, WIDTHS, FILTERS = 128, 6, (2, 3, 5), 12
#: Labelled texts of each language that are used for training, at most; passes; windows of a batch.
TEXTS_EACH, EPOCHS, BATCH = 800, 6, 128
#: Windows that are put through the network at a time when predicting.
AT_ONCE = 256
UNDETERMINED = "und"
#: Probability of the best of four languages under which a long text is in none; with more languages it is less in proportion.
FLOOR = 0.4


class ByteCNN:
    """Weights of the network; byte 0 is padding and is never at a filter's maximum alone."""

    def __init__(self, languages: list[str], seed: int = 3):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = draw.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [draw.normal(0, 0.5 / np.sqrt(w), (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def convolve(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter, and where it is."""
        embedded = self.embedding[windows].reshape(len(windows), -1)
        tops, places = [], []
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases):
            n = windows.shape[1] - width + 1
            # every EMBED-th start of a sliding window over the flat embedding is one position
            rows = np.lib.stride_tricks.as_strided(embedded, (len(windows), n, width * EMBED), (embedded.strides[0], EMBED * embedded.itemsize, embedded.itemsize))
            values = (rows.reshape(-1, width * EMBED) @ weights).reshape(len(windows), n, FILTERS)
            place = values.argmax(1) if self.training else None
            tops.append((values.max(1) if place is None else np.take_along_axis(values, place[:, None], 1)[:, 0]) + bias)
            places.append(place)
        return np.maximum(np.concatenate(tops, 1), 0), places

    training = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden, _ = self.convolve(windows)
        return softmax(hidden @ self.out + self.out_bias)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        hidden, places = self.convolve(windows)
        delta = softmax(hidden @ self.out + self.out_bias)
        delta[np.arange(len(labels)), labels] -= 1
        delta /= len(labels)
        back = (delta @ self.out.T) * (hidden > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_biases = [], []
        for k, (width, weights, place) in enumerate(zip(WIDTHS, self.filters, places)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            spot = windows[np.arange(len(windows))[:, None, None], place[:, :, None] + np.arange(width)]
            inputs = self.embedding[spot].reshape(len(windows), FILTERS, -1)
            d_filters.append(np.einsum("bf,bfi->if", g, inputs))
            d_biases.append(g.sum(0))
            np.add.at(d_embedding, spot, (g[:, :, None] * weights.T).reshape(len(windows), FILTERS, width, EMBED))
        return [d_embedding, *d_filters, *d_biases, hidden.T @ delta, delta.sum(0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = 3) -> ByteCNN:
    """Adam over shuffled windows; half of the windows are cut short at random, so that short texts are known too."""
    languages = sorted({lang for _, lang in samples})
    model = ByteCNN(languages, seed)
    if len(languages) < 2:
        return model
    draw = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.zeros((len(samples), WINDOW), np.uint8)
    for row, (data, _) in zip(windows, samples):
        row[: len(data)] = np.frombuffer(data[:WINDOW], np.uint8)
    labels = np.array([number[lang] for _, lang in samples])
    first = [np.zeros_like(w) for w in model.weights()]
    second = [np.zeros_like(w) for w in model.weights()]
    model.training, step = True, 0
    rounds = max(epochs, min(40, 20_000 // max(1, len(samples))))
    for _ in range(rounds):
        order = draw.permutation(len(samples))
        for start in range(0, len(order), BATCH):
            at = order[start : start + BATCH]
            batch = windows[at]
            short = np.where(draw.random(len(at)) < 0.5, draw.integers(12, WINDOW, len(at)), WINDOW)
            batch[np.arange(WINDOW)[None, :] >= short[:, None]] = 0
            step += 1
            for w, g, m, v in zip(model.weights(), model.gradients(batch, labels[at]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.training = False
    return model


def cut_windows(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, row of each, its bytes) over all bytes of all rows, ``AT_ONCE`` windows at a time."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, AT_ONCE):
        which = np.arange(low, min(total, low + AT_ONCE))
        row = np.searchsorted(ends, which, "right")
        start = offsets[row] + (which - (ends[row] - counts[row])) * WINDOW
        size = np.minimum(WINDOW, offsets[row + 1] - start)
        spot = start[:, None] + np.arange(WINDOW)
        windows = data[np.minimum(spot, len(data) - 1)]
        windows[np.arange(WINDOW)[None, :] >= size[:, None]] = 0
        yield windows, row, size


def training_windows(docs: DataFrame, text_col: str, lang_col: str, key: str, most: int) -> list[tuple[bytes, str]]:
    """Two windows, at places drawn by hash, of at most about ``most`` texts of each language."""
    known = docs.filter(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    sizes = known.groupBy(lang_col).count().collect()
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], min(1.0, most / r[1]))])[F.col(lang_col)]
    draw = F.xxhash64(F.col(key), F.lit(13))
    picked = known.filter(F.pmod(draw, F.lit(1 << 20)) / float(1 << 20) < share)
    data, n = F.col(text_col).cast("binary"), F.octet_length(text_col)
    at = lambda salt: 1 + F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.greatest(F.lit(1), n - WINDOW + 1))
    cut = lambda salt: F.struct(F.substring(data, at(salt).cast("int"), F.lit(WINDOW)).alias("w"))
    rows = picked.select(F.col(lang_col).alias("lang"), F.explode(F.array(cut(17), cut(19))).alias("x")).select("lang", "x.w")
    return sorted((bytes(r["w"]), r["lang"]) for r in rows.limit(4 * most * len(sizes)).collect())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", most: int = TEXTS_EACH) -> ByteCNN:
    """The network from the labelled rows of ``docs``; null languages and empty texts are left out."""
    return train(training_windows(docs, text_col, lang_col, key, most))


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def in_a_language(model: ByteCNN, text_col: str = "text", score_col: str = "score") -> Column:
    """Whether a predicted row is in one of the network's languages.

    Texts without a letter aren't, nor those in which the best language stays under a floor. The floor rises with the evidence, from
    the probability of a guess for no bytes towards ``FLOOR`` for many; it is half way at one window. All texts with a letter
    pass where nothing was learned.
    """
    if not model.languages:
        return has_letter(text_col)
    guess = 1 / len(model.languages)
    above = max(0.0, FLOOR * min(1.0, 4 * guess) - guess)
    n = F.octet_length(text_col)
    # the best probability is a guess's at least, but for rounding
    return has_letter(text_col) & (F.col(score_col) >= F.lit(guess - 1e-9) + F.lit(above) * n / (n + WINDOW))


def predict(docs: DataFrame, model: ByteCNN, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All rows and columns plus the language and its probability.

    Null texts and texts without a letter are ``und`` with score 0, as is everything where nothing was learned.
    Columns with the names of the results are replaced.
    """
    # a fixed number of weights, a few kilobytes
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def classified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shipped.value
        for texts in batches:
            offsets, data = text_buffers(texts)
            n = len(offsets) - 1
            if not net.languages:
                yield pa.StructArray.from_arrays([pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n))], ["lang", "score"])
                continue
            mass, weight = np.zeros((n, len(net.languages))), np.zeros(n)
            for windows, row, size in cut_windows(offsets, data):
                np.add.at(mass, row, net.probabilities(windows) * size[:, None])
                np.add.at(weight, row, size)
            mean = mass / np.maximum(weight, 1)[:, None]
            best = mean.argmax(1)
            yield pa.StructArray.from_arrays([pa.array([net.languages[i] for i in best], pa.string()), pa.array(np.clip(mean[np.arange(n), best], 0, 1))], ["lang", "score"])

    lettered = has_letter(text_col)
    out = docs.withColumn("_found", F.when(lettered, F.col(text_col)))
    out = out.withColumn("_found", classified("_found"))
    return (
        out.withColumn("_lettered", lettered)
        .withColumn(lang_col, F.when(F.col("_lettered"), F.col("_found.lang")).otherwise(UNDETERMINED))
        .withColumn(score_col, F.when(F.col("_lettered"), F.col("_found.score")).otherwise(F.lit(0.0)))
        .drop("_found", "_lettered")
    )
