"""Embedding whitening from covariances by polarisation.

Squares are all that is summed: of every dimension's centred values, and of every two dimensions' centred sum. As
``(a + b)^2 - a^2 - b^2 = 2ab``, differences of those variances are the covariances. All sums are of whole numbers and exact at
any size, so cancellation costs no digit; the matrix is rounded once, before ``eigh``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import materialise

#: Entries become whole numbers floor(SCALE * c) + SHIFT; beyond MOST they are cut off there, so that they fit 64 bits.
SCALE, SHIFT, MOST = 1024, 100_000, float(1 << 61)
#: Bits of a limb of a value, so that sums of squares of so many rows fit 64 bits; bits of a limb of a sum on its way through Spark.
LIMB, ROWS, WORD = 20, 1 << 12, 32


def whole_numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have ``width`` finite entries, and these entries as whole numbers, a row each."""
    fits = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width
    flat = column.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    good = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat[good] * SCALE)
    return np.flatnonzero(fits)[good], np.clip(scaled, -MOST, MOST).astype(np.int64) + SHIFT


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums over rows of 64-bit numbers, as plain integers."""
    low = (x & ((1 << WORD) - 1)).sum(axis=0)
    return (x >> WORD).sum(axis=0).astype(object) * (1 << WORD) + low.astype(object)


def square_sums(d: np.ndarray) -> np.ndarray:
    """Sums over rows of ``(d_i + d_j)^2`` for ``i < j`` and of ``d_i^2`` for ``i = j``, row after row of the triangle, as plain integers."""
    width = d.shape[1]
    total = np.zeros(width * (width + 1) // 2, object)
    limbs = 1 + int(max(abs(int(d.min(initial=0))), abs(int(d.max(initial=0))))).bit_length() // LIMB
    t = np.ascontiguousarray(d.T)
    cut = [(t >> LIMB * k) & ((1 << LIMB) - 1) if k + 1 < limbs else t >> LIMB * k for k in range(limbs)]
    for k in range(limbs):
        for m in range(k, limbs):
            found, at = np.empty(len(total), np.int64), 0
            for i in range(width):
                a, b = cut[k][i] + cut[k][i:], cut[m][i] + cut[m][i:]
                a[0], b[0] = cut[k][i], cut[m][i]
                found[at : at + width - i] = np.einsum("jr,jr->j", a, b)
                at += width - i
            total += found.astype(object) * ((1 + (k != m)) << LIMB * (k + m))
    return total


def limbs_of(total: int) -> Iterator[int]:
    """A whole number in limbs, the last of which has the sign."""
    while not -(1 << WORD) < total < 1 << WORD:
        yield total & ((1 << WORD) - 1)
        total >>= WORD
    yield total


def exact_sums(parts: DataFrame, *key: str) -> DataFrame:
    """Limbs of the tasks' sums added up: a row per key and limb."""
    return parts.groupBy(*key, "limb").agg(F.sum("value").alias("value"))


def from_limbs(rows: Iterable, of: str) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for r in rows:
        out[r[of]] += r["value"] << WORD * r["limb"]
    return out


@dataclass(frozen=True)
class Moments:
    """Number of vectors, their sums by dimension, and ``n^2`` times the sum of centred products, all exact."""

    n: int
    sums: tuple[int, ...]
    products: tuple[tuple[int, ...], ...]

    @property
    def width(self) -> int:
        return len(self.sums)

    def covariance(self) -> np.ndarray:
        """Each entry is one division of whole numbers."""
        return np.array([[p / self.n**3 for p in row] for row in self.products], float).reshape(self.width, self.width)


def moments(vectors: DataFrame, vector_col: str = "embedding") -> Moments:
    """Exact moments of all vectors of the commonest length (the longest of equally common ones) that have only finite entries.

    Two passes: sums, then squares of values less the whole part of their mean. A task sends 64 numbers a dimension and two dimensions
    at most; one row per sum reaches the driver.
    """
    rows = vectors.select(F.col(vector_col).alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = defaultdict(int)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(0)
            for width in pc.list_value_length(column).unique().to_pylist():
                if width:
                    _, x = whole_numbers(column, width)
                    count[width] += len(x)
                    sums[width] = sums.get(width, 0) + column_sums(x)
        # dimension -1 is the number of vectors
        rows = [(w, i, k, v) for w in sums for i, s in enumerate([count[w], *sums[w]], -1) for k, v in enumerate(limbs_of(int(s)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["width", "dim", "limb", "value"])

    found = materialise(exact_sums(rows.mapInArrow(add, "width int, dim int, limb int, value long"), "width", "dim"))
    size = F.sum(F.expr(f"value * shiftleft(1L, {WORD} * limb)")).alias("rows")
    common = found.filter("dim = -1").groupBy("width").agg(size).filter("rows > 0").orderBy(F.desc("rows"), F.desc("width")).first()
    if common is None:
        return Moments(0, (), ())
    width, n = common["width"], common["rows"]
    by_dim = from_limbs(found.filter(F.col("width") == width).collect(), "dim")
    sums = [by_dim[i] for i in range(width)]
    centre = np.array([s // n for s in sums], np.int64)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * (width + 1) // 2, object)
        for batch in batches:
            _, x = whole_numbers(batch.column(0), width)
            for i in range(0, len(x), ROWS):
                total = total + square_sums(x[i : i + ROWS] - centre)
        rows = [(i, k, v) for i, s in enumerate(total) for k, v in enumerate(limbs_of(int(s)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], ["pair", "limb", "value"])

    squares = from_limbs(exact_sums(rows.mapInArrow(square, "pair int, limb int, value long"), "pair").collect(), "pair")
    off = [s - n * int(c) for s, c in zip(sums, centre)]  # n times what the centre leaves of the mean
    spread = {}
    pair = 0
    for i in range(width):
        for j in range(i, width):
            d = off[i] + off[j] if i != j else off[i]
            spread[i, j] = n * n * squares[pair] - n * d * d
            pair += 1
    products = [[spread[i, i] if i == j else (spread[min(i, j), max(i, j)] - spread[i, i] - spread[j, j]) // 2 for j in range(width)] for i in range(width)]
    return Moments(n, tuple(sums), tuple(map(tuple, products)))


def spectrum(m: Moments, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as columns, eigenvalues falling, and shares of the trace; eigenvalues within rounding of zero are zero."""
    v = m.covariance()
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    values = np.where(values > m.width * np.finfo(float).eps * values[:1].max(initial=0), values, 0.0)
    trace = float(np.trace(v))
    return vectors, values, values / trace if trace > 0 else np.zeros(len(values))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, deviation_exact, whitened, explained, identity_error): a row per vector and component.

    Vectors take part that have the commonest length and only finite entries; null, empty and other vectors give no rows. Entries are whole
    numbers ``floor(1024 * c) + 100000``, cut off at 2^61. ``deviation`` is the sum over dimensions of ``(n * x - S)^2``; ``deviation_exact`` has it
    as decimal(38, 0), and ``deviation`` is null where it passes a long, which vectors of unit length do from some three million
    rows on (``deviation_exact`` likewise beyond 38 digits). A component without variance, as in constant columns or a single vector,
    whitens to 0, explains 0 and is left out of ``identity_error``. Repeated rows count as often as they come, a null id stays null,
    columns other than the two are not read. An empty table gives no rows.
    """
    m = moments(vectors, vector_col)
    n, width = m.n, m.width
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema).withColumn("identity_error", F.lit(0.0)).withColumnRenamed("id", id_col)
    axes, values, explained = spectrum(m, components)
    k = len(values)
    centre = np.array([s // n for s in m.sums], np.int64)
    off = [s - n * int(c) for s, c in zip(m.sums, centre)]
    rest = np.array([o / n for o in off])
    scale = np.divide(1.0, np.sqrt(values), out=np.zeros(k), where=values > 0)

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - rest) @ axes * scale

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))  # products, and sums in the last row
        for batch in batches:
            y = whitened(whole_numbers(batch.column(0), width)[1])
            total += np.vstack((y.T @ y, y.sum(axis=0)))
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    got = rows.select("v").mapInArrow(products, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) * k)
    for r in got:
        total[r["at"]] = r["value"]
    mean = total[k * k :] / n
    error = np.abs(total[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k))
    error = float(error[np.ix_(values > 0, values > 0)].max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squared = sum(o * o for o in off)
        for batch in batches:
            at, x = whole_numbers(batch.column(1), width)
            d = x - centre
            # 64 bits for as long as they hold the sums, plain integers after that
            fits = len(d) and width * (int(np.abs(d).max()) + 1) * max(n, int(np.abs(d).max()) + 1) < 1 << 62
            e = d if fits else d.astype(object)
            square, mixed = (e * e).sum(axis=1).astype(object), (e * np.array(off, e.dtype)).sum(axis=1).astype(object)
            deviation = (n * n * square - 2 * n * mixed + squared).tolist()
            long = pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64())
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)),
                    long.take(each),
                    exact.take(each),
                    pa.array(whitened(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                ],
                ["id", "component", "n", "deviation", "deviation_exact", "whitened", "explained"],
            )

    return rows.mapInArrow(run, schema).withColumn("identity_error", F.lit(error)).withColumnRenamed("id", id_col)
