"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["chrom", "pos", "ref", "alt"]


def as_col(c: Column | str) -> Column:
    """Accept a column or its name."""
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """Double division; null where the denominator is zero or null."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def percent(num: Column | str, den: Column | str) -> Column:
    return ratio(num, den) * 100.0


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def any_of(cols: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out


def is_true(cond: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(cond, F.lit(False))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row through a scalar subquery."""
    row = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns])).scalar()
    return df.withColumn("_row", row).select(*[F.col(f"`{c}`") for c in df.columns], "_row.*")


def position_bin(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("long")
