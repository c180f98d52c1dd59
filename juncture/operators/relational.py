"""The relational steps the assay notebooks repeat between operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import any_of, is_true, percent


def filter_query(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that satisfy a condition; a comparison with a missing value fails."""
    return df.filter(condition)


def rename_select(df: DataFrame, names: dict[str, str], scale: dict[str, float] | None = None, replace: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Project to display names; optionally scale numbers and replace whole text values."""
    out = []
    for old, new in names.items():
        c = F.col(f"`{old}`")
        if scale and old in scale:
            c = c * scale[old]
        for text, other in (replace or {}).get(old, {}).items():
            c = F.when(c == text, F.lit(other)).otherwise(c)
        out.append(c.alias(new))
    return df.select(*out)


def sort_topk(df: DataFrame, order: list[Column], k: int, value: str) -> DataFrame:
    """The first ``k`` rows and their share of the whole column; a report, sorted by a bounded heap per task."""
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.orderBy(*order).limit(k).withColumn("per_total", percent(value, total))


def group_sum_by_flag(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in flags])


def distinct_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first table that the second lacks."""
    return a.subtract(b)


def index_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in the other table."""
    return a.join(b.select(*keys), keys, "left_semi")


def outer_merge_suffix(tables: dict[str, DataFrame], keys: list[str], totals: list[str]) -> DataFrame:
    """Outer merge with a suffix per table, then row-wise totals that skip missing values.

    One union and one aggregate for any number of tables. Missing keys are equal. A table has one row per key; of
    repeated ones the smallest counts, compared column by column.
    """
    values = {name: [c for c in df.columns if c not in keys] for name, df in tables.items()}
    # each table's values travel in a column of their own
    rows = [df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in values[name]], F.lit(1).alias("_")).alias(f"_{i}")) for i, (name, df) in enumerate(tables.items())]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    out = both.groupBy(*keys).agg(*[F.min(f"_{i}").alias(f"_{i}") for i in range(len(rows))])
    out = out.select(*keys, *[F.col(f"_{i}")[c].alias(f"{c}_{name}") for i, name in enumerate(tables) for c in values[name]])
    sums = {c: [F.coalesce(F.col(f"`{c}_{name}`"), F.lit(0)) for name in tables if c in values[name]] for c in totals}
    return out.withColumns({f"total_{c}": reduce(lambda x, y: x + y, cols) for c, cols in sums.items()})


def wide_row_any(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """Any and number of the boolean columns that share a prefix."""
    cols = [F.col(f"`{c}`") for c in df.columns if c.startswith(prefix)]
    return df.withColumns({out: any_of(is_true(c) for c in cols), f"{out}_sum": reduce(lambda x, y: x + y, [is_true(c).cast("int") for c in cols])})


def share_of_total(df: DataFrame, condition: Column, value: str, keys: list[str] | None = None) -> DataFrame:
    """Percent of a column's sum that the matching rows hold."""
    part = F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))
    return df.groupBy(*(keys or [])).agg(part.alias("part"), F.sum(value).alias("total")).withColumn("per", percent("part", "total"))
