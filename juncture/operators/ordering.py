"""Exact ranks and running totals without pulling a table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juncture.functions.columns import attach

BUCKETS = 256


def place_among(df: DataFrame, cuts: DataFrame, value: Column, out: str, step: int) -> DataFrame:
    """How many of the sorted cuts, an array in one row, are at most ``value``.

    A row looks at every ``step``-th cut and then at the ``step`` after it.
    """
    cuts = cuts.select("_cuts", F.filter("_cuts", lambda x, i: i % step == step - 1).alias("_coarse"))
    low = F.size(F.filter("_coarse", lambda x: x <= value)) * step
    fine = F.filter(F.slice("_cuts", low + 1, F.lit(step)), lambda x: x <= value)
    return attach(df, cuts).withColumn(out, low + F.size(fine)).drop("_cuts", "_coarse")


def number_rows(df: DataFrame, order: list[Column], out: str = "n", cuts: int = 1024) -> DataFrame:
    """Number all rows from 1 in the given order: ascending, nulls first; give a number's negative for falling order.

    Everything is part of the plan. Rows fall into ranges between the keys of at most ``cuts`` rows, one drawn by hash from
    each group of hashes; a row's number is the count of the ranges before its own and its place inside. Keys are expected to
    be all but unique, as equal ones share a range.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    draw = F.xxhash64(*order)
    drawn = df.groupBy(F.pmod(draw, F.lit(cuts)).alias("_g")).agg(F.min_by(key, F.xxhash64(F.lit("cut"), draw)).alias("_k"))
    placed = place_among(df.withColumn("_key", key), drawn.agg(F.array_sort(F.collect_list("_k")).alias("_cuts")), F.col("_key"), "_range", 32)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # one row per range: a small table whatever the size of the data
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    numbered = placed.join(sizes.select("_range", before.alias("_before")), "_range")
    return numbered.withColumn(out, F.col("_before") + inside).drop("_range", "_before", "_key")


def with_bucket(df: DataFrame, value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Number of the value's range; ranges have about equal numbers of rows.

    The cut values, at most ``buckets`` numbers, are an aggregate inside the plan, so nothing runs before the
    result is asked for. A row looks at every sixteenth cut and then at the sixteen after it.
    """
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), shares, F.lit(4 * buckets)))).alias("_cuts"))
    cuts = cuts.select(F.coalesce("_cuts", F.array().cast("array<double>")).alias("_cuts"))
    return place_among(df, cuts, F.col(value), out, 16)


def exact_quantiles(
    df: DataFrame, keys: list[str], values: dict[str, Column], q: float = 0.5, buckets: int = BUCKETS, span: tuple[float, float] | None = None
) -> DataFrame:
    """One row per key with the exact quantile of each value, between two ranks in proportion; nulls do not count.

    Selection by refinement: equal values are counted first, the counts are added up by key and bucket of values, and only the
    one or two buckets that hold the wanted ranks are looked into. So no buffer holds a group's values, and a
    key with a third of all rows is spread over the buckets. These have about equal numbers of rows, or equal widths of ``span``, which
    spares a pass where the values are shares. Keys without a value give no row, keys are not null.
    """
    group = [*keys, "_name"]
    cells = F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()])
    rows = df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*").filter(F.col("_v").isNotNull())
    hist = rows.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if span is None:
        hist = with_bucket(hist, "_v", "_b", buckets)
    else:
        hist = hist.withColumn("_b", F.floor((F.col("_v") - span[0]) * (buckets / (span[1] - span[0]))))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per key and bucket
    totals = hist.groupBy(*group, "_b").agg(F.sum("_n").alias("_in"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0))).withColumn("_at", (F.sum("_in").over(whole) - 1) * F.lit(q))
    wanted = totals.filter((F.col("_before") <= F.ceil("_at")) & (F.col("_before") + F.col("_in") > F.floor("_at"))).drop("_in")
    along = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = hist.join(wanted, [*group, "_b"]).withColumn("_to", F.first("_before").over(along) + F.sum("_n").over(along))
    out = []
    for n in values:
        own = F.col("_name") == n
        low = F.min(F.when(own & (F.col("_to") > F.floor("_at")), F.col("_v")))
        high = F.min(F.when(own & (F.col("_to") > F.ceil("_at")), F.col("_v")))
        share = F.max(F.when(own, F.col("_at") - F.floor("_at")))
        out.append((low * (1 - share) + high * share).alias(n))
    return found.groupBy(*keys).agg(*out)


def beside(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Add columns of a table with one row per key; without keys, of its only row."""
    return df.join(more, keys, "left") if keys else attach(df, more)


def with_running(
    hist: DataFrame,
    value: str,
    sums: dict[str, str],
    keys: list[str] | None = None,
    descending: bool = True,
    below: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Running totals over the distinct values of ``value`` within ``keys``.

    ``hist`` has one row per (keys, value).  Values are cut into buckets at split points;
    the totals of the buckets form a small table, and the exact running total inside a bucket
    starts from the total of the buckets before it.  ``below`` names a column for the next lower
    distinct value.
    """
    keys = keys or []
    bucketed = with_bucket(hist, value, "_b", buckets)

    def order(c: str) -> Column:
        return F.desc(c) if descending else F.asc(c)

    totals = bucketed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums], F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    lower = F.lag("_top").over(Window.partitionBy(*keys).orderBy("_b")).alias("_lower")
    totals = totals.select(*keys, "_b", lower, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the window below wants this shuffle anyway; a histogram read from small files would be broadcast whole
    out = bucketed.join(totals.hint("merge"), [*keys, "_b"])
    out = out.withColumns({name: F.sum(c).over(inside) + F.col(f"_o_{c}") for c, name in sums.items()})
    if below:
        up = Window.partitionBy(*keys, "_b").orderBy(value)
        out = out.withColumn(below, F.coalesce(F.lag(value).over(up), F.col("_lower")))
    return out.drop("_b", "_lower", *[f"_o_{c}" for c in sums])
