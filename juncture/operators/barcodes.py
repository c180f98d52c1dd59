"""From barcode counts to per-variant isoform usage, and across replicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import KEY, count_if, percent, ratio
from juncture.functions.variants import is_snv, variant_fields
from juncture.operators.ordering import beside, exact_quantiles

QC_COLUMNS = {
    "unpaired": "unpaired_reads",
    "secondary": "secondary_reads",
    "unmapped": "unmapped_reads",
    "bad_starts": "bad_starts",
    "bad_ends": "bad_ends",
    "soft_clipped": "soft_clipped",
}


def subassembly_columns(sa: DataFrame) -> DataFrame:
    """Drop the assembly-quality columns that no later step reads."""
    drop = [c for c in sa.columns if c in ("ref_target_length", "minbq") or c.startswith("nbp_")]
    return sa.drop(*drop)


def join_subassembly_rna(sa: DataFrame, rna: DataFrame, key: str = "barcode") -> DataFrame:
    """Barcodes present in both tables; clashing column names get ``_subasm`` and ``_rna``."""
    sa = subassembly_columns(sa)
    clash = (set(sa.columns) & set(rna.columns)) - {key}
    left = sa.withColumnsRenamed({c: f"{c}_subasm" for c in clash})
    right = rna.withColumnsRenamed({c: f"{c}_rna" for c in clash})
    return left.join(right, key)


def barcode_length_filter(df: DataFrame, max_len: int = 35, col: str = "barcode") -> DataFrame:
    return df.filter(F.length(col) <= max_len)


def subassembly_snvs(sa: DataFrame) -> DataFrame:
    """Single-variant barcodes whose variant is a single-base change."""
    one = sa.filter(F.col("n_variants_passing") == 1)
    return one.withColumns(variant_fields("variant_list")).filter(is_snv())


def snv_only(tbv: DataFrame) -> DataFrame:
    return tbv.filter(is_snv())


def psi(df: DataFrame, isos: list[str], denom: str = "usable_reads") -> DataFrame:
    """Percent spliced in: isoform reads over usable reads."""
    return df.withColumns({f"{i}_psi": ratio(i, denom) for i in isos})


def _usage_aggregates(isos: list[str], passes: Column) -> list[Column]:
    usable = F.when(passes, F.col("usable_reads"))
    out = []
    for iso in isos:
        value = F.when(passes, ratio(iso, "usable_reads"))
        out += [
            F.avg(value).alias(f"mean_{iso}"),
            ratio(F.sum(value * usable), F.sum(usable)).alias(f"wmean_{iso}"),
        ]
    return out


def _summary(df: DataFrame, keys: list[str], min_usable: int | Column, sums: dict[str, str], isos: list[str], extra=()) -> DataFrame:
    passes = F.col("usable_reads") > min_usable
    zero = F.lit(0).cast("long")
    aggs = [
        F.count(F.lit(1)).alias("n_bc"),
        count_if(passes).alias("n_bc_passfilt"),
        F.sum("num_reads").alias("sum_reads"),
        F.coalesce(F.sum(F.when(passes, F.col("num_reads"))), zero).alias("sum_reads_passfilt"),
        *[F.coalesce(F.sum(F.when(passes, F.col(c))), zero).alias(f"sum_{n}") for c, n in sums.items()],
        *_usage_aggregates(isos, passes),
        *extra,
    ]
    medians = {f"median_{iso}": F.when(passes, ratio(iso, "usable_reads")) for iso in isos}
    return beside(df.groupBy(*keys).agg(*aggs), exact_quantiles(df, keys, medians, span=(0.0, 1.0)), keys)


def _with_percents(df: DataFrame, over_passing: dict[str, str]) -> DataFrame:
    return df.withColumns(
        {
            "per_bc_passfilt": percent("n_bc_passfilt", "n_bc"),
            "per_reads_passfilt": percent("sum_reads_passfilt", "sum_reads"),
            **{f"per_{n}": percent(f"sum_{c}", "sum_reads_passfilt") for c, n in over_passing.items()},
        }
    )


# summed column of the barcode table -> its name after "sum_", and the name after "per_"
SUMMARY_SUMS = {
    "usable_reads": "usable_reads",
    "unmapped_reads": "unmapped_reads",
    "bad_starts": "badstart_reads",
    "bad_ends": "badend_reads",
    "soft_clipped": "softclipped_reads",
    "other_isoform": "otheriso",
}
SUMMARY_PERCENTS = {
    "usable_reads": "reads_usable",
    "unmapped_reads": "unmapped",
    "badend_reads": "badend",
    "badstart_reads": "badstart",
    "softclipped_reads": "softclipped",
    "otheriso": "otheriso",
}


def _single_variant_rows(sa: DataFrame, rna: DataFrame, group: list[str]) -> DataFrame:
    one = sa.filter(F.col("n_variants_passing") == 1).select("barcode", F.col("variant_list").alias("varlist"))
    return rna.join(one, "barcode")


def variant_summary(sa: DataFrame, rna: DataFrame, min_usable: int | Column, isos: list[str], group: list[str] | None = None) -> DataFrame:
    """Isoform usage per variant over barcodes that carry exactly that variant.

    ``group`` adds keys such as the sample, so all samples run in one plan.
    """
    group = group or []
    rows = _single_variant_rows(sa, rna, group)
    out = _summary(rows, [*group, "varlist"], min_usable, SUMMARY_SUMS, isos)
    out = out.withColumns(variant_fields("varlist"))
    return _with_percents(subassembly_barcode_count(out, sa), SUMMARY_PERCENTS)


def variant_summary_pe(
    sa: DataFrame, rna: DataFrame, min_usable: int | Column, cols: list[str], isos: list[str], group: list[str] | None = None
) -> DataFrame:
    """As :func:`variant_summary`, with the summed columns chosen by the caller."""
    group = group or []
    rows = _single_variant_rows(sa, rna, group)
    out = _summary(rows, [*group, "varlist"], min_usable, {c: c for c in cols}, isos)
    out = out.withColumns(variant_fields("varlist"))
    return _with_percents(subassembly_barcode_count(out, sa), {c: c for c in cols})


def subassembly_barcode_count(tbv: DataFrame, sa: DataFrame) -> DataFrame:
    """Add ``n_bc_sa``: single-variant barcodes of the subassembly per variant."""
    counts = (
        sa.filter(F.col("n_variants_passing") == 1)
        .groupBy(F.col("variant_list").alias("varlist"))
        .agg(F.count(F.lit(1)).alias("n_bc_sa"))
    )
    return tbv.join(counts, "varlist")


def wildtype_summary(rna: DataFrame, min_usable: int | Column, isos: list[str], chrom: str, group: list[str] | None = None) -> DataFrame:
    """One wild-type row with spread.

    The weighted spread expands to sums, so one pass is enough:
    sum(u (p-m)^2) = sum(u p^2) - sum(u p)^2 / sum(u).
    """
    passes = F.col("usable_reads") > min_usable
    u = F.when(passes, F.col("usable_reads").cast("double"))
    extra = []
    for iso in isos:
        p = F.when(passes, ratio(iso, "usable_reads"))
        spread = F.sum(u * p * p) - ratio(F.sum(u * p) * F.sum(u * p), F.sum(u))
        extra += [
            F.stddev_samp(p).alias(f"stdev_{iso}"),
            F.sqrt(ratio(F.greatest(spread, F.lit(0.0)), F.sum(u) - 1)).alias(f"wstdev_{iso}"),
        ]
    out = _summary(rna, group or [], min_usable, SUMMARY_SUMS, isos, extra)
    out = out.withColumns({"chrom": F.lit(chrom), "varlist": F.lit("WT")})
    return _with_percents(out, SUMMARY_PERCENTS)


def variant_barcodes(sa: DataFrame) -> DataFrame:
    """Barcodes of every single-base variant, one row per pair.

    Kept long on purpose: a variant may own a third of all barcodes, and a list of them
    would have to fit in one row.
    """
    return subassembly_snvs(sa).select("variant_list", *KEY, "barcode")


def barcodes_by_status(sa: DataFrame, status: str) -> DataFrame:
    return sa.filter(F.col("status") == status).select("status", "barcode").distinct()


def barcode_isoform_counts(
    pairs: DataFrame,
    catalog: DataFrame,
    names: list[str],
    keys: list[str] | None = None,
    other_usable: bool = False,
    min_reads: int = 1,
) -> DataFrame:
    """Per-barcode read counts by quality class and by known isoform.

    ``pairs`` has the keys, ``status`` (null when usable) and ``isoform``; ``catalog`` maps
    ``isoform`` to ``name``.  Reads are counted per (keys, status, isoform) before the catalog
    join, so a barcode or an isoform with many reads costs few rows there.  Secondary pairs are
    counted and subtracted from the usable reads, but are not part of ``num_reads``.
    """
    keys = keys or ["barcode"]
    counted = pairs.groupBy(*keys, "status", "isoform").agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(catalog.select("isoform", "name"), "isoform", "left")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))

    free = F.col("status").isNull()
    out = named.groupBy(*keys).agg(
        F.sum("n").alias("_records"),
        total(~F.col("status").eqNullSafe("secondary")).alias("num_reads"),
        *[total(F.col("status") == s).alias(c) for s, c in QC_COLUMNS.items()],
        total(free & F.col("name").isNull()).alias("other_isoform"),
        *[total(free & (F.col("name") == n)).alias(n) for n in names],
    )
    lost = list(QC_COLUMNS.values()) + ([] if other_usable else ["other_isoform"])
    usable = F.col("num_reads") - reduce(lambda a, b: a + b, [F.col(c) for c in lost])
    return out.filter(F.col("_records") >= min_reads).withColumn("usable_reads", usable).drop("_records")


def combine_isoform_groups(
    long_counts: DataFrame, totals: DataFrame, mapping: DataFrame, keys: list[str] | None = None, tasks: int | None = None
) -> DataFrame:
    """Sum isoform counts into named groups and express them as shares of the usable reads.

    Long in, long out: ``long_counts`` (keys, isoform, n), ``mapping`` (isoform, group),
    ``totals`` (keys, usable_reads).  Every barcode gets every group, zero when absent. The keys are shared by ``tasks`` tasks, or as
    many as Spark chooses.
    """
    keys = keys or ["barcode"]
    groups = mapping.select("group").distinct()
    named = long_counts.join(mapping, "isoform").filter(F.col("group").isNotNull())
    named = named.repartition(tasks, *keys) if tasks else named.repartition(*keys)
    grouped = named.groupBy(*keys, "group").agg(F.sum("n").alias("n"))
    # the handful of groups of a key travels as one small map, so rows meet by key before they multiply
    sums = grouped.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("group", "n"))).alias("_sums"))
    every = groups.agg(F.array_sort(F.collect_set("group")).alias("_groups"))
    out = totals.select(*keys, "usable_reads").join(sums, keys, "left").withColumn("group", F.explode(every.scalar()))
    n = F.coalesce(F.try_element_at("_sums", F.col("group")), F.lit(0))
    return out.select(*keys, "group", "usable_reads", n.alias("n"), F.coalesce(ratio(n, "usable_reads"), F.lit(0.0)).alias("psi"))


def combine_isoform_groups_wide(counts: DataFrame, groups: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """The same for a wide table with a fixed set of isoform columns."""
    sums = {g: reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols]) for g, cols in groups.items()}
    out = counts.select(*keep, *[v.alias(g) for g, v in sums.items()])
    return out.withColumns({f"{g}_psi": F.coalesce(ratio(g, "usable_reads"), F.lit(0.0)) for g in groups})


def add_unmapped_barcodes(bc: DataFrame, names: DataFrame, col: str = "name", mark: str = "_BC=") -> DataFrame:
    """Replace the unmapped count by one taken from read names and add it to the total."""
    found = (
        names.select(F.element_at(F.split(F.col(col), mark), -1).alias("barcode"))
        .groupBy("barcode")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    n = F.coalesce("_n", F.lit(0))
    out = bc.drop("unmapped_reads").join(found, "barcode", "left")
    return out.withColumns({"unmapped_reads": n, "num_reads": F.col("num_reads") + n}).drop("_n")


def replicates_wide(long: DataFrame, keys: list[str], cols: list[str], samples: list[str], by_column: bool = False) -> DataFrame:
    """One row per key with a ``{sample}_{col}`` column per sample; absent cells are null."""
    out = long.groupBy(*keys).pivot("sample", samples).agg(*[F.first(c, True).alias(c) for c in cols])
    if len(cols) == 1:
        out = out.withColumnsRenamed({s: f"{s}_{cols[0]}" for s in samples})
    order = [f"{s}_{c}" for c in cols for s in samples] if by_column else [f"{s}_{c}" for s in samples for c in cols]
    return out.select(*keys, *order)


def replicates_long(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack per-sample tables with equal columns, naming each one in ``sample``."""
    first = next(iter(tables.values())).columns
    parts = []
    for name, df in tables.items():
        if set(df.columns) != set(first):
            raise ValueError(f"columns of {name} differ")
        parts.append(df.withColumn("sample_grp" if "sample" in first else "sample", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def replicates_long_ragged(tables: dict[str, DataFrame], fill: float | None = None) -> DataFrame:
    """As :func:`replicates_long` for tables whose columns differ."""
    parts = [df.withColumn("sample_grp" if "sample" in df.columns else "sample", F.lit(n)) for n, df in tables.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out if fill is None else out.fillna(fill)


def across_sample_columns(long: DataFrame, keys: list[str], medians=(), means=(), sums=(), maxes=()) -> DataFrame:
    """Summaries of each key over its samples."""
    return long.groupBy(*keys).agg(
        *[F.percentile(c, F.lit(0.5)).alias(f"{c}_med") for c in medians],
        *[F.avg(c).alias(f"{c}_mean") for c in means],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum") for c in sums],
        *[F.max(c).alias(f"{c}_max") for c in maxes],
    )


def barcode_weighted_psi(long: DataFrame, keys: list[str], isos: list[str], count: str = "n_bc_passfilt") -> DataFrame:
    """Mean over samples, and mean weighted by barcodes (the weights count samples without a value)."""
    aggs = []
    for iso in isos:
        value = F.col(f"wmean_{iso}")
        aggs += [
            F.avg(value).alias(f"mean_{iso}"),
            ratio(F.coalesce(F.sum(value * F.col(count)), F.lit(0.0)), F.sum(count)).alias(f"wmean_{iso}"),
        ]
    return long.groupBy(*keys).agg(*aggs)


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`").cast("double").alias(c) for c in cols], name, value)


def sparse_long(wide: DataFrame, keys: list[str], cols: list[str], fill: float | None = None) -> DataFrame:
    """Only the cells that differ from the fill value."""
    long = unpivot(wide, keys, cols)
    return long.filter(F.col("value").isNotNull() if fill is None else ~F.col("value").eqNullSafe(F.lit(float(fill))))


def nonzero_isoforms(wide: DataFrame, cols: list[str], catalog: DataFrame) -> DataFrame:
    """Columns whose largest value is above zero, with the text of their isoform."""
    top = isoform_column_stats(wide, cols, catalog, "max")
    return top.filter(F.col("value") > 0)


def isoform_column_stats(wide: DataFrame, cols: list[str], catalog: DataFrame, stat: str) -> DataFrame:
    """Largest, smallest or mean value of each isoform column, with the isoform text."""
    fn = {"max": F.max, "min": F.min, "mean": F.avg}[stat]
    one = wide.agg(*[fn(F.col(f"`{c}`").cast("double")).alias(c) for c in cols])
    long = one.unpivot([], cols, "column", "value")
    iso = F.regexp_replace("column", "_psi$", "")
    return long.withColumn("isonum", iso).join(catalog.select("isonum", "isoform"), "isonum", "left")


def low_barcode_samples(tbv: DataFrame, threshold: float = 50, col: str = "n_bc_passfilt") -> DataFrame:
    """Drop the samples whose median barcode count is not above the threshold."""
    low = exact_quantiles(tbv, ["sample"], {"m": F.col(col)}).filter(F.col("m") <= threshold)
    return tbv.join(low.select("sample"), "sample", "left_anti")


def read_cutoff_filter(bc: DataFrame, cutoffs: DataFrame, col: str = "usable_reads") -> DataFrame:
    """Keep barcodes with more reads than the cutoff of their sample."""
    return bc.join(cutoffs.select("sample", "cutoff"), "sample").filter(F.col(col) > F.col("cutoff")).drop("cutoff")
