"""Null distributions, scores, calls and per-sample statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juncture.functions.columns import any_of, attach, count_if, is_true, percent, ratio
from juncture.operators.ordering import beside, exact_quantiles, number_rows, with_running
from juncture.sources.sinks import explode_range, write_once


def zscore_by_sample(tbv: DataFrame, cols: list[str], by: str | None = "sample") -> DataFrame:
    """Standard score with the population spread, missing values skipped.

    The moments come from one aggregation and join back; a window would sort every sample whole.
    """
    aggs = [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    df = tbv.join(tbv.groupBy(by).agg(*aggs), by) if by else attach(tbv, tbv.agg(*aggs))
    df = df.withColumns({f"z{c}": ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols})
    return df.drop(*[f"_{n}_{c}" for c in cols for n in "ms"])


# ---- bootstrap --------------------------------------------------------------------------------

Draw = Callable[[Column, Column, Column, Column], Column]


def hashed_draw(seed: int = 1687) -> Draw:
    """Uniform index from a hash of (seed, size, bootstrap, draw): the same on every retry."""
    return lambda n, b, d, m: F.pmod(F.xxhash64(F.lit(seed), n, b, d), m.cast("long"))


def arithmetic_draw(n: Column, b: Column, d: Column, m: Column) -> Column:
    """A congruential index that any SQL engine computes alike."""
    n, b, d = n.cast("long"), b.cast("long"), d.cast("long")
    return ((n * 1000003 + b * 7919 + d * 104729) * 48271) % F.lit(2147483647).cast("long") % m.cast("long")


def index_rows(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Number rows from 0 within ``by``, in the order of a digest of the key.

    The first two digits of the digest cut each group into 256 even parts, so a group of any size
    is numbered by many tasks.
    """
    h = df.withColumn("_h", F.md5(key)).withColumn("_p", F.substr("_h", F.lit(1), F.lit(2)))
    sizes = h.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*by, "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key))
    out = h.withColumn("_i", inside).join(offsets, [*by, "_p"])
    return out.withColumn("idx", F.col("_before") + F.col("_i") - 1).drop("_h", "_p", "_i", "_before")


def _drawn_means(grid: DataFrame, null: DataFrame, isos: list[str], draw: Draw, by: list[str]) -> DataFrame:
    """Usable-weighted mean usage of ``n`` drawn barcodes for each (n, b) of the grid."""
    size = null.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    draws = explode_range(grid.withColumns({"_lo": F.lit(0), "_hi": (F.col("n") - 1).cast("int")}), "_lo", "_hi", "d").drop("_lo", "_hi")
    draws = draws.join(size, by) if by else attach(draws, size)
    draws = draws.withColumn("idx", draw(F.col("n"), F.col("b"), F.col("d"), F.col("m")))
    rows = draws.join(index_rows(null, "barcode", by), [*by, "idx"])
    sums = [F.sum(F.col("usable_reads") * F.col(f"{i}_psi")).alias(f"_s_{i}") for i in isos]
    means = rows.groupBy(*by, "n", "b").agg(F.sum("usable_reads").alias("_u"), *sums)
    return means.select(*by, "n", "b", *[ratio(f"_s_{i}", "_u").alias(i) for i in isos])


def bootstrap_null(n_bcs: DataFrame, wt: DataFrame, tbv: DataFrame, isos: list[str], draw: Draw | None = None, by: list[str] | None = None) -> DataFrame:
    """One draw per entry of ``n_bcs`` (b, n); mean and spread over the entries go to every variant.

    ``by`` names columns, such as the sample, within which entries draw from the wild type and go to the variants.
    """
    by = by or []
    means = _drawn_means(n_bcs, wt, isos, draw or hashed_draw(), by)
    one = means.groupBy(*by).agg(*[f(i).alias(f"{n}_bs_WT_{i}") for i in isos for n, f in (("wmean", F.avg), ("wstdev", F.stddev_pop))])
    return beside(tbv, one, by)


def bootstrap_null_by_count(
    null: DataFrame, tbv: DataFrame, isos: list[str], bootstraps: int = 1000, draw: Draw | None = None, by: str = "sample"
) -> DataFrame:
    """Null mean and spread of each variant at its own number of barcodes.

    Each bootstrap of a sample is one sequence of draws, as long as the sample's largest count, and its running sums give the mean of
    every smaller count.  One result per distinct (sample, count) and a join back. Both tables are read several times, so they are
    written once.
    """
    draw = draw or hashed_draw()
    null = write_once(null.select(by, "barcode", "usable_reads", *[f"{i}_psi" for i in isos]), "null")
    tbv = write_once(tbv, "variants")
    counts = tbv.filter(F.col("n_bc_passfilt") > 0).select(by, F.col("n_bc_passfilt").alias("n")).distinct()
    size = null.groupBy(by).agg(F.count(F.lit(1)).alias("m"))
    longest = counts.groupBy(by).agg((F.max("n") - 1).cast("int").alias("_last")).join(size, by)
    grid = explode_range(longest.withColumns({"_lo": F.lit(0), "_hi": F.lit(bootstraps - 1)}), "_lo", "_hi", "b")
    draws = explode_range(grid.select(by, "m", "b", F.lit(0).alias("_lo"), F.col("_last").alias("_hi")), "_lo", "_hi", "d")
    draws = draws.select(by, "b", "d", draw(F.lit(0), F.col("b"), F.col("d"), F.col("m")).alias("idx"))
    cells = [F.col("usable_reads").alias("_u"), *[(F.col("usable_reads") * F.col(f"{i}_psi")).alias(f"_s_{i}") for i in isos]]
    rows = draws.join(index_rows(null, "barcode", [by]).select(by, "idx", *cells), [by, "idx"])
    so_far = Window.partitionBy(by, "b").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means = rows.select(by, "b", (F.col("d") + 1).alias("n"), *[ratio(F.sum(f"_s_{i}").over(so_far), F.sum("_u").over(so_far)).alias(i) for i in isos])
    stats = means.join(counts, [by, "n"]).groupBy(by, "n").agg(
        *[f(i).alias(f"{n}_bs_null_{i}") for i in isos for n, f in (("wmean", F.avg), ("wstdev", F.stddev_pop))]
    )
    return tbv.join(stats.withColumnRenamed("n", "n_bc_passfilt"), [by, "n_bc_passfilt"], "left")


def intron_null(tbv: DataFrame, exon: tuple[int, int], margin: int, isos: list[str], pos: str = "pos") -> DataFrame:
    """Mean and spread of usage away from the exon, and the inverse pooled effect.

    The comparison set is every row with a position: its two conditions are joined by OR.
    """
    p = F.col(pos)
    far = (p < exon[0] - margin) | (p > exon[1] + margin)
    ni, ne = count_if(far).cast("double"), F.count(p).cast("double")
    aggs = []
    for iso in isos:
        w = F.col(f"wmean_{iso}")
        inner = F.when(far, w)
        spread = (ni - 1) * F.pow(F.stddev_samp(inner), 2) + (ne - 1) * F.pow(F.stddev_samp(w), 2)
        aggs += [
            F.avg(inner).alias(f"wmean_int_{iso}"),
            F.stddev_samp(inner).alias(f"wstdev_int_{iso}"),
            ratio(ni * ne * (ni + ne - 2), (ni + ne) * spread).alias(f"sq_inv_eff_{iso}"),
        ]
    return attach(tbv, tbv.agg(*aggs))


def null_zscore(tbv: DataFrame, stem: str, isos: list[str]) -> DataFrame:
    return tbv.withColumns(
        {f"zwmean_{stem}_{i}": ratio(F.col(f"wmean_{i}") - F.col(f"wmean_{stem}_{i}"), F.col(f"wstdev_{stem}_{i}")) for i in isos}
    )


def stouffer_z(long: DataFrame, keys: list[str], zcols: list[str], weights: DataFrame | None = None, by: str = "sample") -> DataFrame:
    """Combine scores over samples: by the number of scores, or by weights.

    ``weights`` has one ``weight`` per sample; the squares of all of them scale the sum, also those of samples in which a key is
    missing.
    """
    if weights is None:
        aggs = [ratio(F.coalesce(F.sum(z), F.lit(0.0)), F.sqrt(F.count(z).cast("double"))).alias(z) for z in zcols]
        return long.groupBy(*keys).agg(*aggs)
    scale = weights.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight")).cast("double")).alias("_scale"))
    sums = long.join(weights.select(by, "weight"), by).groupBy(*keys).agg(*[F.coalesce(F.sum(F.col(z) * F.col("weight")), F.lit(0.0)).alias(z) for z in zcols])
    return attach(sums, scale).withColumns({z: ratio(z, "_scale") for z in zcols}).drop("_scale")


def fold_change(tbv: DataFrame, null_stem: str, test_stem: str, isos: list[str], out: str = "fc_") -> DataFrame:
    return tbv.withColumns({f"{out}{i}": ratio(f"{test_stem}{i}", f"{null_stem}{i}") for i in isos})


def sdv_by_isoform(
    tbv: DataFrame,
    isos: list[str],
    z_stem: str,
    z_min: float,
    fc_stem: str,
    fc_min: float,
    change: tuple[str, str, float] | None = None,
    out: str = "sdv_",
    both_ways: bool = True,
) -> DataFrame:
    """Score and fold change beyond their thresholds, and optionally the absolute change.

    ``change`` is (null stem, measured stem, smallest change).
    """
    cols = {}
    for i in isos:
        z, fc = F.col(f"{z_stem}{i}"), F.col(f"{fc_stem}{i}")
        z = F.abs(z) if both_ways else z
        test = is_true(z >= z_min) & (is_true(fc >= fc_min) | (is_true(fc <= 1 / fc_min) if both_ways else F.lit(False)))
        if change:
            d = F.col(f"{change[1]}{i}") - F.col(f"{change[0]}{i}")
            test &= is_true((F.abs(d) if both_ways else d) >= change[2])
        cols[f"{out}{i}"] = test
    return tbv.withColumns(cols)


def upper_normal_quantile(alpha: Column | str) -> Column:
    """Standard normal value exceeded with probability alpha; meant for a one-row table."""

    def quantile(a: pd.Series) -> pd.Series:
        return a.map(lambda x: -NormalDist().inv_cdf(x) if x and 0 < x < 1 else None)

    return F.pandas_udf(quantile, "double")(alpha)


def bonferroni_calls(
    tbv: DataFrame,
    diff_isos: list[str],
    ratios: list[str] = (),
    z_stem: str = "zwmean_bs_null_",
    diff_stem: str = "wmean_diff_",
    level: float = 0.05,
) -> DataFrame:
    """Disrupting and intermediate flags at a threshold corrected for the largest sample.

    Usage changes need a rise of 0.2 (0.1 intermediate); log ratios must leave [-1, 1.5]
    ([-0.5, 1] intermediate).
    """
    # the scores are joins and draws: they are written once, the largest sample is counted on the same rows
    tbv = write_once(tbv, "scored")
    largest = tbv.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).agg((F.lit(level) / F.max("n")).alias("alpha"))
    df = attach(tbv, largest.withColumn("z_cut", upper_normal_quantile("alpha")))
    flags = {}
    for name, rise, low, high in (("sdv", 0.2, -1.0, 1.5), ("intmed", 0.1, -0.5, 1.0)):
        for i in diff_isos:
            flags[f"{name}_{i}"] = is_true(F.col(f"{z_stem}{i}") >= F.col("z_cut")) & is_true(F.col(f"{diff_stem}{i}") >= rise)
        for i in ratios:
            out = is_true(F.col(f"wmean_{i}") >= high) | is_true(F.col(f"wmean_{i}") <= low)
            flags[f"{name}_{i}"] = is_true(F.abs(f"{z_stem}{i}") >= F.col("z_cut")) & out
    df = df.withColumns(flags)
    every = [*diff_isos, *ratios]
    df = df.withColumns({n: any_of(F.col(f"{n}_{i}") for i in every) for n in ("sdv", "intmed")})
    return df.withColumn("intmed", F.col("intmed") & ~F.col("sdv"))


def calls_over_samples(calls: DataFrame, keys: list[str]) -> DataFrame:
    """In how many samples each variant is disrupting or intermediate."""
    return calls.groupBy(*keys).agg(count_if(F.col("sdv")).alias("sdv_sum"), count_if(F.col("intmed")).alias("intmed_sum"))


def rank_cutoff(bc: DataFrame, col: str, percents: list[float], by: list[str] | None = None) -> DataFrame:
    """Reads and log rank of the first barcode at which the cumulative share reaches each percent.

    Works on the histogram of read counts; inside a tie the rank follows in closed form.
    """
    by = by or []
    hist = bc.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    hist = hist.withColumn("s", F.col("n") * F.col("v"))
    run = with_running(hist, "v", {"n": "cn", "s": "cs"}, by)
    total = hist.groupBy(*by).agg(F.sum("s").alias("total"))
    run = run.join(total, by) if by else attach(run, total)
    run = run.select("*", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percentile"))
    goal = F.col("percentile") * F.col("total") / 100.0
    before = F.col("cs") - F.col("s")
    place = F.greatest(F.ceil(ratio(goal - before, "v")), F.lit(1))
    rank = F.col("cn") - F.col("n") + place
    hit = run.filter(F.col("cs") * 100.0 / F.col("total") >= F.col("percentile"))
    first = F.max(F.struct(F.col("v"), rank.alias("rank")))
    out = hit.groupBy(*by, "percentile").agg(first.alias("f"))
    return out.select(*by, "percentile", F.log10(F.col("f.rank").cast("double")).alias("x"), F.col("f.v").alias("y"))


def cutoff_table(cuts: DataFrame, percents: list[int]) -> DataFrame:
    """Cutoffs of each sample as columns: rank, reads and log rank per threshold."""
    aggs = []
    for p in percents:
        here = F.col("percentile") == float(p)
        x = F.max(F.when(here, F.pow(F.lit(10.0), F.col("x"))))
        aggs += [x.alias(f"{p}_x"), F.max(F.when(here, F.col("y"))).alias(f"{p}_y"), F.log10(x).alias(f"{p}_x_log10")]
    return cuts.groupBy("sample").agg(*aggs)


# summed column -> name in the statistics, and the percentages over passing reads
SAMPLE_SUMS = {
    "sum_usable_reads": "n_usable_reads",
    "sum_unmapped_reads": "n_unmapped",
    "sum_bad_starts": "n_badstart",
    "sum_bad_ends": "n_badend",
    "sum_soft_clipped": "n_softclip",
    "sum_other_isoform": "n_otheriso",
}


def sample_statistics(long: DataFrame, medians: list[str]) -> DataFrame:
    """One row per sample: variants seen and possible, sums, disrupting variants and percentages.

    The counts of new splice sites stay empty, as they do in the table this reproduces.
    """
    seen = F.col("n_bc_passfilt") > 0
    has = set(long.columns)
    none = F.lit(None).cast("long")
    intronic = F.col("var_type") == "Intronic"
    aggs = {
        "psbl_var": (F.max("pos") - F.min("pos")) * 3,
        "n_var": count_if(seen),
        "n_reads": F.sum("sum_reads"),
        "n_reads_passfilt": F.sum("sum_reads_passfilt"),
        **{n: F.sum(c) for c, n in SAMPLE_SUMS.items()},
        "n_bc": F.sum("n_bc"),
        "n_bc_passfilt": F.sum("n_bc_passfilt"),
        "n_sdv": count_if(seen & F.col("sdv")) if "sdv" in has else F.max(none),
    }
    typed = "var_type" in has
    aggs |= {
        "n_var_ex": count_if(seen & ~intronic) if typed else F.max(none),
        "n_var_in": count_if(seen & intronic) if typed else F.max(none),
        "n_sdv_ex": count_if(seen & F.col("sdv_exon")) if typed else F.max(none),
        "n_sdv_in": count_if(seen & F.col("sdv_intron")) if typed else F.max(none),
    }
    aggs |= {n: F.max(none) for n in ("psbl_alt_acc", "psbl_alt_don", "n_alt_acc", "n_alt_don")}
    keys = [c for c in ("sample_group", "sample") if c in has]
    out = long.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    if medians:
        out = beside(out, exact_quantiles(long, keys, {f"med_{c}": F.col(c) for c in medians}), keys)
    return out.withColumns(
        {
            "per_var_seen": percent("n_var", "psbl_var"),
            "per_reads_passfilt": percent("n_reads_passfilt", "n_reads"),
            "per_bc_passfilt": percent("n_bc_passfilt", "n_bc"),
            "per_usable": percent("n_usable_reads", "n_reads_passfilt"),
            **{f"per_{n}": percent(f"n_{n}", "n_reads_passfilt") for n in ("unmapped", "badstart", "badend", "softclip", "otheriso")},
            "per_sdv": percent("n_sdv", "n_var"),
            "per_sdv_ex": percent("n_sdv_ex", "n_var_ex"),
            "per_sdv_in": percent("n_sdv_in", "n_var_in"),
            "per_acc_used": percent("n_alt_acc", "psbl_alt_acc"),
            "per_don_used": percent("n_alt_don", "psbl_alt_don"),
        }
    )


def disruption_summary(tbv: DataFrame) -> DataFrame:
    """How many variants disrupt splicing, overall and by kind, over variants with passing barcodes."""
    rows = tbv.filter(F.col("n_bc_passfilt") > 0)
    kind = F.col("var_type")
    parts = {
        "var": (F.lit(True), "sdv"),
        "syn": (kind == "Synonymous", "sdv"),
        "exonic": (kind != "Intronic", "sdv_exon"),
        "intronic": (kind == "Intronic", "sdv_intron"),
        "acc": (F.col("psbl_snv_acc"), "snv_acc"),
        "don": (F.col("psbl_snv_don"), "snv_don"),
    }
    aggs = [((F.max("pos") - F.min("pos")) * 3).alias("psbl_var")]
    for n, (cond, flag) in parts.items():
        used = F.col(flag) if n in ("acc", "don") else cond & F.col(flag)
        aggs += [count_if(cond).alias(f"n_{n}"), count_if(used).alias(f"n_{n}_sdv")]
    out = rows.agg(*aggs).withColumn("per_var_seen", percent("n_var", "psbl_var"))
    return out.withColumns({f"per_{n}_sdv": percent(f"n_{n}_sdv", f"n_{n}") for n in parts})


def sdv_rate_by_threshold(tbv: DataFrame, col: str, low: float, high: float, points: int = 20, marks=(1.96, 3.0), absolute: bool = True) -> DataFrame:
    """Percent of variants at or above each threshold, per sample: one conditional sum per threshold."""
    step = (high - low) / points
    grid = sorted([low + i * step for i in range(points)] + [float(m) for m in marks])
    v = F.abs(col) if absolute else F.col(col)
    rows = tbv.filter(F.col("n_bc_passfilt") > 0)
    one = rows.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_var"), F.array(*[F.struct(F.lit(t).alias("threshold"), count_if(v >= t).alias("n")) for t in grid]).alias("g")
    )
    return one.select("sample", "n_var", F.explode("g").alias("g")).select(
        "sample", "g.threshold", "n_var", F.col("g.n").alias("n_sdv"), percent("g.n", "n_var").alias("per_sdv")
    )


def sdv_replication(tbv: DataFrame, flag: str = "sdv") -> DataFrame:
    """Variants that disrupt splicing in exactly k samples, for every k up to the number of samples."""
    rows = tbv.filter(F.col("n_bc_passfilt") > 0)
    per = rows.groupBy("varlist").agg(count_if(F.col(flag)).alias("k"))
    counts = per.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    n_var = counts.agg(F.sum("n").alias("n_var"))
    samples = rows.select("sample").distinct().agg(F.count(F.lit(1)).cast("int").alias("s"))
    ks = samples.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("s").cast("long"))).alias("k"))
    out = attach(ks.join(counts, "k", "left"), n_var)
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("per", percent("n", "n_var"))


def variant_completeness(tbv: DataFrame, col: str = "n_bc_passfilt", by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Position by base matrix of barcode counts, and the percent of possible changes present; both within ``by``, such as the sample."""
    by = by or []
    matrix = tbv.groupBy(*by, "pos").pivot("alt", ["A", "C", "G", "T"]).agg(F.first(col, True))
    filled = reduce(lambda a, b: a + b, [F.when(F.col(b) > 0, 1).otherwise(0) for b in "ACGT"])
    total = matrix.groupBy(*by).agg(F.sum(filled).alias("n_present"), (F.count(F.lit(1)) * 3).alias("n_possible"))
    return matrix, total.withColumn("per_present", percent("n_present", "n_possible"))


def psi_position_matrix(tbv: DataFrame, col: str, zoom: tuple[int, int] | None = None, rev: bool = False, by: list[str] | None = None) -> DataFrame:
    """Position by base table of a value within ``by``; labels are complemented for the minus strand."""
    by = by or []
    rows = tbv if zoom is None else tbv.filter(F.col("pos").between(*zoom))
    out = rows.groupBy(*by, "pos").pivot("alt", ["A", "C", "G", "T"]).agg(F.first(col, True))
    labels = {"A": "T", "C": "G", "G": "C", "T": "A"} if rev else {b: b for b in "ACGT"}
    return out.select(*by, "pos", *[F.col(b).alias(labels[b]) for b in "ACGT"])


def exon_sdv_counts(scores: DataFrame, exons: DataFrame, flank: int, thresholds: list[float], score: str, bin_width: int = 1024) -> DataFrame:
    """Variants at or above each threshold in every exon and its flanks, and a total row.

    Interval containment as an equi-join on position bins with the exact test on top.
    """
    lo, hi = F.col("start_pos") - flank, F.col("end_pos") + flank
    wide = exons.withColumn("_bin", F.explode(F.sequence(F.floor(lo / bin_width), F.floor(hi / bin_width))))
    hits = scores.withColumn("_bin", F.floor(F.col("pos") / bin_width)).join(wide, ["chrom", "_bin"])
    hits = hits.filter((F.col("pos") >= lo) & (F.col("pos") <= hi))
    where = {
        "ex": F.col("pos").between(F.col("start_pos"), F.col("end_pos")),
        "us_int": F.col("pos") < F.col("start_pos"),
        "ds_int": F.col("pos") > F.col("end_pos"),
    }
    names = [f"t{i}" for i in range(len(thresholds))]
    aggs = []
    for r, cond in where.items():
        aggs.append(count_if(cond).alias(f"_n_{r}"))
        aggs += [count_if(cond & (F.col(score) >= t)).alias(f"_{r}_{n}") for t, n in zip(thresholds, names)]
    counts = hits.groupBy("exon").agg(*aggs)
    out = exons.select("exon", (F.col("end_pos") - F.col("start_pos")).alias("n_ex_bp")).join(counts, "exon", "left")
    cols = {f"n_{r}_bp": F.floor(F.coalesce(f"_n_{r}", F.lit(0)) / 3) for r in ("us_int", "ds_int")}
    for r in where:
        for t, n in zip(thresholds, names):
            some = F.col(f"_n_{r}") > 0
            cols[f"n_{r}_abv_{t}"] = F.when(some, F.col(f"_{r}_{n}"))
            cols[f"per_{r}_abv_{t}"] = F.when(some, percent(f"_{r}_{n}", f"_n_{r}"))
    out = out.withColumns(cols)
    keep = ["exon", "n_ex_bp", *cols]
    out = out.select([F.col(f"`{c}`") for c in keep])
    sums = [c for c in keep if c.startswith("n_")]
    total = out.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in sums])
    for r in where:
        for t in thresholds:
            total = total.withColumn(f"per_{r}_abv_{t}", percent(F.col(f"`n_{r}_abv_{t}`"), F.col(f"n_{r}_bp") * 3))
    return out.unionByName(total.withColumn("exon", F.lit(None).cast(out.schema["exon"].dataType)).select([F.col(f"`{c}`") for c in keep]))


def fisher_exact() -> Callable[[int, int, int, int], tuple[float, float]]:
    """A self-contained test to ship to tasks: odds ratio and two-sided p of a 2x2 table.

    p sums all tables with the same margins that are no more likely than the given one. Sums walk outwards from the likeliest table, from
    the given one and from its counterpart on the other side, in chunks, until the terms no longer count; so memory is one
    chunk whatever the counts.
    """
    chunk, near, least = 4096, 1 << 17, 1e-18

    def test(a: int, b: int, c: int, d: int) -> tuple[float, float]:
        if b * c:
            odds = a * d / (b * c)
        else:
            odds = float("inf") if a * d else float("nan")
        row, col, n = a + b, a + c, a + b + c + d
        lo, hi = max(0, row + col - n), min(row, col)

        def up(k: np.ndarray) -> np.ndarray:
            """Log ratio of the table with cell k + 1 to that with cell k."""
            return np.log(row - k) + np.log(col - k) - np.log(k + 1) - np.log(n - row - col + k + 1)

        def log_size(k: int) -> float:
            return -sum(math.lgamma(x + 1) for x in (k, row - k, col - k, n - row - col + k))

        def between(k: int, m: int) -> float:
            """Log ratio of table m to table k."""
            if abs(m - k) > near:
                return log_size(m) - log_size(k)
            first, last = min(k, m), max(k, m)
            total = sum(float(up(np.arange(i, min(i + chunk, last))).sum()) for i in range(first, last, chunk))
            return total if m > k else -total

        def outwards(k: int, side: int) -> float:
            """Tables from k to the end of a side, as multiples of table k; they fall all the way."""
            total, log = 1.0, 0.0
            while k != (hi if side > 0 else lo):
                logs = np.cumsum(up(np.arange(k, min(k + chunk, hi))) if side > 0 else -up(np.arange(k - 1, max(k - chunk, lo) - 1, -1))) + log
                terms = np.exp(logs)
                total, log, k = total + float(terms.sum()), float(logs[-1]), k + side * len(terms)
                if terms[-1] < least * total:
                    break
            return total

        mode = min(hi, max(lo, (row + 1) * (col + 1) // (n + 2)))
        whole = outwards(mode, 1) + outwards(mode, -1) - 1
        level, side = between(mode, a), 1 if a >= mode else -1
        p = math.exp(level) * outwards(a, side)
        # the nearest table on the other side that is no more likely, found by halving
        low, high = int(a == mode), side * (mode - (lo if side > 0 else hi)) + 1
        while low < high:
            middle = (low + high) // 2
            if between(mode, mode - side * middle) <= level + 1e-7:
                high = middle
            else:
                low = middle + 1
        other = mode - side * low
        if lo <= other <= hi:
            p += math.exp(between(mode, other)) * outwards(other, -side)
        return odds, min(1.0, p / whole)

    return test


def motif_enrichment(
    long: DataFrame, region: tuple[int, int] | None, wt_min: float, change_max: float, p_max: float, proteins: DataFrame | None = None, species: str = "Homo_sapiens"
) -> DataFrame:
    """Motifs bound at disrupting variants and broken more often by them than by other variants.

    ``long`` (motif, pos, sdv, wt, chg): one row per variant and motif. ``proteins`` (motif, protein, species) names the motifs: those
    without a protein of the species are left out, others are called by their proteins and the motif.
    """
    rows = long if region is None else long.filter(F.col("pos").between(*region))
    if proteins is not None:
        own = proteins.filter(F.col("species") == species).groupBy("motif").agg(F.array_join(F.array_sort(F.collect_set("protein")), "_").alias("_p"))
        names = own.select("motif", F.concat_ws("_", "_p", "motif").alias("name"))
        rows = rows.join(names.select("motif"), "motif", "left_semi")
    broken = is_true(F.col("chg") <= change_max)
    sdv = F.col("sdv")
    per_pos = rows.groupBy("motif", "pos").agg(
        F.avg(F.when(sdv, F.col("wt"))).alias("wt"),
        count_if(broken).alias("below"),
        count_if(broken & sdv).alias("sdv_below"),
        count_if(sdv).alias("sdvs"),
        F.count(F.lit(1)).alias("total"),
    )
    tables = per_pos.groupBy("motif").agg(
        F.max("wt").alias("wt_max"), *[F.sum(c).alias(c) for c in ("below", "sdv_below", "sdvs", "total")]
    )
    tables = tables.filter((F.col("wt_max") >= wt_min) & (F.col("below") > 0))

    fisher = fisher_exact()

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = pdf[["sdv_below", "sdvs", "below", "total"]].to_numpy().tolist()
            got = [fisher(x, s - x, b - x, n - s - (b - x)) for x, s, b, n in counts]
            yield pdf.assign(odds=[g[0] for g in got], p=[g[1] for g in got])

    schema = "motif string, wt_max double, below long, sdv_below long, sdvs long, total long, odds double, p double"
    out = tables.mapInPandas(test, schema).filter((F.col("p") < p_max) & (F.col("odds") > 1))
    return out if proteins is None else out.join(names, "motif")


def replicate_correlation(long: DataFrame, keys: list[str], col: str, samples: list[str]) -> DataFrame:
    """Pearson correlation of every pair of samples over shared variants, from one pivoted pass."""
    wide = long.groupBy(*keys).pivot("sample", samples).agg(F.first(col, True))
    pairs = [(a, b) for a in samples for b in samples if a != b]
    got = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"`{a}`", f"`{b}`").alias("r")) for a, b in pairs])
    return wide.agg(got.alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b", "p.r")


def replicate_correlation_medians(corr: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Median correlation within each group of samples and between groups."""
    pairs = [F.lit(x) for kv in groups.items() for x in kv]
    g = F.create_map(*pairs)
    df = corr.withColumns({"ga": F.try_element_at(g, F.col("a")), "gb": F.try_element_at(g, F.col("b"))})
    kind = F.when(F.col("ga") == F.col("gb"), F.col("ga")).otherwise("between")
    return df.groupBy(kind.alias("group")).agg(F.percentile("r", F.lit(0.5)).alias("median_r"))


def benchmark_rank_join(bench: DataFrame, long: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Rank of each variant in one sample, from 0 at the largest value, beside its values elsewhere."""
    ranked = number_rows(bench.select(*keys, F.col(col).alias("_v")), [F.col("_v").isNull(), -F.col("_v"), *[F.col(k) for k in keys]], "_n")
    ranks = ranked.select(*keys, (F.col("_n") - 1).alias(f"{col}_rank"))
    return long.join(ranks, keys)


def flag_combinations(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def linear_fit(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Least-squares coefficients of ``y`` on the predictors, one row each, with the intercept."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = df.select(*[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias(y)).dropna()
    ready = VectorAssembler(inputCols=xs, outputCol="features").transform(data)
    model = LinearRegression(featuresCol="features", labelCol=y, solver="normal", regParam=0.0).fit(ready)
    rows = [*zip(xs, [float(c) for c in model.coefficients]), ("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


# ---- sampling ---------------------------------------------------------------------------------


def sample_transcripts(gtf: DataFrame, genes: int, per_gene: int = 1, seed: int = 1005) -> DataFrame:
    """Random genes, then random transcripts of each; the order is a digest, so a seed fixes the choice."""

    def lot(c: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), c))

    chosen = gtf.select("gene_id").distinct().orderBy(lot("gene_id"), "gene_id").limit(genes)
    tx = gtf.filter(F.col("feature") == "transcript").select("gene_id", "transcript_id").distinct().join(chosen, "gene_id", "left_semi")
    pick = F.row_number().over(Window.partitionBy("gene_id").orderBy(lot("transcript_id"), "transcript_id"))
    return tx.withColumn("_r", pick).filter(F.col("_r") <= per_gene).drop("_r")


def sample_positions(gtf: DataFrame, base: DataFrame, n: int, exonic: float = 0.5, seed: int = 1005) -> DataFrame:
    """Exonic and intronic positions per transcript inside its coding span, each with a random change.

    ``gtf`` (chrom, strand, transcript_id, feature, start_pos, end_pos), ``base`` (chrom, pos, base).
    A transcript gives at most what it has.
    """
    n_ex = int(n * exonic)
    keys = ["chrom", "strand", "transcript_id"]
    cds = gtf.filter(F.col("feature") == "CDS").groupBy(*keys).agg(F.min("start_pos").alias("lo"), (F.max("end_pos") - 1).alias("hi"))
    exons = gtf.filter(F.col("feature") == "exon")
    has_exon = exons.select("transcript_id").distinct()
    span = explode_range(cds.join(has_exon, "transcript_id", "left_semi"), "lo", "hi", "pos").select(*keys, "pos")
    inside = explode_range(exons.select(*keys, "start_pos", "end_pos"), "start_pos", "end_pos", "pos").select(*keys, "pos").distinct()
    marked = span.join(inside.withColumn("exonic", F.lit(True)), [*keys, "pos"], "left").withColumn("exonic", F.coalesce("exonic", F.lit(False)))
    place = F.concat_ws("|", F.lit(seed).cast("string"), "transcript_id", F.col("pos").cast("string"))
    lot = F.md5(place)
    order = F.row_number().over(Window.partitionBy("transcript_id", "exonic").orderBy(lot, "pos"))
    wanted = F.when(F.col("exonic"), F.lit(n_ex)).otherwise(F.lit(n - n_ex))
    picked = marked.withColumn("_r", order).filter(F.col("_r") <= wanted).drop("_r")
    ref = base.select("chrom", "pos", F.upper("base").alias("ref"))
    out = picked.join(ref, ["chrom", "pos"])
    others = F.array_except(F.array(*[F.lit(b) for b in "ACGT"]), F.array("ref"))
    drawn = F.array_min(F.transform(others, lambda b: F.struct(F.md5(F.concat_ws("|", place, b)).alias("lot"), b.alias("base"))))
    return out.withColumn("alt", drawn["base"])
