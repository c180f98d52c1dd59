"""Plans of the statistics, window and sampling section."""

from pyspark.sql import functions as F

from juncture.operators import statistics as S
from juncture.operators.barcodes import variant_summary_pe
from juncture.plans.barcodes import SAMPLES
from juncture.plans.isoforms import CUT_SQL
from juncture.plans.registry import query
from juncture.sources.text import with_gtf_ids

PAIR = ["skip", "full"]


@query("zscore_by_sample", "varlist:s sample:s zwmean_skip:d",
       """select varlist, sample, (wmean_skip - avg(wmean_skip) over (partition by sample)) / stddev_pop(wmean_skip) over (partition by sample) as zwmean_skip from fx_long""")
def _(t):
    return S.zscore_by_sample(t("fx_long"), ["wmean_skip"])


_IDX = """(select *, row_number() over (partition by {by} order by md5(barcode), barcode) - 1 as idx, count(*) over (partition by {by}) as m from {src})"""
_DRAW = "((({n} * 1000003 + b * 7919 + d * 104729) * 48271) % 2147483647) % m"


def _bootstrap_sql(boots):
    """One sequence of draws for each sample and bootstrap; a count takes its beginning."""
    return f"""(select c.sample, c.n, {', '.join(f'avg(w_{i}) as wmean_bs_null_{i}, stddev_pop(w_{i}) as wstdev_bs_null_{i}' for i in PAIR)} from (
      select g.sample, b, d, {', '.join(f'sum(usable_reads * {i}_psi) over so_far / sum(usable_reads) over so_far as w_{i}' for i in PAIR)}
      from (select z.sample, b, d, m, {_DRAW.format(n='0')} as idx from (select sample, count(*) as m from fx_null group by sample) z
              join (select sample, max(n_bc_passfilt) as hi from fx_long group by sample) h on h.sample = z.sample, (select unnest(range({boots})) as b) x, lateral (select unnest(range(hi)) as d) y) g
      join {_IDX.format(by='sample', src='fx_null')} i on i.sample = g.sample and i.idx = g.idx window so_far as (partition by g.sample, b order by d)) r
      join (select distinct sample, n_bc_passfilt as n from fx_long) c on c.sample = r.sample and c.n = r.d + 1 group by 1, 2)"""


_BS = " ".join(f"wmean_bs_null_{i}:d wstdev_bs_null_{i}:d" for i in PAIR)


def _bootstrapped(t, boots=1000):
    return S.bootstrap_null_by_count(t("fx_null"), t("fx_long"), PAIR, boots, S.arithmetic_draw)


@query("bootstrap_null", "varlist:s sample:s wmean_bs_WT_skip:d wstdev_bs_WT_skip:d",
       f"""with l as (select sample, cast(pos as bigint) * 10 + instr('ACGT', alt) as b, n_bc_passfilt as n from fx_tbv),
       g as (select sample, b, n, unnest(range(n)) as d from l),
       x as (select g.sample, b, n, d, {_DRAW.format(n='n')} as idx from g join (select sample, count(*) as m from fx_null group by sample) k on g.sample = k.sample),
       r as (select x.sample, x.b, sum(usable_reads * skip_psi) / sum(usable_reads) as v from x join {_IDX.format(by='sample', src='fx_null')} i on i.sample = x.sample and i.idx = x.idx group by 1, 2),
       o as (select sample, avg(v) as "wmean_bs_WT_skip", stddev_pop(v) as "wstdev_bs_WT_skip" from r group by sample)
       select varlist, l.sample, "wmean_bs_WT_skip", "wstdev_bs_WT_skip" from fx_long l left join o on l.sample = o.sample""")
def _(t):
    wanted = t("fx_tbv").selectExpr("sample", "cast(pos as bigint) * 10 + instr('ACGT', alt) as b", "n_bc_passfilt as n")
    return S.bootstrap_null(wanted, t("fx_null"), t("fx_long"), ["skip"], S.arithmetic_draw, ["sample"])


@query("bootstrap_null_by_count", f"varlist:s sample:s n_bc_passfilt:i {_BS}",
       f"select l.varlist, l.sample, l.n_bc_passfilt, b.* exclude (sample, n) from fx_long l left join {_bootstrap_sql(1000)} b on b.sample = l.sample and b.n = l.n_bc_passfilt")
def _(t):
    return _bootstrapped(t)


@query("intron_null", "varlist:s sample:s wmean_int_skip:d wstdev_int_skip:d sq_inv_eff_skip:d",
       """with a as (select avg(wmean_skip) filter (where f) as m, stddev_samp(wmean_skip) filter (where f) as s, count(*) filter (where f) as ni, count(*) as ne, stddev_samp(wmean_skip) as se
         from (select *, pos < 1380 or pos > 1520 as f from fx_tbv))
       select varlist, sample, m as wmean_int_skip, s as wstdev_int_skip,
         (ni * 1e0 * ne * (ni + ne - 2)) / ((ni + ne) * 1e0 * ((ni - 1) * s * s + (ne - 1) * se * se)) as sq_inv_eff_skip from fx_tbv, a""")
def _(t):
    return S.intron_null(t("fx_tbv"), (1400, 1500), 20, ["skip"])


_Z = f"""(select l.*, b.* exclude (sample, n), wmean_skip - wmean_bs_null_skip as wmean_diff_skip, wmean_full - wmean_bs_null_full as wmean_diff_full,
   {', '.join(f'(wmean_{i} - wmean_bs_null_{i}) / nullif(wstdev_bs_null_{i}, 0) as zwmean_bs_null_{i}, wmean_{i} / nullif(wmean_bs_null_{i}, 0) as fc_{i}' for i in PAIR)}
   from fx_tbv l left join {_bootstrap_sql(100)} b on b.sample = l.sample and b.n = l.n_bc_passfilt)"""


def _scored(t):
    b = S.bootstrap_null_by_count(t("fx_null"), t("fx_tbv"), PAIR, 100, S.arithmetic_draw)
    b = S.fold_change(S.null_zscore(b, "bs_null", PAIR), "wmean_bs_null_", "wmean_", PAIR)
    return b.withColumns({f"wmean_diff_{i}": F.col(f"wmean_{i}") - F.col(f"wmean_bs_null_{i}") for i in PAIR})


@query("null_zscore", "varlist:s sample:s zwmean_bs_null_skip:d zwmean_bs_null_full:d", f"select * from {_Z}")
def _(t):
    return _scored(t)


@query("stouffer_z", "varlist:s z_skip:d",
       f"select varlist, sum(zwmean_bs_null_skip) / sqrt(count(zwmean_bs_null_skip)) as z_skip from {_Z} group by varlist")
def _(t):
    return S.stouffer_z(_scored(t), ["varlist"], ["zwmean_bs_null_skip"]).withColumnRenamed("zwmean_bs_null_skip", "z_skip")


@query("stouffer_z_weighted", "varlist:s z_skip:d z_full:d",
       f"""with w as (select sample, sum(n_bc_passfilt) as w from fx_tbv group by sample)
       select varlist, coalesce(sum(zwmean_bs_null_skip * w), 0) / (select sqrt(sum(w * w)) from w) as z_skip,
         coalesce(sum(zwmean_bs_null_full * w), 0) / (select sqrt(sum(w * w)) from w) as z_full from {_Z} z join w on w.sample = z.sample group by varlist""")
def _(t):
    t.hold("fx_long")
    weights = t("fx_tbv").groupBy("sample").agg(F.sum("n_bc_passfilt").alias("weight"))
    names = {f"zwmean_bs_null_{i}": f"z_{i}" for i in PAIR}
    return S.stouffer_z(_scored(t), ["varlist"], list(names), weights).withColumnsRenamed(names)


@query("fold_change", "varlist:s sample:s fc_skip:d fc_full:d", f"select * from {_Z}")
def _(t):
    return _scored(t)


@query("sdv_by_isoform", "varlist:s sample:s sdv_skip:b sdv_full:b",
       f"""select varlist, sample, {', '.join(f"coalesce(abs(zwmean_bs_null_{i}) >= 1.5 and (fc_{i} >= 1.3 or fc_{i} <= 1 / 1.3) and abs(wmean_{i} - wmean_bs_null_{i}) >= 0.2, false) as sdv_{i}" for i in PAIR)} from {_Z}""")
def _(t):
    return S.sdv_by_isoform(_scored(t), PAIR, "zwmean_bs_null_", 1.5, "fc_", 1.3, ("wmean_bs_null_", "wmean_", 0.2))


# upper normal quantile for small tails: the rational approximation published by P. Acklam
_CUT = """-(((((-7.784894002430293e-03 * q - 3.223964580411365e-01) * q - 2.400758277161838e+00) * q - 2.549732539343734e+00) * q + 4.374664141464968e+00) * q + 2.938163982698783e+00)
 / ((((7.784695709041462e-03 * q + 3.224671290700398e-01) * q + 2.445134137142996e+00) * q + 3.754408661907416e+00) * q + 1)"""


@query("bonferroni_calls", "varlist:s sample:s alpha:d sdv_skip:b intmed_skip:b sdv_full:b intmed_full:b sdv:b intmed:b",
       f"""with z as (select *, log2((wmean_full + 0.001) / (wmean_skip + 0.001)) as r from {_Z}),
       a as (select alpha, {_CUT} as cut from (select alpha, sqrt(-2 * ln(alpha)) as q from (select 0.05 / max(n) as alpha from (select count(*) as n from fx_tbv group by sample)))),
       f as (select varlist, sample, alpha, coalesce(zwmean_bs_null_skip >= cut and wmean_diff_skip >= 0.2, false) as sdv_skip, coalesce(zwmean_bs_null_skip >= cut and wmean_diff_skip >= 0.1, false) as intmed_skip,
         coalesce(abs(zwmean_bs_null_full) >= cut and (wmean_full >= 1.5 or wmean_full <= -1), false) as sdv_full, coalesce(abs(zwmean_bs_null_full) >= cut and (wmean_full >= 1 or wmean_full <= -0.5), false) as intmed_full from z, a)
       select *, sdv_skip or sdv_full as sdv, (intmed_skip or intmed_full) and not (sdv_skip or sdv_full) as intmed from f""")
def _(t):
    return S.bonferroni_calls(_scored(t), ["skip"], ["full"])


@query("calls_over_samples", "varlist:s sdv_sum:i intmed_sum:i",
       f"""with z as (select *, log2((wmean_full + 0.001) / (wmean_skip + 0.001)) as r from {_Z}),
       a as (select {_CUT} as cut from (select alpha, sqrt(-2 * ln(alpha)) as q from (select 0.05 / max(n) as alpha from (select count(*) as n from fx_tbv group by sample)))),
       f as (select varlist, coalesce(zwmean_bs_null_skip >= cut and wmean_diff_skip >= 0.2, false) or coalesce(abs(zwmean_bs_null_full) >= cut and (wmean_full >= 1.5 or wmean_full <= -1), false) as sdv,
         coalesce(zwmean_bs_null_skip >= cut and wmean_diff_skip >= 0.1, false) or coalesce(abs(zwmean_bs_null_full) >= cut and (wmean_full >= 1 or wmean_full <= -0.5), false) as med from z, a)
       select varlist, count(*) filter (where sdv) as sdv_sum, count(*) filter (where med and not sdv) as intmed_sum from f group by varlist""")
def _(t):
    return S.calls_over_samples(S.bonferroni_calls(_scored(t), ["skip"], ["full"]), ["varlist"])


@query("rank_cutoff", "sample:s percentile:d x:d y:i", f"select * from {CUT_SQL.format(v='num_reads', ps='75e0, 95e0')}")
def _(t):
    return S.rank_cutoff(t("fx_bcs"), "num_reads", [75, 95], ["sample"])


@query("cutoff_table", "sample:s 75_x:d 75_y:i 75_x_log10:d 95_x:d 95_y:i 95_x_log10:d",
       f"""select sample, {', '.join(f'max(case when percentile = {p} then power(10, x) end) as "{p}_x", max(case when percentile = {p} then y end) as "{p}_y", max(case when percentile = {p} then x end) as "{p}_x_log10"' for p in (75, 95))}
       from {CUT_SQL.format(v='usable_reads', ps='75e0, 95e0')} group by sample""")
def _(t):
    return S.cutoff_table(S.rank_cutoff(t("fx_bcs"), "usable_reads", [75, 95], ["sample"]), [75, 95])


_COLS = ["usable_reads", "unmapped_reads", "bad_starts", "bad_ends", "soft_clipped", "other_isoform"]
_EFFECTS = f"""(select *, coalesce(wm >= 0.6, false) as sdv, case when pos between 1400 and 2000 then case pos % 3 when 0 then 'Synonymous' else 'Missense' end else 'Intronic' end as var_type from (
   select sample, variant_list as varlist, cast(split_part(variant_list, ':', 2) as int) as pos, count(*) as n_bc, sum(case when usable_reads > 1 then 1 else 0 end) as n_bc_passfilt,
   sum(num_reads) as sum_reads, coalesce(sum(case when usable_reads > 1 then num_reads end), 0) as sum_reads_passfilt,
   {', '.join(f'coalesce(sum(case when usable_reads > 1 then {c} end), 0) as sum_{c}' for c in _COLS)},
   sum(case when usable_reads > 1 then iso_skip end) / (sum(case when usable_reads > 1 then usable_reads end) * 1e0) as wm
   from fx_bcs b join fx_subasm s on b.barcode = s.barcode where n_variants_passing = 1 group by sample, variant_list))"""


def _effects(t):
    long = variant_summary_pe(t("fx_subasm"), t("fx_bcs"), 1, _COLS, ["iso_skip"], ["sample"])
    kind = F.when(F.col("pos").between(1400, 2000), F.when(F.col("pos") % 3 == 0, "Synonymous").otherwise("Missense")).otherwise("Intronic")
    long = long.withColumns({"sdv": F.coalesce(F.col("wmean_iso_skip") >= 0.6, F.lit(False)), "var_type": kind})
    return long.withColumns({
        "sdv_exon": F.col("sdv") & (F.col("var_type") != "Intronic"), "sdv_intron": F.col("sdv") & (F.col("var_type") == "Intronic"),
        "psbl_snv_acc": F.col("pos") % 4 == 0, "psbl_snv_don": F.col("pos") % 5 == 0,
        "snv_acc": F.col("sdv") & (F.col("pos") % 4 == 0), "snv_don": F.col("sdv") & (F.col("pos") % 5 == 0)})


_STATS = ["psbl_var", "n_var", "n_var_ex", "n_var_in", "n_reads", "n_reads_passfilt", "n_usable_reads", "n_bc", "n_bc_passfilt", "n_unmapped", "n_badstart", "n_badend",
          "n_softclip", "n_otheriso", "n_sdv", "n_sdv_ex", "n_sdv_in", "psbl_alt_acc", "psbl_alt_don", "n_alt_acc", "n_alt_don"]
_PERS = {"var_seen": ("n_var", "psbl_var"), "reads_passfilt": ("n_reads_passfilt", "n_reads"), "bc_passfilt": ("n_bc_passfilt", "n_bc"), "usable": ("n_usable_reads", "n_reads_passfilt"),
         **{n: (f"n_{n}", "n_reads_passfilt") for n in ("unmapped", "badstart", "badend", "softclip", "otheriso")},
         "sdv": ("n_sdv", "n_var"), "sdv_ex": ("n_sdv_ex", "n_var_ex"), "sdv_in": ("n_sdv_in", "n_var_in"), "acc_used": ("n_alt_acc", "psbl_alt_acc"), "don_used": ("n_alt_don", "psbl_alt_don")}


@query("sample_statistics", "sample:s " + " ".join(f"{c}:i" for c in _STATS) + " med_n_bc:d med_sum_reads:d " + " ".join(f"per_{p}:d" for p in _PERS),
       f"""with g as (select sample, 3 * (max(pos) - min(pos)) as psbl_var, count(*) filter (where n_bc_passfilt > 0) as n_var, sum(sum_reads) as n_reads, sum(sum_reads_passfilt) as n_reads_passfilt,
         {', '.join(f'sum({c}) as {n}' for c, n in S.SAMPLE_SUMS.items())}, sum(n_bc) as n_bc, sum(n_bc_passfilt) as n_bc_passfilt,
         count(*) filter (where n_bc_passfilt > 0 and sdv) as n_sdv, count(*) filter (where n_bc_passfilt > 0 and var_type <> 'Intronic') as n_var_ex,
         count(*) filter (where n_bc_passfilt > 0 and var_type = 'Intronic') as n_var_in, count(*) filter (where n_bc_passfilt > 0 and sdv and var_type <> 'Intronic') as n_sdv_ex,
         count(*) filter (where n_bc_passfilt > 0 and sdv and var_type = 'Intronic') as n_sdv_in, null as psbl_alt_acc, null as psbl_alt_don, null as n_alt_acc, null as n_alt_don,
         median(n_bc) as med_n_bc, median(sum_reads) as med_sum_reads from {_EFFECTS} group by sample)
       select *, {', '.join(f'100e0 * {a} / nullif({b}, 0) as per_{n}' for n, (a, b) in _PERS.items())} from g""")
def _(t):
    return S.sample_statistics(_effects(t), ["n_bc", "sum_reads"])


_DISR = {"var": ("true", "sdv"), "syn": ("var_type = 'Synonymous'", "sdv"), "exonic": ("var_type <> 'Intronic'", "sdv"), "intronic": ("var_type = 'Intronic'", "sdv"),
         "acc": ("pos % 4 = 0", "sdv"), "don": ("pos % 5 = 0", "sdv")}


@query("disruption_summary", "psbl_var:i per_var_seen:d " + " ".join(f"n_{n}:i n_{n}_sdv:i per_{n}_sdv:d" for n in _DISR),
       f"""with g as (select 3 * (max(pos) - min(pos)) as psbl_var, {', '.join(f'count(*) filter (where {c}) as n_{n}, count(*) filter (where {c} and {f}) as n_{n}_sdv' for n, (c, f) in _DISR.items())}
         from {_EFFECTS} where n_bc_passfilt > 0)
       select *, 100e0 * n_var / psbl_var as per_var_seen, {', '.join(f'100e0 * n_{n}_sdv / nullif(n_{n}, 0) as per_{n}_sdv' for n in _DISR)} from g""")
def _(t):
    return S.disruption_summary(_effects(t))


@query("sdv_rate_by_threshold", "sample:s threshold:d n_var:i n_sdv:i per_sdv:d",
       """with g as (select unnest(list_concat(list_transform(range(20), lambda i: 0.0e0 + i * (0.9e0 / 20)), [0.25e0, 0.5e0])) as threshold)
       select sample, threshold, count(*) as n_var, count(*) filter (where abs(wmean_skip) >= threshold) as n_sdv, 100e0 * count(*) filter (where abs(wmean_skip) >= threshold) / count(*) as per_sdv
       from fx_long, g where n_bc_passfilt > 0 group by 1, 2""")
def _(t):
    return S.sdv_rate_by_threshold(t("fx_long"), "wmean_skip", 0.0, 0.9, 20, (0.25, 0.5))


@query("sdv_replication", "k:i n:i per:d",
       """with p as (select varlist, count(*) filter (where wmean_skip >= 0.5) as k from fx_long where n_bc_passfilt > 0 group by varlist)
       select s.k, count(p.k) as n, 100e0 * count(p.k) / (select count(*) from p) as per from (select unnest(range(1, 1 + (select count(distinct sample) from fx_long))) as k) s left join p on p.k = s.k group by s.k""")
def _(t):
    return S.sdv_replication(t("fx_long").withColumn("sdv", F.col("wmean_skip") >= 0.5))


@query("variant_completeness", "sample:s pos:i A:i C:i G:i T:i n_present:i n_possible:i per_present:d",
       """with m as (select sample, pos, max(n_bc_passfilt) filter (where alt = 'A') as "A", max(n_bc_passfilt) filter (where alt = 'C') as "C", max(n_bc_passfilt) filter (where alt = 'G') as "G",
         max(n_bc_passfilt) filter (where alt = 'T') as "T" from fx_tbv group by 1, 2),
       s as (select sample, count(*) filter (where n_bc_passfilt > 0) as n_present, 3 * count(distinct pos) as n_possible from fx_tbv group by sample)
       select m.*, n_present, n_possible, 100e0 * n_present / n_possible as per_present from m join s on m.sample = s.sample""")
def _(t):
    matrix, total = S.variant_completeness(t("fx_tbv"), by=["sample"])
    return matrix.join(total, "sample")


@query("psi_position_matrix", "sample:s pos:i A:d C:d G:d T:d",
       """select sample, pos, max(wmean_skip) filter (where alt = 'T') as "A", max(wmean_skip) filter (where alt = 'G') as "C", max(wmean_skip) filter (where alt = 'C') as "G",
       max(wmean_skip) filter (where alt = 'A') as "T" from fx_tbv group by 1, 2""")
def _(t):
    return S.psi_position_matrix(t("fx_tbv"), "wmean_skip", rev=True, by=["sample"])


_REG = {"ex": "s.pos between e.start_pos and e.end_pos", "us_int": "s.pos between e.start_pos - 12 and e.start_pos - 1", "ds_int": "s.pos between e.end_pos + 1 and e.end_pos + 12"}
_TS = (0.5, 0.8)


@query("exon_sdv_counts", "exon:s n_ex_bp:i n_us_int_bp:i n_ds_int_bp:i " + " ".join(f"n_{r}_abv_{x}:i per_{r}_abv_{x}:d" for r in _REG for x in _TS),
       f"""with e as (select concat(gene, '.', exon_num) as exon, * from fx_exons),
       c as (select e.exon, max(e.end_pos - e.start_pos) as n_ex_bp, {', '.join(f'count(*) filter (where {c}) as n_{r}, ' + ', '.join(f'count(*) filter (where {c} and score_a >= {x}) as "n_{r}_{x}"' for x in _TS) for r, c in _REG.items())}
         from e left join fx_scores s on s.pos between e.start_pos - 12 and e.end_pos + 12 group by e.exon),
       o as (select exon, n_ex_bp, cast(floor(n_us_int / 3) as bigint) as n_us_int_bp, cast(floor(n_ds_int / 3) as bigint) as n_ds_int_bp,
         {', '.join(f'case when n_{r} > 0 then "n_{r}_{x}" end as "n_{r}_abv_{x}", 100e0 * "n_{r}_{x}" / nullif(n_{r}, 0) as "per_{r}_abv_{x}"' for r in _REG for x in _TS)} from c)
       select * from o union all by name
       select null as exon, sum(n_ex_bp) as n_ex_bp, sum(n_us_int_bp) as n_us_int_bp, sum(n_ds_int_bp) as n_ds_int_bp,
         {', '.join(f'coalesce(sum("n_{r}_abv_{x}"), 0) as "n_{r}_abv_{x}", 100e0 * coalesce(sum("n_{r}_abv_{x}"), 0) / nullif(3 * sum(n_{r}_bp), 0) as "per_{r}_abv_{x}"' for r in _REG for x in _TS)} from o""")
def _(t):
    exons = t("fx_exons").withColumn("exon", F.concat_ws(".", "gene", "exon_num"))
    return S.exon_sdv_counts(t("fx_scores"), exons, 12, list(_TS), "score_a", bin_width=64)


_MOTIF = """(select concat('m', m) as motif, pos, score_a >= 0.5 as sdv, (pos * (m + 3) % 10) / 1e1 as wt,
   -((pos * (m + 5) + ascii(alt) * m) % 10) / 1e1 - case when score_a >= 0.5 and m % 2 = 0 then 0.3e0 else 0e0 end as chg
   from fx_scores, (select 0 as m union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) k)"""
_LF = "(lgamma({0} + 1e0))"
_HYP = "exp(lgamma(r1 + 1e0) + lgamma(n - r1 + 1e0) + lgamma(c1 + 1e0) + lgamma(n - c1 + 1e0) - lgamma(n + 1e0) - lgamma({k} + 1e0) - lgamma(r1 - {k} + 1e0) - lgamma(c1 - {k} + 1e0) - lgamma(n - r1 - c1 + {k} + 1e0))"


@query("motif_enrichment", "motif:s name:s wt_max:d below:i sdv_below:i sdvs:i total:i odds:d p:d",
       f"""with r as (select * from {_MOTIF} where motif in (select motif from fx_proteins where species = 'Homo_sapiens')),
       g as (select motif, count(*) filter (where chg <= -0.8) as below, count(*) filter (where chg <= -0.8 and sdv) as sdv_below, count(*) filter (where sdv) as sdvs, count(*) as total from r group by motif),
       w as (select motif, max(wt) as wt_max from (select motif, pos, avg(wt) filter (where sdv) as wt from r group by 1, 2) group by 1),
       x as (select g.*, wt_max, sdvs as r1, below as c1, total as n from g join w on g.motif = w.motif where wt_max >= 0.5 and below > 0),
       k as (select motif, r1, c1, n, sdv_below, unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) as k from x),
       q as (select motif, sum(case when {_HYP.format(k='k')} <= {_HYP.format(k='sdv_below')} * (1 + 1e-7) then {_HYP.format(k='k')} end) as p from k group by motif),
       s as (select motif, string_agg(protein, '_' order by protein) as names from (select distinct motif, protein from fx_proteins where species = 'Homo_sapiens') group by motif)
       select x.motif, concat(names, '_', x.motif) as name, wt_max, below, sdv_below, sdvs, total, (sdv_below * 1e0 * (total - sdvs - (below - sdv_below))) / ((sdvs - sdv_below) * 1e0 * (below - sdv_below)) as odds, p
       from x join q on x.motif = q.motif join s on x.motif = s.motif
       where p < 0.05 and (sdv_below * 1e0 * (total - sdvs - (below - sdv_below))) / ((sdvs - sdv_below) * 1e0 * (below - sdv_below)) > 1""")
def _(t):
    long = t("fx_scores").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(5))))
    long = long.selectExpr("concat('m', m) as motif", "pos", "score_a >= 0.5 as sdv", "(pos * (m + 3) % 10) / 1e1 as wt",
                           "-((pos * (m + 5) + ascii(alt) * m) % 10) / 1e1 - case when score_a >= 0.5 and m % 2 = 0 then 0.3e0 else 0e0 end as chg")
    return S.motif_enrichment(long, None, 0.5, -0.8, 0.05, t("fx_proteins"))


_PAIRS = [(a, b) for a in SAMPLES for b in SAMPLES if a != b]


@query("replicate_correlation", "group:s median_r:d",
       """with c as (select a.sample as a, b.sample as b, corr(a.wmean_skip, b.wmean_skip) as r from fx_long a join fx_long b on a.varlist = b.varlist and a.sample <> b.sample group by 1, 2),
       g as (select case when a in ('S0', 'S1') and b in ('S0', 'S1') then 'HEK' when a in ('S2', 'S3') and b in ('S2', 'S3') then 'COS' else 'between' end as "group", r from c)
       select "group", median(r) as median_r from g group by 1""")
def _(t):
    corr = S.replicate_correlation(t("fx_long"), ["varlist"], "wmean_skip", SAMPLES)
    return S.replicate_correlation_medians(corr, {"S0": "HEK", "S1": "HEK", "S2": "COS", "S3": "COS"})


@query("benchmark_rank_join", "varlist:s sample:s wmean_skip:d wmean_skip_rank:i",
       """select l.varlist, l.sample, l.wmean_skip, r.k as wmean_skip_rank from fx_long l join
       (select varlist, row_number() over (order by wmean_skip desc, varlist) - 1 as k from fx_long where sample = 'S1') r on r.varlist = l.varlist""")
def _(t):
    return S.benchmark_rank_join(t("fx_long").filter("sample = 'S1'"), t("fx_long"), "wmean_skip", ["varlist"])


@query("flag_combinations", "a:b b:b c:b n:i", "select score_a >= 0.5 as a, score_b >= 0 as b, pos % 2 = 0 as c, count(*) as n from fx_scores group by 1, 2, 3")
def _(t):
    v = t("fx_scores").selectExpr("score_a >= 0.5 as a", "score_b >= 0 as b", "pos % 2 = 0 as c")
    return S.flag_combinations(v, ["a", "b", "c"])


@query("linear_fit", "term:s coefficient:d",
       """with m as (select sample, avg(num_reads) as y from fx_bcs group by sample)
       select concat('is_', sample) as term, y - (select y from m where sample = 'S0') as coefficient from m where sample <> 'S0'
       union all select 'intercept', y from m where sample = 'S0'""")
def _(t):
    xs = [f"is_{s}" for s in SAMPLES[1:]]
    df = t("fx_bcs").withColumns({x: (F.col("sample") == x[3:]).cast("double") for x in xs})
    return S.linear_fit(df, xs, "num_reads")


@query("sample_transcripts", "gene_id:s transcript_id:s",
       """with g as (select distinct gene from fx_exons order by md5(concat('1005|', gene)), gene limit 5), x as (select gene as gene_id, concat(gene, s) as transcript_id from g, (select unnest(['T1.2', 'T2.1']) as s))
       select gene_id, transcript_id from (select *, row_number() over (partition by gene_id order by md5(concat('1005|', transcript_id)), transcript_id) as k from x) where k = 1""")
def _(t):
    return S.sample_transcripts(with_gtf_ids(t("fx_gtf")), 5, 1)


@query("sample_positions", "chrom:s strand:s transcript_id:s pos:i exonic:b ref:s alt:s",
       """with x as (select gene, strand, start_pos, end_pos, concat(gene, 'T1.2') as tx from fx_exons union all select gene, strand, start_pos, end_pos, concat(gene, 'T2.1') from fx_exons where exon_num % 2 = 1),
       s as (select tx, strand, unnest(range(min(start_pos), max(end_pos))) as pos from x group by tx, strand),
       m as (select s.*, exists (select 1 from x where x.tx = s.tx and s.pos between start_pos and end_pos) as exonic from s),
       r as (select *, row_number() over (partition by tx, exonic order by md5(concat('1005|', tx, '|', pos)), pos) as k from m),
       c as (select r.*, b.base as ref, a.alt, row_number() over (partition by r.tx, r.pos order by md5(concat('1005|', tx, '|', r.pos, '|', a.alt))) as j
         from r join fx_base b on b.pos = r.pos join (select unnest(['A', 'C', 'G', 'T']) as alt) a on a.alt <> b.base where k <= 20)
       select '11' as chrom, strand, tx as transcript_id, pos, exonic, ref, alt from c where j = 1""")
def _(t):
    gtf = with_gtf_ids(t("fx_gtf")).withColumn("chrom", F.lit("11"))
    return S.sample_positions(gtf, t("fx_base"), 40)
