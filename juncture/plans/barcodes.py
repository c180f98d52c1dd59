"""Plans of the barcode-to-variant section."""

from pyspark.sql import functions as F

from juncture.functions.variants import parse_variant
from juncture.operators import barcodes as B
from juncture.plans.registry import query

ISOS = ["iso_full", "iso_short", "iso_skip"]
SAMPLES = ["S0", "S1", "S2", "S3"]
KEYS = ["chrom", "pos", "ref", "alt"]

_SA = "chrom:s pos:i ref:s alt:s"
_SPLIT = """split_part(variant_list, ':', 1) as chrom, cast(split_part(variant_list, ':', 2) as int) as pos,
       split_part(variant_list, ':', 3) as ref, split_part(variant_list, ':', 4) as alt"""


@query("parse_variant", f"barcode:s {_SA}",
       f"""select barcode, {_SPLIT} from (
           select barcode, unnest(string_split(concat(variant_list, ',', variant_list), ',')) as variant_list from fx_subasm)""")
def _(t):
    two = t("fx_subasm").withColumn("variant_list", F.concat_ws(",", "variant_list", "variant_list"))
    return parse_variant(two)


@query("snv_only", f"{_SA} score_a:d",
       "select * from (select chrom, pos, ref, case when pos % 4 = 0 then concat(alt, 'A') else alt end as alt, score_a from fx_scores) "
       "where len(ref) = 1 and len(alt) = 1")
def _(t):
    mixed = t("fx_scores").withColumn("alt", F.when(F.col("pos") % 4 == 0, F.concat("alt", F.lit("A"))).otherwise(F.col("alt")))
    return B.snv_only(mixed)


@query("subassembly_snvs", f"barcode:s variant_list:s {_SA}",
       f"select barcode, variant_list, {_SPLIT} from fx_subasm where n_variants_passing = 1 "
       "and length(split_part(variant_list, ':', 3)) = 1 and length(split_part(variant_list, ':', 4)) = 1")
def _(t):
    return B.subassembly_snvs(t("fx_subasm"))


@query("barcode_length_filter", "p_name:s p_partkey:i", "select p_name, p_partkey from part where length(p_name) <= 8")
def _(t):
    return B.barcode_length_filter(t("part"), 8, "p_name")


@query("barcode_isoform_counts",
       "barcode:s num_reads:i unmapped_reads:i bad_starts:i bad_ends:i soft_clipped:i other_isoform:i usable_reads:i FULL:i SHORT:i SKIP:i",
       "select barcode, num_reads, unmapped_reads, bad_starts, bad_ends, soft_clipped, other_isoform, usable_reads, "
       'iso_full as "FULL", iso_short as "SHORT", iso_skip as "SKIP" from fx_bc')
def _(t):
    return B.barcode_isoform_counts(t("fx_reads_bc"), t("fx_isonames"), ["FULL", "SHORT", "SKIP"])


@query("combine_isoform_groups", "barcode:s group:s usable_reads:i n:i psi:d",
       """select barcode, g.name as "group", usable_reads, case g.name when 'EXON' then iso_full + iso_short else iso_skip end as n,
       case when usable_reads = 0 then 0 else (case g.name when 'EXON' then iso_full + iso_short else iso_skip end) / (usable_reads * 1e0) end as psi
       from fx_bc, (select 'EXON' as name union all select 'NONE') g""")
def _(t):
    bc = t("fx_bc")
    long = B.unpivot(bc, ["barcode"], ISOS, "isoform", "n").filter("n > 0")
    mapping = t.spark.sql("select * from values ('iso_full', 'EXON'), ('iso_short', 'EXON'), ('iso_skip', 'NONE') as m(isoform, `group`)")
    return B.combine_isoform_groups(long, bc, mapping, tasks=t.tasks("lineitem"))


@query("add_unmapped_barcodes", "barcode:s num_reads:i unmapped_reads:i",
       """select b.barcode, b.num_reads + coalesce(u.n, 0) as num_reads, coalesce(u.n, 0) as unmapped_reads
       from fx_bc b left join (select barcode, count(*) as n from fx_reads where status = 'unmapped' group by barcode) u
       on b.barcode = u.barcode""")
def _(t):
    names = t("fx_reads").filter("status = 'unmapped'").select(F.concat("qname", F.lit("_BC="), "barcode").alias("name"))
    return B.add_unmapped_barcodes(t("fx_bc"), names)


@query("join_subassembly_rna", "barcode:s n_variants_passing:i variant_list:s status_subasm:s status_rna:s num_reads:i usable_reads:i",
       """select s.barcode, n_variants_passing, variant_list, s.status as status_subasm, 'rna' as status_rna, num_reads, usable_reads
       from fx_subasm s join fx_bc b on s.barcode = b.barcode""")
def _(t):
    sa = t("fx_subasm").withColumn("minbq", F.lit(20)).withColumn("nbp_ge_5", F.lit(1))
    return B.join_subassembly_rna(sa, t("fx_bc").withColumn("status", F.lit("rna")))


@query("psi", "barcode:s iso_full_psi:d iso_short_psi:d iso_skip_psi:d",
       "select barcode, " + ", ".join(f"case when usable_reads > 0 then {i} / (usable_reads * 1e0) end as {i}_psi" for i in ISOS) + " from fx_bc")
def _(t):
    return B.psi(t("fx_bc"), ISOS)


def _usage_sql(p="usable_reads > 1"):
    out = []
    for i in ISOS:
        v = f"case when {p} and usable_reads > 0 then {i} / (usable_reads * 1e0) end"
        out.append(f"avg({v}) as mean_{i}, sum(case when {p} then {i} end) / nullif(sum(case when {p} then usable_reads end) * 1e0, 0) as wmean_{i}, "
                   f"median({v}) as median_{i}")
    return ", ".join(out)


def _sum_sql(cols, p="usable_reads > 1"):
    return ", ".join(f"coalesce(sum(case when {p} then {c} end), 0) as sum_{n}" for c, n in cols.items())


def _per_sql(cols):
    return "100e0 * n_bc_passfilt / n_bc as per_bc_passfilt, 100e0 * sum_reads_passfilt / sum_reads as per_reads_passfilt, " + ", ".join(
        f"100e0 * sum_{c} / nullif(sum_reads_passfilt, 0) as per_{n}" for c, n in cols.items())


_USE = " ".join(f"{s}_{i}:d" for i in ISOS for s in ("mean", "wmean", "median"))
_HEAD = "count(*) as n_bc, sum(case when usable_reads > 1 then 1 else 0 end) as n_bc_passfilt, sum(num_reads) as sum_reads, coalesce(sum(case when usable_reads > 1 then num_reads end), 0) as sum_reads_passfilt"
_HEADC = "n_bc:i n_bc_passfilt:i sum_reads:i sum_reads_passfilt:i"
_STD_SUMS = " ".join(f"sum_{n}:i" for n in B.SUMMARY_SUMS.values())
_STD_PERS = "per_bc_passfilt:d per_reads_passfilt:d " + " ".join(f"per_{n}:d" for n in B.SUMMARY_PERCENTS.values())


def _variant_sql(sums, pers):
    return f"""select g.*, {_SPLIT.replace('variant_list', 'g.varlist')}, c.n_bc_sa, {_per_sql(pers)} from (
      select variant_list as varlist, {_HEAD}, {_sum_sql(sums)}, {_usage_sql()}
      from fx_bc b join fx_subasm s on b.barcode = s.barcode where n_variants_passing = 1 group by variant_list) g
      join (select variant_list as varlist, count(*) as n_bc_sa from fx_subasm where n_variants_passing = 1 group by variant_list) c
      on g.varlist = c.varlist"""


@query("variant_summary", f"varlist:s {_SA} {_HEADC} n_bc_sa:i {_STD_SUMS} {_USE} {_STD_PERS}", _variant_sql(B.SUMMARY_SUMS, B.SUMMARY_PERCENTS))
def _(t):
    return B.variant_summary(t("fx_subasm"), t("fx_bc"), 1, ISOS)


_PE = {c: c for c in ["usable_reads", "unmapped_reads", "bad_ends"]}


@query("variant_summary_pe",
       f"varlist:s {_SA} {_HEADC} n_bc_sa:i {' '.join(f'sum_{c}:i per_{c}:d' for c in _PE)} {_USE} per_bc_passfilt:d per_reads_passfilt:d",
       _variant_sql(_PE, _PE))
def _(t):
    return B.variant_summary_pe(t("fx_subasm"), t("fx_bc"), 1, list(_PE), ISOS)


@query("subassembly_barcode_count", "varlist:s n_bc_sa:i sample:s",
       """select l.varlist, l.sample, c.n as n_bc_sa from fx_long l join
       (select variant_list, count(*) as n from fx_subasm where n_variants_passing = 1 group by variant_list) c on c.variant_list = l.varlist""")
def _(t):
    return B.subassembly_barcode_count(t("fx_long"), t("fx_subasm"))


_WT = ", ".join(
    f"stddev_samp(case when usable_reads > 1 then {i} / (usable_reads * 1e0) end) as stdev_{i}, "
    f"sqrt(sum(case when usable_reads > 1 then usable_reads * power({i} / (usable_reads * 1e0) - (select sum({i}) / (sum(usable_reads) * 1e0) from fx_bc where usable_reads > 1), 2) end)"
    f" / (sum(case when usable_reads > 1 then usable_reads end) - 1)) as wstdev_{i}" for i in ISOS)


@query("wildtype_summary", f"chrom:s varlist:s {_HEADC} {_STD_SUMS} {_USE} {' '.join(f'stdev_{i}:d wstdev_{i}:d' for i in ISOS)} {_STD_PERS}",
       f"select '11' as chrom, 'WT' as varlist, g.*, {_per_sql(B.SUMMARY_PERCENTS)} from (select {_HEAD}, {_sum_sql(B.SUMMARY_SUMS)}, {_usage_sql()}, {_WT} from fx_bc) g")
def _(t):
    return B.wildtype_summary(t("fx_bc"), 1, ISOS, "11")


@query("variant_barcodes", f"variant_list:s {_SA} barcode:s",
       f"select variant_list, {_SPLIT}, barcode from fx_subasm where n_variants_passing = 1")
def _(t):
    return B.variant_barcodes(t("fx_subasm"))


@query("barcodes_by_status", "barcode:s qname:s",
       "select r.barcode, r.qname from fx_reads r where r.barcode in (select barcode from fx_subasm where status = 'apparently_wt_no_passing_vars')")
def _(t):
    wt = B.barcodes_by_status(t("fx_subasm"), "apparently_wt_no_passing_vars")
    return t("fx_reads").join(wt, "barcode", "left_semi")


_WIDE = [f"{s}_{c}" for s in SAMPLES for c in ("n_bc_passfilt", "wmean_skip")]


@query("replicates_wide", "varlist:s " + " ".join(f"{s}_n_bc_passfilt:i {s}_wmean_skip:d" for s in SAMPLES),
       "select varlist, " + ", ".join(f'max(case when sample = \'{s}\' then {c} end) as "{s}_{c}"' for s in SAMPLES for c in ("n_bc_passfilt", "wmean_skip"))
       + " from fx_long group by varlist")
def _(t):
    return B.replicates_wide(t("fx_long"), ["varlist"], ["n_bc_passfilt", "wmean_skip"], SAMPLES)


def _per_sample(t, drop=()):
    long = t("fx_long")
    out = {}
    for s in SAMPLES:
        df = long.filter(F.col("sample") == s).drop("sample")
        out[s] = df.drop("wmean_skip") if s in drop else df
    return out


@query("replicates_long", "varlist:s sample:s n_bc_passfilt:i wmean_skip:d", "select varlist, sample, n_bc_passfilt, wmean_skip from fx_long")
def _(t):
    return B.replicates_long(_per_sample(t))


@query("replicates_long_ragged", "varlist:s sample:s n_bc_passfilt:i wmean_skip:d",
       "select varlist, sample, n_bc_passfilt, case when sample = 'S1' then 0 else wmean_skip end as wmean_skip from fx_long")
def _(t):
    return B.replicates_long_ragged(_per_sample(t, drop=("S1",)), 0.0)


@query("across_sample_columns", "varlist:s wmean_skip_med:d wmean_full_mean:d n_bc_passfilt_sum:i sum_reads_max:i",
       "select varlist, median(wmean_skip) as wmean_skip_med, avg(wmean_full) as wmean_full_mean, sum(n_bc_passfilt) as n_bc_passfilt_sum, "
       "max(sum_reads) as sum_reads_max from fx_long group by varlist")
def _(t):
    return B.across_sample_columns(t("fx_long"), ["varlist"], ["wmean_skip"], ["wmean_full"], ["n_bc_passfilt"], ["sum_reads"])


@query("barcode_weighted_psi", "varlist:s mean_skip:d wmean_skip:d mean_full:d wmean_full:d",
       """with l as (select varlist, n_bc_passfilt as n, wmean_skip, case when sample <> 'S2' then wmean_full end as wmean_full from fx_long)
       select varlist, avg(wmean_skip) as mean_skip, sum(wmean_skip * n) / sum(n) as wmean_skip, avg(wmean_full) as mean_full,
       coalesce(sum(wmean_full * n), 0) / sum(n) as wmean_full from l group by varlist""")
def _(t):
    long = t("fx_long").withColumn("wmean_full", F.when(F.col("sample") != "S2", F.col("wmean_full")))
    return B.barcode_weighted_psi(long, ["varlist"], ["skip", "full"])


@query("sparse_long", "barcode:s column:s value:d",
       " union all ".join(f"select barcode, '{i}' as \"column\", {i} as value from fx_bc where {i} <> 0" for i in ISOS))
def _(t):
    return B.sparse_long(t("fx_bc"), ["barcode"], ISOS, 0)


def _catalog(t):
    return t("fx_isonames").select(F.concat(F.lit("iso_"), F.lower("name")).alias("isonum"), "isoform")


def _stats_sql(stat, where=""):
    return "select * from (" + " union all ".join(
        f"select '{i}' as isonum, '{i}_psi' as \"column\", (select isoform from fx_isonames where name = '{i[4:].upper()}') as isoform, "
        f"{stat}(case when usable_reads > 0 then {i} / (usable_reads * 1e0) end) as value from fx_bc" for i in ISOS) + f") {where}"


@query("nonzero_isoforms", "isonum:s column:s isoform:s value:d", _stats_sql("max", "where value > 0"))
def _(t):
    return B.nonzero_isoforms(B.psi(t("fx_bc"), ISOS), [f"{i}_psi" for i in ISOS], _catalog(t))


@query("isoform_column_stats", "isonum:s column:s isoform:s value:d", _stats_sql("avg"))
def _(t):
    return B.isoform_column_stats(B.psi(t("fx_bc"), ISOS), [f"{i}_psi" for i in ISOS], _catalog(t), "mean")


@query("low_barcode_samples", "varlist:s sample:s n_bc_passfilt:i",
       """with l as (select varlist, sample, case sample when 'S3' then 1 else n_bc_passfilt + 1 end as n_bc_passfilt from fx_long)
       select l.* from l where sample in (select sample from l group by sample having median(n_bc_passfilt) > 1)""")
def _(t):
    long = t("fx_long").withColumn("n_bc_passfilt", F.when(F.col("sample") == "S3", 1).otherwise(F.col("n_bc_passfilt") + 1))
    return B.low_barcode_samples(long, 1)


@query("read_cutoff_filter", "sample:s barcode:s usable_reads:i",
       "select sample, barcode, usable_reads from fx_bcs where usable_reads > case sample when 'S0' then 0 when 'S1' then 1 when 'S2' then 2 else 1 end")
def _(t):
    cut = t.spark.createDataFrame([("S0", 0), ("S1", 1), ("S2", 2), ("S3", 1)], "sample string, cutoff int")
    return B.read_cutoff_filter(t("fx_bcs"), cut)
