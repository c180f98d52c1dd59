"""Plans of the relational steps."""

from pyspark.sql import functions as F

from juncture.operators import relational as R
from juncture.plans.barcodes import SAMPLES
from juncture.plans.registry import query


@query("filter_query", "varlist:s sample:s sum_reads:i",
       "select varlist, sample, sum_reads from fx_long where n_bc_passfilt > 1 and sample in ('S0', 'S2') and varlist like '%:A:%' and wmean_skip > 0.2")
def _(t):
    keep = (F.col("n_bc_passfilt") > 1) & F.col("sample").isin("S0", "S2") & F.col("varlist").contains(":A:") & (F.col("wmean_skip") > 0.2)
    return R.filter_query(t("fx_long"), keep)


@query("rename_select", "Variant:s Sample:s Skipping:d",
       """select varlist as "Variant", case sample when 'S0' then 'HEK 1' when 'S1' then 'HEK 2' else sample end as "Sample", wmean_skip * 100 as "Skipping" from fx_long""")
def _(t):
    names = {"varlist": "Variant", "sample": "Sample", "wmean_skip": "Skipping"}
    return R.rename_select(t("fx_long"), names, {"wmean_skip": 100.0}, {"sample": {"S0": "HEK 1", "S1": "HEK 2"}})


@query("sort_topk", "sample:s barcode:s num_reads:i per_total:d",
       "select sample, barcode, num_reads, 100e0 * num_reads / (select sum(num_reads) from fx_bcs) as per_total from fx_bcs order by num_reads desc, barcode, sample limit 25")
def _(t):
    return R.sort_topk(t("fx_bcs"), [F.desc("num_reads"), F.asc("barcode"), F.asc("sample")], 25, "num_reads")


@query("group_sum_by_flag", "alt:s high:i up:i", "select alt, sum(cast(score_a >= 0.5 as int)) as high, sum(cast(score_b >= 0 as int)) as up from fx_scores group by alt")
def _(t):
    return R.group_sum_by_flag(t("fx_scores").selectExpr("alt", "score_a >= 0.5 as high", "score_b >= 0 as up"), ["alt"], ["high", "up"])


@query("distinct_difference", "pos:i", "select distinct pos from fx_scores where pos not in (select hg19_pos from fx_clinical)")
def _(t):
    return R.distinct_difference(t("fx_scores").select("pos"), t("fx_clinical").select(F.col("hg19_pos").alias("pos")))


@query("index_intersection", "barcode:s num_reads:i", "select barcode, num_reads from fx_bc where barcode in (select barcode from fx_subasm where n_variants_passing = 1)")
def _(t):
    return R.index_intersection(t("fx_bc"), t("fx_subasm").filter("n_variants_passing = 1"), ["barcode"])


@query("outer_merge_suffix", "varlist:s " + " ".join(f"sum_reads_{s}:i" for s in SAMPLES) + " total_sum_reads:i",
       "select varlist, " + ", ".join(f'sum(sum_reads) filter (where sample = \'{s}\') as "sum_reads_{s}"' for s in SAMPLES) + ", sum(sum_reads) as total_sum_reads from fx_long group by varlist")
def _(t):
    tables = {s: t("fx_long").filter(F.col("sample") == s).select("varlist", "sum_reads") for s in SAMPLES}
    return R.outer_merge_suffix(tables, ["varlist"], ["sum_reads"])


@query("wide_row_any", "pos:i alt:s sdv:b sdv_sum:i",
       "select pos, alt, coalesce(a, false) or coalesce(b, false) as sdv, coalesce(cast(a as int), 0) + coalesce(cast(b as int), 0) as sdv_sum from (select pos, alt, score_a >= 0.5 as a, nullif(score_b, 0) > 0 as b from fx_scores)")
def _(t):
    return R.wide_row_any(t("fx_scores").selectExpr("pos", "alt", "score_a >= 0.5 as sdv_a", "nullif(score_b, 0D) > 0 as sdv_b"), "sdv_", "sdv")


@query("share_of_total", "sample:s part:i total:i per:d",
       "select sample, sum(case when isoform = '[]' then 1 else 0 end) as part, count(*) as total, 100e0 * sum(case when isoform = '[]' then 1 else 0 end) / count(*) as per from fx_reads where status is null group by sample")
def _(t):
    reads = t("fx_reads").filter("status is null").withColumn("n", F.lit(1))
    return R.share_of_total(reads, F.col("isoform") == "[]", "n", ["sample"])
