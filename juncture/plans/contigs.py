"""Plans over three contigs with equal positions: the contig is part of every key."""

from pyspark.sql import functions as F

from juncture.operators import annotation as A
from juncture.operators import reference as R
from juncture.plans.registry import query

KEYS = "chrom:s pos:i ref:s alt:s"
VAR = ["pos", "ref", "alt"]


@query("merge_population_contigs", f"{KEYS} score:d n_alt_v2:i n_allele_v2:i n_homo_v2:i",
       """select s.chrom, s.pos, s.ref, s.alt, score, n_alt as n_alt_v2, n_allele as n_allele_v2, n_homo as n_homo_v2 from fx_scores_c s
       left join fx_freq_c f on s.chrom = f.chrom and s.pos = f.pos and s.ref = f.ref and s.alt = f.alt""")
def _(t):
    # one side spells the contig with a prefix
    freq = t("fx_freq_c").withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    return A.merge_population(t("fx_scores_c").drop("k"), freq, VAR, "v2")


@query("merge_versions_contigs", f"{KEYS} n_alt:i n_allele:i n_homo:i",
       """select chrom, pos, ref, alt, sum(n_alt) as n_alt, sum(n_allele) as n_allele, sum(n_homo) as n_homo from (
         select * from fx_freq_c where n_alt < 7 union all select * from fx_freq_c where n_alt > 3) group by 1, 2, 3, 4""")
def _(t):
    return A.merge_versions(t("fx_freq_c").filter("n_alt < 7"), t("fx_freq_c").filter("n_alt > 3"), ["chrom", *VAR])


@query("reference_windows_contigs", f"{KEYS} around:s",
       """select v.chrom, v.pos, v.ref, v.alt, string_agg(coalesce(b.base, 'N'), '' order by d) as around
       from fx_scores_c v cross join (select unnest(range(-30, 41)) as d) k left join fx_base_c b on b.chrom = v.chrom and b.pos = v.pos + d group by 1, 2, 3, 4""")
def _(t):
    return R.with_window(t("fx_scores_c"), R.reference_chunks(t("fx_base_c")), 30, 40, "around")


@query("variant_spans_contigs", "exon:s chrom:s seq:s",
       "select exon, e.chrom, string_agg(coalesce(b.base, 'N'), '' order by p) as seq from (select *, unnest(range(start_pos, end_pos + 1)) as p from fx_exons_c) e left join fx_base_c b on b.chrom = e.chrom and b.pos = e.p group by 1, 2")
def _(t):
    return R.with_span(t("fx_exons_c"), R.reference_chunks(t("fx_base_c")), "start_pos", "end_pos", "seq")


@query("all_snvs_contigs", f"exon:s {KEYS}",
       """select exon, e.chrom, b.pos, b.base as ref, a.alt from fx_exons_c e join fx_base_c b on b.chrom = e.chrom and b.pos between e.start_pos and e.end_pos
       join (select unnest(['A', 'C', 'G', 'T']) as alt) a on a.alt <> b.base""")
def _(t):
    return A.all_snvs(t("fx_exons_c").withColumn("start_pos", F.col("start_pos") - 1), t("fx_base_c"))


@query("interval_filter_contigs", f"{KEYS} k:i",
       "select v.chrom, v.pos, v.ref, v.alt, v.k from fx_scores_c v where exists (select 1 from fx_exons_c e where e.chrom = v.chrom and v.pos between e.start_pos and e.end_pos)")
def _(t):
    return A.interval_filter(t("fx_scores_c"), t("fx_exons_c").withColumn("start_pos", F.col("start_pos") - 1), width=16)


@query("nearest_exon_contigs", f"{KEYS} strand:s dist:i exon_start_pos:i exon_end_pos:i",
       """select * from (select v.*, e.start_pos as exon_start_pos, e.end_pos as exon_end_pos, greatest(e.start_pos - v.pos, v.pos - e.end_pos, 0) as dist,
         row_number() over (partition by v.chrom, v.pos, v.ref, v.alt order by greatest(e.start_pos - v.pos, v.pos - e.end_pos, 0), e.start_pos) as n
       from (select *, case when pos % 2 = 0 then '+' else '-' end as strand from fx_scores_c) v join fx_exons_c e on e.chrom = v.chrom and e.strand = v.strand) where n = 1""")
def _(t):
    variants = t("fx_scores_c").withColumn("strand", F.when(F.col("pos") % 2 == 0, "+").otherwise("-"))
    return A.nearest_exon(variants, t("fx_exons_c").select("chrom", "strand", "start_pos", "end_pos"), width=64)
