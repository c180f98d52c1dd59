"""Plans of the join and annotation section."""

from pyspark.sql import functions as F

from juncture.operators import annotation as A
from juncture.plans.expressions import CODON_SQL, ORACLE_REF, at
from juncture.plans.registry import query
from juncture.sources.text import with_gtf_ids

KEYS = "chrom:s pos:i ref:s alt:s"
VAR = ["pos", "ref", "alt"]
HG = ["hg19_pos", "ref", "alt"]

_SNV = """(select concat(gene, '.', exon_num) as exon, e.chrom, b.pos, b.base as ref, a.alt from fx_exons e join fx_base b on b.pos between e.start_pos and e.end_pos
  join (select unnest(['A', 'C', 'G', 'T']) as alt) a on a.alt <> b.base)"""


def _exons(t):
    return t("fx_exons").withColumn("exon", F.concat_ws(".", "gene", "exon_num"))


def _snvs(t):
    return A.all_snvs(_exons(t).withColumn("start_pos", F.col("start_pos") - 1), t("fx_base"))


def transcripts(t):
    return A.transcript_annotation(with_gtf_ids(t("fx_gtf")))


def annot(t):
    return A.transcript_annotation(with_gtf_ids(t("fx_gtf")).filter("transcript_id is null or transcript_id like '%T1.2'"))


# one transcript per gene, in the oracle
ANNOT = """(select gene as name, '11' as chrom, strand, min(start_pos) - 1 as tx_start, max(end_pos) as tx_end, list(start_pos - 1 order by start_pos) as ss, list(end_pos order by start_pos) as es,
  concat(gene, 'T1.2') as transcript_id from fx_exons group by gene, strand)"""
ANNOT_ALL = f"""(select * from {ANNOT} union all select gene, '11', strand, min(start_pos) - 1, max(end_pos), list(start_pos - 1 order by start_pos), list(end_pos order by start_pos), concat(gene, 'T2.1')
  from fx_exons where exon_num % 2 = 1 group by gene, strand)"""
_STRANDED = "(select *, case when pos % 2 = 0 then '+' else '-' end as strand from fx_scores)"


def stranded(t):
    return t("fx_scores").withColumn("strand", F.when(F.col("pos") % 2 == 0, "+").otherwise("-"))


@query("all_snvs", f"exon:s {KEYS}", f"select * from {_SNV}")
def _(t):
    return _snvs(t)


@query("saturate_variants", f"exon:s {KEYS} ref_c:s alt_c:s score_a:d",
       f"""with v as (select s.*, case when gene is not null then concat(gene, '.', exon_num) end as exon from fx_scores s left join fx_exons e on s.pos between e.start_pos and e.end_pos),
       b as (select exon, min(pos) - 4 as lo, max(pos) + 4 as hi from v where exon is not null group by exon),
       i as (select b.exon, v.chrom, v.pos, v.ref, v.alt, v.score_a from b join v on v.pos between lo and hi),
       r as (select exon, min(pos) as lo, max(pos) as hi from i group by exon),
       e as (select r.exon, x.chrom, x.pos, x.base as ref, a.alt from r join fx_base x on x.pos between lo and hi join (select unnest(['A', 'C', 'G', 'T']) as alt) a on a.alt <> x.base)
       select e.*, translate(e.ref, 'ACGT', 'TGCA') as ref_c, translate(e.alt, 'ACGT', 'TGCA') as alt_c, i.score_a from e left join i on e.exon = i.exon and e.pos = i.pos and e.alt = i.alt""")
def _(t):
    s = t("fx_scores").select("chrom", "pos", "ref", "alt", "score_a")
    e = _exons(t).select("chrom", "exon", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))
    return A.saturate_variants(s.join(e, ["chrom", "pos"], "left"), t("fx_base"), distance=4, width=64)


@query("all_dnvs", "exon:s chrom:s pos:i ref:s alt:s pos2:i ref2:s alt2:s",
       f"""select a.exon, a.chrom, a.pos, a.ref, a.alt, b.pos as pos2, b.ref as ref2, b.alt as alt2 from {_SNV} a join {_SNV} b on a.exon = b.exon and a.pos < b.pos""")
def _(t):
    return A.all_dnvs(_snvs(t))


_TABLE = f"""(select e.gene as name, e.strand, row_number() over (partition by e.gene order by case when e.strand = '+' then e.start_pos else -e.start_pos end) as num, 10 as len,
   e.start_pos - 1 as s0, e.end_pos as e0, {at('e.start_pos', 10)} as raw from fx_exons e, {ORACLE_REF} r)"""
_TABLE2 = f"""(select name, strand, num, len, s0 + case when num = 1 and strand = '+' then 1 else 0 end as gdna_start, e0 - case when num = 1 and strand = '-' then 1 else 0 end as gdna_end,
   case when strand = '-' then reverse(translate(raw, 'ACGT', 'TGCA')) else raw end as seq, (num - 1) * 10 as ccds_start from {_TABLE})"""


def exon_tbl(t):
    from juncture.operators.reference import reference_chunks, with_window

    rows = with_window(t("fx_exons").withColumn("pos", F.col("start_pos")), reference_chunks(t("fx_base")), 0, 9, "seq")
    last = t("fx_exons").groupBy("gene").agg(F.max("exon_num").alias("n"))
    rows = rows.join(last, "gene")
    num = F.when(F.col("strand") == "+", F.col("exon_num")).otherwise(F.col("n") + 1 - F.col("exon_num"))
    return A.exon_table(rows.select(F.col("gene").alias("name"), num.alias("num"), "seq"), annot(t), utr5=1)


@query("exon_table", "name:s num:i len:i gdna_start:i gdna_end:i seq:s ccds_start:i", f"select * from {_TABLE2}")
def _(t):
    return exon_tbl(t)


@query("codon_substitutions", "name:s aa_num:i ref_aa:s alt_aa:s codon:s sub:s pos:i ref:s alt:s haplotype:s",
       f"""with e as (select * from {_TABLE2}), s as (select name, strand, string_agg(seq, '' order by num) as cds from e group by 1, 2),
       c as (select name, strand, unnest(range(length(cds) // 3)) as i, cds from s), k as (select name, strand, i, substr(cds, i * 3 + 1, 3) as codon from c),
       p as (select k.*, m.codon as sub, m.aa as alt_aa, n.aa as ref_aa from k join {CODON_SQL} m on m.codon <> k.codon join {CODON_SQL} n on n.codon = k.codon),
       j as (select p.*, unnest([0, 1, 2]) as j from p),
       d as (select *, i * 3 + j as cur from j where substr(codon, j + 1, 1) <> substr(sub, j + 1, 1)),
       g as (select d.*, case when d.strand = '-' then e.gdna_end - (cur - ccds_start) else e.gdna_start + 1 + cur - ccds_start end as gpos,
           case when d.strand = '-' then translate(substr(codon, j + 1, 1), 'ACGT', 'TGCA') else substr(codon, j + 1, 1) end as r,
           case when d.strand = '-' then translate(substr(sub, j + 1, 1), 'ACGT', 'TGCA') else substr(sub, j + 1, 1) end as a
         from d join e on e.name = d.name and e.ccds_start <= cur and cur < e.ccds_start + e.len),
       f as (select *, row_number() over (partition by name, i, sub order by j) as k, first_value(gpos) over (partition by name, i, sub order by j) as g0 from g)
       select name, i + 1 as aa_num, any_value(ref_aa) as ref_aa, any_value(alt_aa) as alt_aa, any_value(codon) as codon, sub, max(gpos) filter (where k = 1) as pos, max(r) filter (where k = 1) as ref,
         max(a) filter (where k = 1) as alt, coalesce(string_agg(case when gpos < g0 + 1 then concat(gpos, ':', r, ':', a) else 'skip' end, ',' order by j) filter (where k > 1), '') as haplotype
       from f group by name, i, sub""")
def _(t):
    return A.codon_substitutions(exon_tbl(t), 1)


@query("exon_region", "gene:s chrom:s start_pos:i end_pos:i",
       """with n as (select *, row_number() over (partition by gene order by start_pos desc) as k from fx_exons)
       select gene, chrom, greatest(min(start_pos) - 1210, 0) as start_pos, least(max(end_pos) + 1210, (select max(end_pos) from fx_exons)) as end_pos from n where k between 2 and 5 group by 1, 2""")
def _(t):
    return A.exon_region(t("fx_exons"), (2, 5), 1210, rev=True)


_HIT = f"(select v.*, a.* exclude (chrom, strand) from {_STRANDED} v join {ANNOT_ALL} a on a.chrom = v.chrom and a.strand = v.strand and v.pos between a.tx_start and a.tx_end)"


@query("gene_flank_overhang", f"transcript_id:s {KEYS} name:s left_out:i right_out:i",
       f"select transcript_id, chrom, pos, ref, alt, name, greatest(50 - (pos - tx_start - 1), 0) as left_out, greatest(50 - (tx_end - pos), 0) as right_out from {_HIT}")
def _(t):
    return A.gene_flank_overhang(stranded(t), transcripts(t), 50)


def _near(expr):
    return f"(select arg_min(x, row(abs(x), x)) from (select unnest({expr}) as x))"


@query("nearest_exon_boundaries", f"transcript_id:s {KEYS} acceptor:i donor:i",
       f"""with h as (select *, list_transform(ss, lambda s: s + 1 - pos) as ds, list_transform(es, lambda e: e - pos) as de from {_HIT}),
       m as (select *, list_sort(list_transform(ds, lambda x: {{'a': abs(x), 'x': x}}))[1].x as s, list_sort(list_transform(de, lambda x: {{'a': abs(x), 'x': x}}))[1].x as e from h)
       select transcript_id, chrom, pos, ref, alt, case when strand = '-' then e else s end as acceptor, case when strand = '-' then s else e end as donor from m""")
def _(t):
    return A.nearest_exon_boundaries(stranded(t), transcripts(t))


@query("boundaries_in_window", f"transcript_id:s {KEYS} acceptors:s donors:s acceptor_pos:s",
       f"""with h as (select *, list_filter(list_transform(ss, lambda s: s + 1), lambda s: abs(s - pos) <= 30) as s, list_filter(es, lambda e: abs(e - pos) <= 30) as e from {_HIT}),
       g as (select *, case when strand = '-' then e else s end as acc, case when strand = '-' then s else e end as don from h)
       select transcript_id, chrom, pos, ref, alt, array_to_string(list_transform(acc, lambda x: x - pos), ',') as acceptors, array_to_string(list_transform(don, lambda x: x - pos), ',') as donors,
         array_to_string(acc, ',') as acceptor_pos from g""")
def _(t):
    d = A.boundaries_in_window(stranded(t), transcripts(t), 30)
    p = A.boundaries_in_window(stranded(t), transcripts(t), 30, True).select("transcript_id", "chrom", "pos", "ref", "alt", F.col("acceptors").alias("acceptor_pos"))
    out = d.join(p, ["transcript_id", "chrom", *VAR])
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("acceptors", "donors", "acceptor_pos")})


@query("nearest_exon", f"{KEYS} strand:s dist:i exon_start_pos:i exon_end_pos:i",
       f"""select * from (select v.*, e.start_pos as exon_start_pos, e.end_pos as exon_end_pos, greatest(e.start_pos - v.pos, v.pos - e.end_pos, 0) as dist,
         row_number() over (partition by v.pos, v.ref, v.alt order by greatest(e.start_pos - v.pos, v.pos - e.end_pos, 0), e.start_pos) as k
       from {_STRANDED} v join fx_exons e on e.strand = v.strand) where k = 1""")
def _(t):
    return A.nearest_exon(stranded(t), t("fx_exons").select("chrom", "strand", "start_pos", "end_pos"), width=64)


@query("annotate_exon", f"{KEYS} strand:s nearest_bd:i exon:b exon_start:i exon_end:i",
       """with n as (select v.chrom, v.pos, v.ref, v.alt, e.strand, least(abs(e.start_pos - v.pos), abs(e.end_pos - v.pos)) as nearest_bd,
         row_number() over (partition by v.pos, v.ref, v.alt order by least(abs(e.start_pos - v.pos), abs(e.end_pos - v.pos)), e.start_pos) as k from fx_scores v, fx_exons e)
       select n.chrom, n.pos, n.ref, n.alt, n.strand, nearest_bd, x.start_pos is not null as exon, x.start_pos - 1 as exon_start, x.end_pos as exon_end
       from n left join fx_exons x on n.pos between x.start_pos and x.end_pos where k = 1""")
def _(t):
    return A.annotate_exon(t("fx_scores").select("chrom", "pos", "ref", "alt"), t("fx_exons"), width=64)


@query("transcript_annotation", "transcript_id:s name:s chrom:s strand:s tx_start:i tx_end:i exon_starts:s exon_ends:s",
       f"""select transcript_id, name, chrom, strand, tx_start, tx_end, array_to_string(ss, ',') as exon_starts, array_to_string(es, ',') as exon_ends from {ANNOT}
       union all select concat(gene, 'T2.1'), gene, '11', strand, min(start_pos) - 1, max(end_pos), string_agg(start_pos - 1, ',' order by start_pos), string_agg(end_pos, ',' order by start_pos)
       from fx_exons where exon_num % 2 = 1 group by gene, strand""")
def _(t):
    out = A.transcript_annotation(with_gtf_ids(t("fx_gtf")))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("exon_starts", "exon_ends")})


@query("gene_gtf", "feature:s start_pos:i end_pos:i attribute:s",
       "select feature, start_pos, end_pos, attribute from fx_gtf where attribute like 'gene_id \"G0%' and (feature = 'gene' or attribute like '%transcript_id \"G0T2%')")
def _(t):
    return A.gene_gtf(with_gtf_ids(t("fx_gtf")), "G0", "G0T2")


@query("compare_annotations", "transcript_id:s same_bounds:b exon_starts_only_a:s exon_starts_only_b:s exon_ends_only_a:s exon_ends_only_b:s",
       f"""with b as (select transcript_id, tx_start + case when strand = '+' then 1 else 0 end as tx_start, tx_end, list_transform(ss, lambda s: case when s % 3 = 0 then s + 1 else s end) as ss, es from {ANNOT_ALL})
       select a.transcript_id, a.tx_start = b.tx_start and a.tx_end = b.tx_end as same_bounds,
         array_to_string(list_sort(list_filter(a.ss, lambda s: not list_contains(b.ss, s))), ',') as exon_starts_only_a, array_to_string(list_sort(list_filter(b.ss, lambda s: not list_contains(a.ss, s))), ',') as exon_starts_only_b,
         '' as exon_ends_only_a, '' as exon_ends_only_b from {ANNOT_ALL} a join b on a.transcript_id = b.transcript_id""")
def _(t):
    a = transcripts(t)
    b = a.withColumns({"tx_start": F.col("tx_start") + F.when(F.col("strand") == "+", 1).otherwise(0),
                       "exon_starts": F.transform("exon_starts", lambda s: F.when(s % 3 == 0, s + 1).otherwise(s))})
    out = A.compare_annotations(a, b, "transcript_id")
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in out.columns if c.startswith("exon")})


_INDEL = "(select chrom, pos, case when pos % 5 = 0 then concat(ref, 'AAAAAAAA') else ref end as ref, alt from fx_scores)"


@query("interval_filter", KEYS,
       f"select * from {_INDEL} v where exists (select 1 from fx_exons e where v.pos - 1 < e.end_pos and v.pos - 1 + length(v.ref) > e.start_pos - 1)")
def _(t):
    v = t("fx_scores").select("chrom", "pos", F.when(F.col("pos") % 5 == 0, F.concat("ref", F.lit("AAAAAAAA"))).otherwise(F.col("ref")).alias("ref"), "alt")
    return A.interval_filter(v, t("fx_exons").withColumn("start_pos", F.col("start_pos") - 1), width=16)


@query("position_intersect_merge", f"{KEYS} n_alt:i score_a:d",
       """with b as (select * from fx_scores where score_a >= 0.1 or score_a / 2 >= 0.1), a as (select * from fx_freq_v2 where n_alt > 3)
       select coalesce(x.chrom, y.chrom) as chrom, coalesce(x.pos, y.pos) as pos, coalesce(x.ref, y.ref) as ref, coalesce(x.alt, y.alt) as alt, x.n_alt, y.score_a
       from (select * from a where pos in (select pos from b)) x full join (select * from b where pos in (select pos from a)) y on x.pos = y.pos and x.ref = y.ref and x.alt = y.alt""")
def _(t):
    b = t("fx_scores").select("chrom", "pos", "ref", "alt", "score_a").withColumn("scores", F.array("score_a", F.col("score_a") / 2))
    return A.position_intersect_merge(t("fx_freq_v2").filter("n_alt > 3").select("chrom", "pos", "ref", "alt", "n_alt"), b)


_BG = "(select chrom, unnest(range(start_pos + 1, end_pos + 1)) as pos, value from fx_bedgraph)"


@query("expand_bedgraph", "chrom:s pos:i value:d", f"select * from {_BG}")
def _(t):
    return A.expand_bedgraph(t("fx_bedgraph"))


@query("merge_conservation", f"{KEYS} value:d", f"select s.chrom, s.pos, s.ref, s.alt, b.value from fx_scores s left join {_BG} b on b.pos = s.pos")
def _(t):
    return A.merge_conservation(t("fx_scores"), A.expand_bedgraph(t("fx_bedgraph")))


_J = "s.pos = {0}.pos and s.ref = {0}.ref and s.alt = {0}.alt"
_POP = f"""(select s.*, f.n_alt as n_alt_v2, f.n_allele as n_allele_v2, f.n_homo as n_homo_v2, g.n_alt as n_alt_v3, g.n_allele as n_allele_v3 from fx_scores s
  left join fx_freq_v2 f on {_J.format('f')} left join fx_freq_v3 g on {_J.format('g')})"""


def _population(t):
    two = A.merge_population(t("fx_scores"), t("fx_freq_v2"), VAR, "v2")
    return A.merge_population(two, t("fx_freq_v3"), VAR, "v3")


@query("merge_population", f"{KEYS} n_alt_v2:i n_allele_v2:i n_homo_v2:i n_alt_v3:i", f"select * from {_POP}")
def _(t):
    return _population(t)


@query("merge_versions", f"{KEYS} n_alt:i n_allele:i n_homo:i alt_AF:d",
       """select *, n_alt / (n_allele * 1e0) as "alt_AF" from (select chrom, pos, ref, alt, sum(n_alt) as n_alt, sum(n_allele) as n_allele, sum(n_homo) as n_homo
       from (select * from fx_freq_v2 union all select * from fx_freq_v3) group by 1, 2, 3, 4)""")
def _(t):
    return A.merge_versions(t("fx_freq_v2"), t("fx_freq_v3"), ["chrom", *VAR])


@query("population_flag", f"{KEYS} listed:b seen:b max_af:d",
       f"""select chrom, pos, ref, alt, n_allele_v2 is not null or n_allele_v3 is not null as listed, coalesce(n_alt_v2 > 0, false) or coalesce(n_alt_v3 > 0, false) as seen,
       greatest(n_alt_v2 / (n_allele_v2 * 1e0), n_alt_v3 / (n_allele_v3 * 1e0)) as max_af from {_POP}""")
def _(t):
    return A.population_flag(_population(t))


@query("merge_clinical", "hg19_pos:i ref:s alt:s score_a:d clinvar_interp:s clinvar:b",
       "select s.pos as hg19_pos, s.ref, s.alt, s.score_a, c.clinvar_interp, c.hg19_pos is not null as clinvar from fx_scores s left join fx_clinical c on c.hg19_pos = s.pos and c.ref = s.ref and c.alt = s.alt")
def _(t):
    return A.merge_clinical(t("fx_scores").withColumnRenamed("pos", "hg19_pos"), t("fx_clinical"), HG)


_TBV = "fx_tbv"


@query("merge_scores", f"{KEYS} sample:s wmean_skip:d score_a:d score_b:d",
       f"select v.*, s.score_a, s.score_b from fx_tbv v left join (select * from fx_scores where score_b > -1.5) s on {_J.format('v')}")
def _(t):
    return A.merge_scores(t("fx_tbv"), t("fx_scores").filter("score_b > -1.5"), ["chrom", *VAR])


@query("merge_splice_scores_full", f"{KEYS} sample:s wmean_skip:d score_b:d",
       f"select v.*, s.score_b from {_TBV} v left join (select * from fx_scores where score_b < 1.2) s on {_J.format('v')}")
def _(t):
    return A.merge_splice_scores_full(t("fx_tbv"), t("fx_scores").filter("score_b < 1.2"))


@query("merge_hal", "varlist:s sample:s hal_PSI:d hal_chgPER:d",
       """select v.varlist, v.sample, s.score_a as "hal_PSI", s.score_b as "hal_chgPER" from fx_tbv v left join (select * from fx_scores where score_a < 0.6) s on v.varlist = concat_ws(':', s.chrom, s.pos, s.ref, s.alt)""")
def _(t):
    hal = t("fx_scores").filter("score_a < 0.6").select(F.concat_ws(":", "chrom", "pos", "ref", "alt").alias("VARIANT_NAME"), F.col("score_a").alias("MUT_PSI"), F.col("score_b").alias("DELTA_PSI"))
    return A.merge_hal(t("fx_tbv"), hal)


@query("merge_squirls", f"{KEYS} sample:s squirls_score:d squirls_sdv:b",
       f"select v.*, s.score_a as squirls_score, case when s.pos is not null then s.score_a >= 0.5 end as squirls_sdv from {_TBV} v left join (select * from fx_scores where score_b < 0.5) s on {_J.format('v')}")
def _(t):
    sq = t("fx_scores").selectExpr("pos", "ref", "alt", "score_a as squirls_score", "case when score_a >= 0.5 then 'pathogenic' else 'neutral' end as interpretation",
                                   "case when score_b < 0.5 then 'NM_1.2' else 'NM_7.1' end as tx_accession")
    return A.merge_squirls(t("fx_tbv"), sq, VAR, "NM_1")


def _spidex(t):
    return t("fx_scores").selectExpr("chrom as `#Chr`", "pos as Start", "pos as End", "ref as Ref", "alt as Alt", "score_b as dpsi_max_tissue", "score_a as dpsi_zscore")


@query("spidex_scores", "chrom:s hg19_pos:i ref:s alt:s spanr_chgPER_tissue:d spanr_chgZPER:d region_only:d",
       """with r as (select pos, ref, alt, score_b from fx_scores where pos > 1400 and pos <= 2300)
       select s.chrom, s.pos as hg19_pos, translate(s.ref, 'ACGT', 'TGCA') as ref, translate(s.alt, 'ACGT', 'TGCA') as alt, s.score_b as "spanr_chgPER_tissue", s.score_a as "spanr_chgZPER", r.score_b as region_only
       from fx_scores s left join r on r.pos = s.pos and r.ref = s.ref and r.alt = s.alt where s.pos in (select hg19_pos from fx_clinical)""")
def _(t):
    from juncture.functions.sequence import complement

    listed = t("fx_scores").join(t("fx_clinical").select(F.col("hg19_pos").alias("pos")).distinct(), "pos", "left_semi")
    listed = listed.select("chrom", F.col("pos").alias("hg19_pos"), complement("ref").alias("ref"), complement("alt").alias("alt"))
    by_variant = A.spidex_scores(_spidex(t), variants=listed, rev=True)
    region = A.spidex_scores(_spidex(t), "chr11", (1400, 2300), rev=True)
    return A.merge_spidex(by_variant, region.select("chrom", *HG, F.col("spanr_chgPER_tissue").alias("region_only")))


@query("merge_mmsplice", f"{KEYS} sample:s mmsplice_chgPERlogit:d mmsplice_pathogen:d mmsplice_eff:d mmsplice_trans:s",
       f"""select v.*, s.score_a + 0.5 as "mmsplice_chgPERlogit", s.score_b as mmsplice_pathogen, s.score_a as mmsplice_eff, case when s.pos is not null then 'T1.3' end as mmsplice_trans
       from {_TBV} v left join (select * from fx_scores where score_a > 0.2) s on {_J.format('v')}""")
def _(t):
    mm = t("fx_scores").filter("score_a > 0.2").withColumn("k", F.explode(F.array(F.lit(0.0), F.lit(0.5))))
    mm = mm.selectExpr("pos", "ref", "alt", "score_a + k as delta_logit_psi", "score_b - k as pathogenicity", "score_a as efficiency", "'T1.3' as transcript_id")
    other = mm.withColumn("transcript_id", F.lit("T2.1"))
    return A.merge_mmsplice(t("fx_tbv"), mm.union(other), VAR, "T1")


@query("merge_cadd", f"{KEYS} sample:s cadd_raw:d cadd_scaled:d",
       f"select v.*, s.score_a + 1 as cadd_raw, s.score_b as cadd_scaled from {_TBV} v left join (select * from fx_scores where score_a > 0.15) s on {_J.format('v')}")
def _(t):
    cadd = t("fx_scores").filter("score_a > 0.15").withColumn("k", F.explode(F.array(F.lit(0.5), F.lit(1.5))))
    cadd = cadd.selectExpr("pos as Pos", "ref as Ref", "alt as Alt", "score_a + k as RawScore", "score_b as PHRED")
    return A.merge_cadd(t("fx_tbv"), cadd, VAR)


_TRAIN = "exists (select 1 from fx_freq_v3 f where f.pos = s.pos and f.ref = s.ref and f.alt = s.alt)"


@query("mask_training", f"{KEYS} in_train:b score_a_not:d score_b_not:d",
       f"select chrom, pos, ref, alt, {_TRAIN} as in_train, case when not {_TRAIN} then score_a end as score_a_not, case when not {_TRAIN} then score_b end as score_b_not from fx_scores s")
def _(t):
    return A.mask_training(t("fx_scores"), t("fx_freq_v3"), ["score_a", "score_b"], "in_train", ["chrom", *VAR])


_BP = """(select concat('v', s.pos, s.alt) as id, s.pos as start, s.ref as ref_allele, s.alt as alt_allele, s.pos - k.k * 3 as test_site,
  (s.pos * (k.k + 2) % 17) / 1.7e1 as p_ref, case when (s.pos + k.k) % 6 <> 0 then (s.pos * (k.k + 5) % 13) / 1.3e1 end as p_alt from fx_scores s, (select unnest(range(4)) as k) k)"""
_DELTA = f"(select *, p_alt - p_ref as \"DBP\" from {_BP})"


def _bp(t):
    rows = t("fx_scores").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    both = rows.selectExpr("concat('v', pos, alt) as id", "pos as start", "ref as ref_allele", "alt as alt_allele", "pos - k * 3 as test_site",
                           "array(named_struct('s', 'REF', 'p', (pos * (k + 2) % 17) / 1.7e1), named_struct('s', 'ALT', 'p', case when (pos + k) % 6 <> 0 then (pos * (k + 5) % 13) / 1.3e1 end)) as x")
    return both.select("id", "start", "ref_allele", "alt_allele", "test_site", F.explode("x").alias("x")).select("*", F.col("x.s").alias("status"), F.col("x.p").alias("branchpoint_prob"))


@query("branchpoint_delta", "id:s start:i ref_allele:s alt_allele:s test_site:i branchpoint_prob_ref:d branchpoint_prob_alt:d DBP:d",
       f"select *, p_ref as branchpoint_prob_ref, p_alt as branchpoint_prob_alt from {_DELTA}")
def _(t):
    return A.branchpoint_delta(_bp(t))


_BMAX = f"""(select id, start as hg19_pos, ref_allele as ref, alt_allele as alt, abs("DBP") as "DBP_max", case when "DBP" > 0 then 'GAIN' else 'LOSS' end as "DBP_event", test_site - start as "DBP_POS_max"
  from (select *, row_number() over (partition by id order by abs("DBP") desc nulls last, test_site) as rk from {_DELTA}) where rk = 1)"""


@query("branchpoint_max", "id:s hg19_pos:i ref:s alt:s DBP_max:d DBP_event:s DBP_POS_max:i", f"select * from {_BMAX}")
def _(t):
    return A.branchpoint_max(A.branchpoint_delta(_bp(t)))


@query("merge_branchpoint", "hg19_pos:i ref:s alt:s sample:s wmean_skip:d DBP_max:d DBP_event:s DBP_POS_max:i wt_prob:d",
       f"""select coalesce(v.pos, b.hg19_pos) as hg19_pos, coalesce(v.ref, b.ref) as ref, coalesce(v.alt, b.alt) as alt, v.sample, v.wmean_skip, "DBP_max", "DBP_event", "DBP_POS_max", (coalesce(v.pos, b.hg19_pos) % 10) / 1e1 as wt_prob
       from {_TBV} v full join {_BMAX} b on b.hg19_pos = v.pos and b.ref = v.ref and b.alt = v.alt""")
def _(t):
    v = t("fx_tbv").withColumnRenamed("pos", "hg19_pos").select(*HG, "sample", "wmean_skip")
    wt = t("fx_base").selectExpr("pos as test_site", "(pos % 10) / 1e1 as branchpoint_prob")
    out = A.merge_branchpoint(v, A.branchpoint_max(A.branchpoint_delta(_bp(t))))
    return A.merge_wt_branchpoint(out, wt).withColumnRenamed("bp_wt_prob", "wt_prob")


_SC = ["sc_bps", "sc_ppt", "sc", "zsc_bps", "zsc_ppt", "zsc"]
_BPP = "(select concat('g', s.pos, ':', s.ref, '>', s.alt) as id, s.pos as hg19_pos, s.ref, s.alt, k.k * 7 + 3 as bp_pos, " + ", ".join(
    f"((s.pos * (k.k + {i + 2})) % {11 + i}) / 1e1 as {c}" for i, c in enumerate(_SC)) + " from fx_scores s, (select unnest(range(5)) as k) k)"
_BWT = "(select p_partkey * 7 + 3 as bp_pos, " + ", ".join(f"((p_partkey * {i + 3}) % {7 + i}) / 1e1 as {c}" for i, c in enumerate(_SC)) + " from part)"
_BDEL = f"(select v.id, v.hg19_pos, v.ref, v.alt, coalesce(v.bp_pos, w.bp_pos) as bp_pos, {', '.join(f'v.{c} - w.{c} as "DS_{c}"' for c in _SC[3:])} from {_BPP} v full join {_BWT} w on v.bp_pos = w.bp_pos)"


def _bpp(t):
    rows = t("fx_scores").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rows.selectExpr("concat('g', pos, ':', ref, '>', alt) as id", "k * 7 + 3 as bp_pos", *[f"((pos * (k + {i + 2})) % {11 + i}) / 1e1 as {c}" for i, c in enumerate(_SC)])


def _bpp_wt(t):
    return t("part").selectExpr("cast(p_partkey * 7 + 3 as int) as bp_pos", *[f"((p_partkey * {i + 3}) % {7 + i}) / 1e1 as {c}" for i, c in enumerate(_SC)])


@query("bpp_delta", "id:s hg19_pos:i ref:s alt:s bp_pos:i DS_zsc_bps:d DS_zsc_ppt:d DS_zsc:d", f"select * from {_BDEL}")
def _(t):
    return A.bpp_delta(_bpp(t), _bpp_wt(t))


def _bpp_max(c, rev=False):
    return f"""(select id, "DS_{c}" as "DS_{c}_max", 3000 {'+' if rev else '-'} bp_pos - hg19_pos as "DS_{c}_POS_max", hg19_pos, ref, alt
      from (select *, row_number() over (partition by id order by abs("DS_{c}") desc, bp_pos) as rk from {_BDEL} where id is not null) where rk = 1)"""


@query("bpp_max", "id:s hg19_pos:i ref:s alt:s " + " ".join(f"DS_{c}_max:d DS_{c}_POS_max:i" for c in _SC[3:]),
       f"""select a.*, b."DS_zsc_ppt_max", b."DS_zsc_ppt_POS_max", c."DS_zsc_max", c."DS_zsc_POS_max" from {_bpp_max('zsc_bps')} a join {_bpp_max('zsc_ppt')} b on a.id = b.id join {_bpp_max('zsc')} c on a.id = c.id""")
def _(t):
    return A.bpp_max(A.bpp_delta(_bpp(t), _bpp_wt(t)), 3000)


@query("merge_bpp", "hg19_pos:i ref:s alt:s sample:s wmean_skip:d DS_zsc_max:d DS_zsc_POS_max:i zbpp_wt:d",
       f"""with m as (select coalesce(v.pos, b.hg19_pos) as hg19_pos, coalesce(v.ref, b.ref) as ref, coalesce(v.alt, b.alt) as alt, v.sample, v.wmean_skip, b."DS_zsc_max", b."DS_zsc_POS_max"
         from {_TBV} v full join {_bpp_max('zsc', True)} b on b.hg19_pos = v.pos and b.ref = v.ref and b.alt = v.alt)
       select coalesce(m.hg19_pos, 3000 + w.bp_pos) as hg19_pos, ref, alt, sample, wmean_skip, "DS_zsc_max", "DS_zsc_POS_max", w.zsc as zbpp_wt from m full join {_BWT} w on 3000 + w.bp_pos = m.hg19_pos""")
def _(t):
    v = t("fx_tbv").withColumnRenamed("pos", "hg19_pos").select(*HG, "sample", "wmean_skip")
    wt = _bpp_wt(t)
    out = A.merge_bpp(v, A.bpp_max(A.bpp_delta(_bpp(t), wt), 3000, rev=True))
    return A.merge_bpp_wt(out, wt, 3000, rev=True)


@query("relative_junction_use", "chrom:s jn:i pext:d",
       """with b as (select distinct chrom, start_pos as jn from fx_exons), x as (select cast(1200 + p_partkey as int) as pos, case when p_partkey % 5 <> 0 and p_partkey % 97 < 40 then (p_partkey % 11) / 1.1e1 end as v from part)
       select b.chrom, b.jn, coalesce(avg(v) filter (where pos = jn), avg(v), 1) as pext from b left join x on x.pos between jn - 6 and jn + 6 group by 1, 2""")
def _(t):
    bounds = t("fx_exons").select("chrom", F.col("start_pos").alias("jn"))
    pext = t("part").selectExpr("'11' as chrom", "cast(1200 + p_partkey as int) as pos", "case when p_partkey % 5 <> 0 and p_partkey % 97 < 40 then (p_partkey % 11) / 1.1e1 end as mean_proportion")
    return A.relative_junction_use(bounds, pext, extend=6, width=32)
