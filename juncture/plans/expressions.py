"""Plans of the scalar-expression section."""

from pyspark.sql import functions as F

from juncture.functions import coordinates as C
from juncture.functions import sequence as S
from juncture.operators import reference as R
from juncture.plans.registry import query

KEYS = "pos:i ref:s alt:s"

# reference as one text in the oracle; the first base is position 1200
ORACLE_REF = "(select string_agg(base, '' order by pos) as s from fx_base)"
CODE = "TCAG"


def at(pos, n=1):
    """Oracle text for ``n`` bases from a position inside the contig."""
    return f"substr(r.s, cast({pos} - 1199 as bigint), {n})"


CODON_SQL = f"""(select concat(a.b, c.b, d.b) as codon, substr('{S.CODE_AMINO.replace('*', 'X')}', a.i * 16 + c.i * 4 + d.i + 1, 1) as aa
  from (select i, substr('{CODE}', i + 1, 1) as b from (select unnest([0, 1, 2, 3]) as i)) a,
       (select i, substr('{CODE}', i + 1, 1) as b from (select unnest([0, 1, 2, 3]) as i)) c,
       (select i, substr('{CODE}', i + 1, 1) as b from (select unnest([0, 1, 2, 3]) as i)) d)"""


def chunks(t):
    return R.reference_chunks(t("fx_base"))


@query("reverse_complement", "doc_id:i out:s", "select doc_id, reverse(translate(text, 'ACGTNacgtn', 'TGCANtgcan')) as out from documents")
def _(t):
    return t("documents").select("doc_id", S.reverse_complement("text").alias("out"))


@query("complement", "doc_id:i out:s", "select doc_id, translate(text, 'ACGTNacgtn', 'TGCANtgcan') as out from documents")
def _(t):
    return t("documents").select("doc_id", S.complement("text").alias("out"))


@query("rna_to_dna", "doc_id:i out:s", "select doc_id, replace(replace(text, 'U', 'T'), 'u', 't') as out from documents")
def _(t):
    return t("documents").select("doc_id", S.rna_to_dna("text").alias("out"))


@query("kmers", "kmer:s n:i",
       "select kmer, count(*) as n from (select unnest(list_transform(range(1, greatest(length(text) - 2, 1)), lambda i: substr(text, i, 4))) as kmer from documents) group by kmer")
def _(t):
    return t("documents").select(F.explode(S.kmers("text", 4)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("apply_variant", f"{KEYS} window:s changed:s",
       f"""select v.pos, v.ref, v.alt, {at('v.pos - 5', 11)} as "window", concat({at('v.pos - 5', 5)}, v.alt, {at('v.pos + 1', 5)}) as changed
       from fx_scores v, {ORACLE_REF} r""")
def _(t):
    w = R.with_window(t("fx_scores"), chunks(t), 5, 5)
    return w.withColumn("changed", S.apply_variant("window", F.lit(6), "ref", "alt"))


@query("pos_to_hgvs", "pos:i ref:s alt:s hgvs:s",
       """select pos, ref, alt, case when pos < 1250 or pos > 2500 then null
       when pos < 1500 then concat('c.1355-', 1500 - pos) when pos > 1592 then concat('c.1447+', pos - 1592)
       else concat('c.', 1355 + pos - 1500) end as hgvs from fx_scores""")
def _(t):
    return t("fx_scores").withColumn("hgvs", C.pos_to_hgvs("pos", (1250, 2500), (1500, 1592), (1355, 1447)))


@query("pos_to_gdna", "pos:i alt:s plus:i minus:i",
       "select pos, alt, 32413600 - (1592 - pos) as plus, 32413600 + (1592 - pos) as minus from fx_scores")
def _(t):
    return t("fx_scores").withColumns({"plus": C.pos_to_gdna("pos", 32413600, 1592), "minus": C.pos_to_gdna("pos", 32413600, 1592, True)})


@query("vpos_to_gpos", "pos:i alt:s plus:i minus:i",
       "select pos, alt, 32413323 + pos - 1058 as plus, 32413323 + 1554 - pos as minus from fx_scores")
def _(t):
    v, g = (1058, 1554), (32413819, 32413323)
    return t("fx_scores").withColumns({"plus": C.vpos_to_gpos("pos", v, g), "minus": C.vpos_to_gpos("pos", v, g, True)})


@query("hg19_to_hg38", "hg19_pos:i hg38_pos:i alt:s",
       "select pos as hg19_pos, pos + (select max(500 + start_pos % 7) from fx_exons where gene = 'G0' and exon_num = 3) as hg38_pos, alt from fx_scores")
def _(t):
    annot = t("fx_exons").filter("gene = 'G0'").selectExpr(
        "exon_num as exon", "start_pos as start_hg19", "start_pos + 500 + start_pos % 7 as start_hg38", "10 as exon_len_hg19", "10 as exon_len_hg38")
    return C.hg19_to_hg38(t("fx_scores").withColumnRenamed("pos", "hg19_pos"), annot, 3)


@query("threshold_flag", "pos:i alt:s gt:b le:b",
       "select pos, alt, coalesce(nullif(score_a, 0.5) > 0.3, false) as gt, coalesce(nullif(score_a, 0.5) <= 0.7, false) as le from fx_scores")
def _(t):
    v = t("fx_scores").withColumn("x", F.expr("nullif(score_a, 0.5D)"))
    return v.withColumns({"gt": C.threshold_flag("x", 0.3, "gt"), "le": C.threshold_flag("x", 0.7, "le")})


@query("sdv_flag", "pos:i alt:s sdv:b sdv_up:b", "select pos, alt, abs(score_b) >= 1.5 as sdv, score_b >= 1.5 as sdv_up from fx_scores")
def _(t):
    return t("fx_scores").withColumns({"sdv": C.sdv_flag("score_b", 1.5), "sdv_up": C.sdv_flag("score_b", 1.5, False)})


@query("identify_variants", "pos:i ref:s alt:s known:b",
       "select pos, ref, alt, exists (select 1 from fx_clinical c where c.hg19_pos = s.pos and c.alt = s.alt) as known from fx_scores s")
def _(t):
    return R.identify_variants(t("fx_scores"), t("fx_clinical").withColumnRenamed("hg19_pos", "pos"), "known")


_DI = f"""(select p.pos, concat(p.base, q.base) as d from fx_base p join fx_base q on q.pos = p.pos + 1
  where p.pos >= (select min(pos) from fx_scores) and q.pos <= (select max(pos) from fx_scores))"""


@query("splice_dinucleotide_flags", f"{KEYS} wt_acc:b wt_don:b psbl_snv_acc:b psbl_snv_don:b snv_acc:b snv_don:b",
       f"""with d as (select pos, d from {_DI}),
       x as (select s.pos, s.ref, s.alt, score_a >= 0.5 as sdv,
         coalesce(bool_or(d = 'AG'), false) as wt_acc, coalesce(bool_or(d = 'GT'), false) as wt_don,
         coalesce(bool_or(case when d in ('AG', 'GT') then false when d like 'A_' then d.pos + 1 = s.pos and s.alt = 'G'
                  when d like '_G' then d.pos = s.pos and s.alt = 'A' end), false) as psbl_snv_acc,
         coalesce(bool_or(case when d in ('AG', 'GT') or d like 'A_' or d like '_G' then false when d like 'G_' then d.pos + 1 = s.pos and s.alt = 'T'
                  when d like '_T' then d.pos = s.pos and s.alt = 'G' end), false) as psbl_snv_don
         from fx_scores s left join d on d.pos = s.pos or d.pos + 1 = s.pos group by s.pos, s.ref, s.alt, score_a)
       select *, sdv and psbl_snv_acc as snv_acc, sdv and psbl_snv_don as snv_don from x""")
def _(t):
    v = t("fx_scores").withColumn("sdv", C.sdv_flag("score_a", 0.5))
    return R.splice_dinucleotide_flags(v, chunks(t), "sdv")


def _created_sql(rev):
    if not rev:
        return """(alt = 'A' and n.base = 'G') or (alt = 'G' and p.base = 'A') as {a}, (alt = 'T' and p.base = 'G') or (alt = 'G' and n.base = 'T') as {d}"""
    return """(alt = 'T' and p.base = 'C') or (alt = 'C' and n.base = 'T') as {a}, (alt = 'A' and n.base = 'C') or (alt = 'C' and p.base = 'A') as {d}"""


@query("created_site_flags", f"{KEYS} acc:b don:b acc_rev:b don_rev:b",
       f"""select s.pos, s.ref, s.alt, {_created_sql(False).format(a='acc', d='don')}, {_created_sql(True).format(a='acc_rev', d='don_rev')}
       from fx_scores s join fx_base p on p.pos = s.pos - 1 join fx_base n on n.pos = s.pos + 1""")
def _(t):
    c = chunks(t)
    plus = R.created_site_flags(t("fx_scores"), c, False, ("acc", "don"))
    return R.created_site_flags(plus, c, True, ("acc_rev", "don_rev"))


@query("frameshift_flag", f"{KEYS} frameshift_acc:b frameshift_don:b",
       """select pos, ref, alt,
       score_a >= 0.3 and ((alt = 'A' and (3000 - pos - 2) % 3 <> 0) or (alt = 'G' and (3000 - pos - 1) % 3 <> 0)) as frameshift_acc,
       score_b >= 0 and ((alt = 'G' and (1200 - pos - 1) % 3 <> 0) or (alt = 'T' and (1200 - pos) % 3 <> 0)) as frameshift_don from fx_scores""")
def _(t):
    v = t("fx_scores").withColumns({"a": F.col("score_a") >= 0.3, "d": F.col("score_b") >= 0})
    return R.frameshift_flag(R.frameshift_flag(v, "a", 3000, True), "d", 1200, False)


@query("motif_positions", "pos:i alt:s acceptors:s donors:s",
       f"""select v.pos, v.alt,
       concat('0,0,', array_to_string(list_transform(range(1, 30), lambda i: case when substr({at('v.pos - 15', 31)}, i, 2) = 'AG' then 1 else 0 end), ',')) as acceptors,
       concat(array_to_string(list_transform(range(2, 31), lambda i: case when substr({at('v.pos - 15', 31)}, i, 2) = 'GT' then 1 else 0 end), ','), ',0') as donors
       from fx_scores v, {ORACLE_REF} r""")
def _(t):
    w = R.with_window(t("fx_scores"), chunks(t), 15, 15)
    return w.withColumns({
        "acceptors": F.array_join(S.motif_positions("window", "AG", 2).cast("array<string>"), ","),
        "donors": F.array_join(S.motif_positions("window", "GT", -1).cast("array<string>"), ","),
    })


EXON, FRAME = (1400, 2403), 1
_C0 = f"(v.pos - (v.pos - {EXON[0] + FRAME}) % 3)"
_CONSEQ = f"""(select v.pos, v.ref, v.alt, score_a,
    case when v.pos between {EXON[0] + FRAME} and {EXON[1]} and {_C0} + 2 <= {EXON[1]} then
      (select aa from {CODON_SQL} k where k.codon = {at(_C0, 3)}) end as ref_aa,
    case when v.pos between {EXON[0]} and {EXON[0] + FRAME - 1} then 'Exonic - out of frame'
         when v.pos between {EXON[0] + FRAME} and {EXON[1] - 1} then
           case when {_C0} + 2 > {EXON[1]} then 'Exonic - out of frame' else
           (select aa from {CODON_SQL} k where k.codon = concat(substr({at(_C0, 3)}, 1, cast(v.pos - {_C0} as bigint)), v.alt,
             substr({at(_C0, 3)}, cast(v.pos - {_C0} + 2 as bigint)))) end end as alt_aa
   from fx_scores v, {ORACLE_REF} r)"""
_TYPE = "case when alt_aa is null then 'Intronic' when alt_aa = 'Exonic - out of frame' then alt_aa when ref_aa = alt_aa then 'Synonymous' when alt_aa = 'X' then 'Nonsense' else 'Missense' end"


@query("reference_codon", f"{KEYS} ref_aa:s", f"select pos, ref, alt, ref_aa from {_CONSEQ}")
def _(t):
    return R.reference_codon(t("fx_scores"), chunks(t), EXON, FRAME)


@query("alternate_codon", f"{KEYS} alt_aa:s", f"select pos, ref, alt, alt_aa from {_CONSEQ}")
def _(t):
    return R.alternate_codon(t("fx_scores"), chunks(t), EXON, FRAME)


@query("variant_consequence", f"{KEYS} ref_aa:s alt_aa:s var_type:s", f"select pos, ref, alt, ref_aa, alt_aa, {_TYPE} as var_type from {_CONSEQ}")
def _(t):
    return R.variant_consequence(t("fx_scores"), chunks(t), EXON, FRAME)


@query("sdv_by_region", f"{KEYS} sdv_exon:b sdv_intron:b",
       f"select pos, ref, alt, score_a >= 0.5 and {_TYPE} <> 'Intronic' as sdv_exon, score_a >= 0.5 and {_TYPE} = 'Intronic' as sdv_intron from {_CONSEQ}")
def _(t):
    v = R.variant_consequence(t("fx_scores"), chunks(t), EXON, FRAME)
    return R.sdv_by_region(v.withColumn("sdv", C.sdv_flag("score_a", 0.5)))


@query("translate_sequence", "pos:i alt:s protein:s",
       f"""select v.pos, v.alt, concat({', '.join(f"(select replace(aa, 'X', '_') from {CODON_SQL} k where k.codon = {at(f'v.pos - 15 + {3 * i}', 3)})" for i in range(10))}) as protein
       from fx_scores v, {ORACLE_REF} r""")
def _(t):
    w = R.with_window(t("fx_scores"), chunks(t), 15, 16)
    return w.withColumn("protein", S.translate_sequence("window"))


@query("log2_ratio", "varlist:s sample:s ratio:d", "select varlist, sample, log2((wmean_full + 0.001) / (wmean_skip + 0.001)) as ratio from fx_long")
def _(t):
    return t("fx_long").withColumn("ratio", C.log2_ratio("wmean_full", "wmean_skip"))


_LABEL = """case when c in ('Uncertain_significance', 'Conflicting_interpretations_of_pathogenicity') then 'VUS/Conflicting (CV)'
  when c like '%nign%' or a like '%nign%' then 'Benign/Likely_benign (CV/ACMG)' when c like '%ogenic%' then 'Pathogenic/Likely_pathogenic (CV)'
  when a like '%ogenic%' then 'Pathogenic/Likely_pathogenic (ACMG)' else '' end"""
_LAB = "case when s.pos % 4 = 0 then 'Benign' when s.pos % 4 = 1 then 'Likely_pathogenic' else '' end"


@query("interpretation_label", f"{KEYS} label:s",
       f"""select pos, ref, alt, {_LABEL} as label from (select s.pos, s.ref, s.alt, coalesce(c.clinvar_interp, '') as c, {_LAB} as a
       from fx_scores s left join fx_clinical c on c.hg19_pos = s.pos and c.ref = s.ref and c.alt = s.alt)""")
def _(t):
    j = t("fx_scores").alias("s").join(t("fx_clinical").withColumnRenamed("hg19_pos", "pos"), ["pos", "ref", "alt"], "left")
    return j.withColumn("a", F.expr(_LAB)).withColumn("label", C.interpretation_label("clinvar_interp", "a"))


@query("splice_site_distance", "pos:i alt:s d:i", "select pos, alt, least(abs(pos - 1267), abs(pos - 1359), abs(pos - 2000)) as d from fx_scores")
def _(t):
    return t("fx_scores").withColumn("d", C.splice_site_distance("pos", [1267, 1359, 2000]))


@query("nullsafe_row_sum", "pos:i alt:s total:d",
       "select pos, alt, case when a is null and b is null then null else coalesce(a, 0) + coalesce(b, 0) end as total from "
       "(select pos, alt, case when pos % 2 = 0 then score_a end as a, case when pos % 3 = 0 then score_b end as b from fx_scores)")
def _(t):
    v = t("fx_scores").withColumns({"a": F.expr("case when pos % 2 = 0 then score_a end"), "b": F.expr("case when pos % 3 = 0 then score_b end")})
    return v.withColumn("total", C.nullsafe_row_sum(["a", "b"]))


@query("edit_distance", "p_partkey:i d:i", "select p_partkey, levenshtein(p_name, p_type) as d from part")
def _(t):
    return t("part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"))


@query("segment_edit_distance", "gene:s exon_num:i distance:i",
       f"""with e as (select *, coalesce(sum(end_pos - start_pos + 1) over (partition by gene order by exon_num rows between unbounded preceding and 1 preceding), 0) as used from fx_exons),
       g as (select gene, min(start_pos) as s0, cast(sum(end_pos - start_pos + 1) as bigint) as n from fx_exons group by gene)
       select e.gene, e.exon_num, levenshtein({at('e.start_pos', 10)}, substr({at('g.s0 - 1', 80)}, cast(e.used + 1 as bigint), 10)) as distance
       from e join g on e.gene = g.gene, {ORACLE_REF} r""")
def _(t):
    exons = t("fx_exons")
    genes = exons.groupBy("gene", "chrom").agg((F.min("start_pos") - 1).alias("pos"))
    reads = R.with_window(genes, chunks(t), 0, 79, "seq")
    return R.segment_edit_distance(reads, exons, chunks(t), "gene")


@query("parse_isoform_text", "qname:s isoform:s", "select qname, isoform from fx_reads where isoform is not null")
def _(t):
    text = F.expr("case isoform when '[]' then '()' else replace(replace(replace(isoform, '[', '('), ']', ')'), ',', ', ') end")
    tuples = t("fx_reads").filter("isoform is not null").select("qname", F.regexp_replace(text, r"\)\)$", "),)").alias("txt"))
    return tuples.select("qname", C.isoform_text(C.parse_isoform_text("txt")).alias("isoform"))
