"""Plans of the source and sink section: each writes a derived table as text and reads it back."""

from pyspark.sql import functions as F

from juncture.operators import reads as RD
from juncture.plans.registry import query
from juncture.sources import info as I
from juncture.sources import sinks, text

KEYS = "chrom:s pos:i ref:s alt:s"


def _text(t, df, name):
    path = sinks.shared_path(t.spark, name)
    df.write.text(path)
    return path


@query("read_subassembly", "barcode:s n_variants_passing:i variant_list:s status:s", "select barcode, n_variants_passing, variant_list, status from fx_subasm")
def _(t):
    sa = t("fx_subasm").select(F.col("barcode").alias("readgroupid"), "n_variants_passing", "variant_list", "status",
                               F.lit(90).alias("ref_target_length"), F.lit(20).alias("minbq"), F.lit(3).alias("nbp_ge_1"))
    return text.read_subassembly(t.spark, sinks.write_tsv(sa, sinks.shared_path(t.spark, "subassembly")))


@query("read_alignments", "qname:s flag:i pos:i cigar:s seq:s barcode:s hi:i is_paired:b is_unmapped:b mate_unmapped:b is_read2:b is_secondary:b",
       """select qname, flag, pos, cigar, seq, barcode, hi, flag % 2 = 1 as is_paired, (flag // 4) % 2 = 1 as is_unmapped,
       (flag // 8) % 2 = 1 as mate_unmapped, (flag // 128) % 2 = 1 as is_read2, (flag // 256) % 2 = 1 as is_secondary from fx_mates""")
def _(t):
    m = t("fx_mates")
    fields = ["qname", "flag", F.lit("vec"), "pos", F.lit("60"), "cigar", F.lit("="), F.lit("0"), F.lit("0"), "seq", F.lit("*")]
    tag = F.when(F.col("mate") == 1, F.concat(F.lit("RX:Z:"), "barcode")).otherwise(F.concat(F.lit("BC:Z:"), "barcode"))
    line = F.concat_ws("\t", *fields, F.lit("NM:i:0"), tag, F.when(F.col("hi").isNotNull(), F.concat(F.lit("HI:i:"), F.col("hi").cast("string"))))
    head = t.spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:vec\tLN:9000",)], "line string")
    return text.read_alignments(t.spark, _text(t, head.union(m.select(line.alias("line"))), "sam"))


@query("cigar_to_blocks", "qname:s mate:i blocks:s",
       r"""with ops as (select qname, mate, pos, unnest(regexp_extract_all(cigar, '(\d+)[A-Z=]', 1)) as len, unnest(regexp_extract_all(cigar, '\d+([A-Z=])', 1)) as op,
         generate_subscripts(regexp_extract_all(cigar, '(\d+)[A-Z=]', 1), 1) as k from fx_mates),
       pl as (select *, pos - 1 + coalesce(sum(case when op in ('M', '=', 'X', 'D', 'N') then cast(len as int) else 0 end)
         over (partition by qname, mate order by k rows between unbounded preceding and 1 preceding), 0) as s from ops),
       b as (select qname, mate, string_agg(concat('[', cast(s as bigint), ',', cast(s as bigint) + cast(len as int), ']'), ',' order by k) as b from pl where op in ('M', '=', 'X') group by qname, mate)
       select m.qname, m.mate, concat('[', coalesce(b.b, ''), ']') as blocks from fx_mates m left join b on m.qname = b.qname and m.mate = b.mate""")
def _(t):
    from juncture.functions.coordinates import isoform_text

    return t("fx_mates").withColumn("blocks", isoform_text(RD.cigar_to_blocks("pos", "cigar")))


@query("read_vcf", "chrom:s pos:i ref:s alt:s alt_index:i info:s",
       "select chrom, pos, ref, alt, 0 as alt_index, freq_info as info from fx_vcf union all select chrom, pos, ref, 'N', 1, freq_info from fx_vcf")
def _(t):
    head = t.spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",)], "line string")
    dot = F.lit(".")
    body = F.concat_ws("\t", "chrom", "pos", dot, "ref", "alts", dot, dot, "freq_info")
    lines = head.union(t("fx_vcf").select(body.alias("line")))
    return text.read_vcf(t.spark, _text(t, lines, "vcf"), explode_alt=True)


_F = "string_split({c}, '|')[{i}]"
_NAMES = ["accept_GAIN", "accept_LOSS", "donor_GAIN", "donor_LOSS"]
_SITE = (f"(select chrom, pos, ref, alt, " + ", ".join(f"cast({_F.format(c='site_info', i=i + 3)} as double) as \"DS_{n}\", cast({_F.format(c='site_info', i=i + 7)} as int) as \"POS_{n}\""
         for i, n in enumerate(_NAMES)) + " from fx_vcf)")
_ALL = ", ".join(f'"DS_{n}"' for n in _NAMES)


@query("parse_spliceai_info", f"{KEYS} {' '.join(f'DS_{n}:d POS_{n}:i' for n in _NAMES)} DS_max:d DS_max_type:s POS_max:i",
       f"""select *, greatest({_ALL}) as "DS_max",
       case {' '.join(f"when DS_{n} = greatest({_ALL}) then 'DS_{n}'" for n in _NAMES)} end as "DS_max_type",
       case {' '.join(f'when DS_{n} = greatest({_ALL}) then "POS_{n}"' for n in _NAMES)} end as "POS_max" from {_SITE}""")
def _(t):
    return I.parse_spliceai_info(t("fx_vcf"), "site_info")


@query("parse_gnomad_info", f"{KEYS} n_alt:i n_allele:i n_homo:i af:d",
       "select chrom, pos, ref, alt, pos % 9 as n_alt, 20000 + pos % 7 as n_allele, pos % 2 as n_homo, (pos % 9) / ((20000 + pos % 7) * 1e0) as af from fx_vcf")
def _(t):
    return I.parse_gnomad_info(t("fx_vcf"), "freq_info")


@query("parse_scap_info", f"{KEYS} scap_type:s scap_raw:d scap_sens:d scap_raw_dom:d scap_sens_rec:d scap_raw_max:d scap_sens_min:d",
       """with a as (select chrom, pos, ref, unnest(string_split(alts, ',')) as alt, string_split(unnest(string_split(class_info, ',')), ':') as f from fx_vcf),
       n as (select chrom, pos, ref, alt, f[2] as scap_type, try_cast(f[3] as double) as scap_raw, try_cast(f[4] as double) as scap_sens,
         case when f[5] = 'COMMON' then 0.9 else try_cast(f[5] as double) end as scap_raw_dom, try_cast(f[6] as double) as sd,
         try_cast(f[7] as double) as rr, try_cast(f[8] as double) as scap_sens_rec from a)
       select *, greatest(scap_raw, scap_raw_dom, rr) as scap_raw_max, least(scap_sens, sd, scap_sens_rec) as scap_sens_min from n""")
def _(t):
    v = t("fx_vcf").select("chrom", "pos", "ref", F.col("alts").alias("alt"), "class_info")
    return I.parse_scap_info(v, "class_info", 0.9)


@query("parse_pangolin_info", f"{KEYS} pang_incr:d pang_incr_pos:i pang_decr:d pang_decr_pos:i pang_max:d pang_max_type:s pang_max_pos:i",
       """with n as (select chrom, pos, ref, alt, cast(split_part(split_part(shift_info, '|', 2), ':', 2) as double) as pang_incr,
         cast(split_part(split_part(shift_info, '|', 2), ':', 1) as int) as pang_incr_pos, cast(split_part(split_part(shift_info, '|', 3), ':', 2) as double) as pang_decr,
         cast(split_part(split_part(shift_info, '|', 3), ':', 1) as int) as pang_decr_pos from fx_vcf where shift_info is not null)
       select *, case when abs(pang_incr) >= abs(pang_decr) then pang_incr else pang_decr end as pang_max,
         case when abs(pang_incr) >= abs(pang_decr) then 'pang_incr' else 'pang_decr' end as pang_max_type,
         case when abs(pang_incr) >= abs(pang_decr) then pang_incr_pos else pang_decr_pos end as pang_max_pos from n""")
def _(t):
    return I.parse_pangolin_info(t("fx_vcf"), "shift_info")


@query("parse_consplice_info", "chrom:s hg38_pos:i hg19_pos:i ref:s alt:s consplice:d conspliceml:d",
       """select chrom, pos as hg38_pos, pos - 31 as hg19_pos, ref, alt, (pos % 100) / 1e2 as consplice, (pos * 3 % 100) / 1e2 as conspliceml
       from fx_vcf where pos in (select 1200 + p_partkey from part)""")
def _(t):
    lift = t("fx_base").selectExpr("chrom", "pos as hg38_pos", "pos - 31 as hg19_pos")
    return I.parse_consplice_info(t("fx_vcf"), lift, "constraint_info", ("Con", "ConML"))


@query("read_gtf", "chrom:s feature:s start_pos:i end_pos:i strand:s gene_id:s transcript_id:s",
       """select chrom, feature, start_pos, end_pos, strand, regexp_extract(attribute, 'gene_id "([^"]*)"', 1) as gene_id,
       nullif(regexp_extract(attribute, 'transcript_id "([^"]*)"', 1), '') as transcript_id from fx_gtf""")
def _(t):
    g = t("fx_gtf")
    head = t.spark.createDataFrame([("#!genome-build sim",)], "line string")
    return text.read_gtf(t.spark, _text(t, head.union(g.select(F.concat_ws("\t", *g.columns))), "gtf"))


@query("read_bed", "chrom:s start_pos:i end_pos:i gene:s", "select chrom, start_pos - 1 as start_pos, end_pos, gene from fx_exons")
def _(t):
    e = t("fx_exons")
    return text.read_bed(t.spark, _text(t, e.select(F.concat_ws("\t", "chrom", F.col("start_pos") - 1, "end_pos", "gene")), "bed"))


@query("read_fasta", "name:s seq:s",
       "select e.gene as name, string_agg(b.base, '' order by b.pos) as seq from fx_exons e join fx_base b on b.pos between e.start_pos and e.end_pos group by e.gene")
def _(t):
    from juncture.operators.reference import reference_chunks, with_window

    exons = t("fx_exons").withColumn("pos", F.col("start_pos"))
    lines = with_window(exons, reference_chunks(t("fx_base")), 0, 9).groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("start_pos", "window"))).alias("x"))
    record = F.concat(F.lit(">"), F.col("gene"), F.lit(" one line per exon\n"), F.array_join(F.col("x.window"), "\n"))
    return text.read_fasta(t.spark, _text(t, lines.select(record), "fasta"))


@query("read_score_tsv", f"{KEYS} score_a:d", "select chrom, pos, ref, alt, score_a from fx_scores")
def _(t):
    path = sinks.write_tsv(t("fx_scores").select("chrom", "pos", "ref", "alt", "score_a"), sinks.shared_path(t.spark, "scores"))
    return text.read_score_tsv(t.spark, path, "chrom string, pos int, ref string, alt string, score_a double")


@query("region_scan", f"{KEYS} score_a:d", "select chrom, pos, ref, alt, score_a from fx_scores where pos > 1300 and pos <= 2300")
def _(t):
    return text.region_scan(t("fx_scores"), "chr11", 1300, 2300)


@query("write_tsv", "varlist:s sample:s sum_reads:i", "select varlist, sample, sum_reads from fx_long")
def _(t):
    path = sinks.write_tsv(t("fx_long").select("varlist", "sample", "sum_reads"), sinks.shared_path(t.spark, "long"))
    return t.spark.read.csv(path, sep="\t", header=True, schema="varlist string, sample string, sum_reads long")


_CONTIGS = " union all ".join(f"select {i + 3} as k, '##contig=<ID=chr{c},length={n}>' as line" for i, (c, n) in enumerate(sinks.GRCH37_CONTIGS.items()))


@query("write_vcf", "line:s",
       f"""select line from (select 0 as k, '##fileformat=VCFv4.2' as line union all select 1, '##fileDate=20240101' union all select 2, '##reference=GRCh37/hg19'
       union all {_CONTIGS} union all select 99, concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO'))
       union all select concat_ws(chr(9), 'chr11', pos, '.', ref, alt, '.', '.', '.') from fx_scores""")
def _(t):
    path = sinks.write_vcf(t("fx_scores"), sinks.shared_path(t.spark, "out-vcf"), "20240101", chr_prefix=True)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("partition_by_chrom", "chrom:s name:s n:i",
       "select split_part(p_brand, '#', 1) || 'x' || (p_size % 7) as chrom, split_part(p_brand, '#', 1) || 'x' || (p_size % 7) || '_' || p_partkey as name, p_size as n from part")
def _(t):
    rows = t("part").selectExpr("concat(split_part(p_brand, '#', 1), 'x', p_size % 7, '_', p_partkey) as name", "p_size as n")
    return t.spark.read.parquet(sinks.partition_by_chrom(rows, sinks.shared_path(t.spark, "junctions")))


@query("liftover_positions", "chrom:s pos:i end:i",
       'select chrom, cast(pos as int) as pos, cast(pos + 1 as int) as "end" from (select chrom, unnest(range(start_pos, end_pos + 1)) as pos from fx_exons)')
def _(t):
    return sinks.liftover_positions(t("fx_exons"))
