"""Derived views shared by the registered queries and their oracles.

Every view is portable SQL over whole base tables, so its size grows with them.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# reference base per position of the contig: one row per part
VIEWS["fx_base"] = """
select '11' as chrom, cast(1200 + p_partkey as int) as pos,
       substr('ACGT', cast(1 + ((1200 + p_partkey) * (1200 + p_partkey) * 31 + (1200 + p_partkey) * 17 + 5)
                                % 1009 % 4 as int), 1) as base
from part"""

# subassembly, one row per barcode
VIEWS["fx_subasm"] = """
select concat('BC', lpad(cast(o_orderkey as varchar(20)), 9, '0')) as barcode,
       case when o_custkey % 7 = 0 then 2 else 1 end as n_variants_passing,
       case when o_custkey % 5 = 0 then 'apparently_wt_no_passing_vars' else 'pass' end as status,
       concat('11:', cast(b.pos as varchar(20)), ':', b.base, ':',
              substr('ACGT', cast(1 + (instr('ACGT', b.base) - 1 + 1 + o_orderkey % 3) % 4 as int), 1)) as variant_list
from orders o join fx_base b on b.pos = 1227 + o.o_custkey"""

# read pairs after normalisation; status is null for a usable isoform
VIEWS["fx_reads"] = """
select concat('BC', lpad(cast(l_orderkey as varchar(20)), 9, '0')) as barcode,
       concat('S', cast(l_suppkey % 4 as varchar(20))) as sample,
       concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20)), '-',
              cast(l_suppkey as varchar(20)), '-', cast(cast(l_quantity as int) as varchar(20))) as qname,
       case when l_partkey % 29 = 0 then 'unmapped' when l_partkey % 31 = 0 then 'bad_ends'
            when l_partkey % 37 = 0 then 'bad_starts' when l_partkey % 41 = 0 then 'soft_clipped' end as status,
       case when l_partkey % 29 = 0 or l_partkey % 31 = 0 or l_partkey % 37 = 0 or l_partkey % 41 = 0 then null
            when l_partkey % 3 = 0 then '[]' when l_partkey % 11 = 0 then '[[1236,1359]]'
            when l_partkey % 2 = 0 then '[[1267,1359]]' else '[[1267,1350]]' end as isoform
from lineitem"""

# the isoforms that have a name
VIEWS["fx_isonames"] = """
select '[[1267,1359]]' as isoform, 'FULL' as name
union all select '[[1267,1350]]', 'SHORT'
union all select '[]', 'SKIP'"""

_COUNTS = """count(*) as num_reads,
       sum(case when r.status = 'unmapped' then 1 else 0 end) as unmapped_reads,
       sum(case when r.status = 'bad_starts' then 1 else 0 end) as bad_starts,
       sum(case when r.status = 'bad_ends' then 1 else 0 end) as bad_ends,
       sum(case when r.status = 'soft_clipped' then 1 else 0 end) as soft_clipped,
       sum(case when r.status is null and n.name is null then 1 else 0 end) as other_isoform,
       sum(case when n.name is not null then 1 else 0 end) as usable_reads,
       sum(case when n.name = 'FULL' then 1 else 0 end) as iso_full,
       sum(case when n.name = 'SHORT' then 1 else 0 end) as iso_short,
       sum(case when n.name = 'SKIP' then 1 else 0 end) as iso_skip
from fx_reads r left join fx_isonames n on r.isoform = n.isoform"""

# counts per barcode, all samples together, and per sample and barcode
VIEWS["fx_bc"] = f"select barcode, {_COUNTS}\ngroup by barcode"
VIEWS["fx_bcs"] = f"select sample, barcode, {_COUNTS}\ngroup by sample, barcode"

# proteins that bind motifs, of several species
VIEWS["fx_proteins"] = """
select concat('m', cast(n_nationkey % 8 as varchar(20))) as motif, n_name as protein,
       case when n_nationkey % 3 = 0 then 'Mus_musculus' else 'Homo_sapiens' end as species
from nation where n_nationkey % 8 <> 3"""

# barcodes with lists of one to three variants; twenty customers make a group, a group belongs to one of six families
VIEWS["fx_lists"] = """
select concat('BC', lpad(cast(o_orderkey as varchar(20)), 9, '0')) as barcode, grp, fam,
       case when fam < 2 then concat('11:', cast(1227 + o_custkey as varchar(20)), ':A:', substr('CGT', cast(1 + o_orderkey % 3 as int), 1))
            when fam = 2 then concat('11:', cast(1227 + 20 * grp as varchar(20)), ':A:C')
            when fam = 3 then concat('11:', cast(1227 + 20 * grp + 3 * (o_orderkey % 3) as varchar(20)), ':A:C')
            when o_orderkey % 2 = 0 then concat('11:', cast(1227 + 20 * grp as varchar(20)), ':A:C')
            when fam = 4 then concat('11:', cast(1227 + 20 * grp as varchar(20)), ':A:C,11:', cast(1242 + 20 * grp as varchar(20)), ':A:C')
            else concat('11:', cast(1257 + 20 * grp as varchar(20)), ':A:C,11:', cast(1287 + 20 * grp as varchar(20)), ':A:C,11:', cast(1317 + 20 * grp as varchar(20)), ':A:C')
       end as variant_list
from (select o_orderkey, o_custkey, cast(floor(o_custkey / 20e0) as int) as grp, cast(floor(o_custkey / 20e0) as int) % 6 as fam from orders) o"""

# reads per sample, isoform and barcode that go with them
VIEWS["fx_list_counts"] = """
select concat('S', cast(o_custkey % 2 as varchar(20))) as sample,
       case when o_orderkey % 17 = 0 then 'unmapped' when l.fam = 0 then '[[1267,1350]]'
            when l.fam = 1 then concat('[[900,1000],[', cast(1237 + 20 * l.grp as varchar(20)), ',1359]]')
            else concat('[[', cast(9000 + l.grp as varchar(20)), ',1359]]') end as isoform,
       l.barcode, cast(1 + o_orderkey % 5 as int) as n
from orders join fx_lists l on l.barcode = concat('BC', lpad(cast(o_orderkey as varchar(20)), 9, '0'))"""

# every variant of the subassembly with two predictor scores
VIEWS["fx_scores"] = """
select distinct '11' as chrom, cast(split_part(variant_list, ':', 2) as int) as pos,
       split_part(variant_list, ':', 3) as ref, split_part(variant_list, ':', 4) as alt,
       ((cast(split_part(variant_list, ':', 2) as int) * 13 + ascii(split_part(variant_list, ':', 4)) * 7) % 100) / 1e2 as score_a,
       ((cast(split_part(variant_list, ':', 2) as int) * 29 + ascii(split_part(variant_list, ':', 4)) * 3) % 41 - 20) / 1e1 as score_b
from fx_subasm"""

VIEWS["fx_freq_v2"] = """
select chrom, pos, ref, alt, cast(1 + pos % 9 as int) as n_alt, 20000 as n_allele, cast(pos % 2 as int) as n_homo
from fx_scores where score_a < 0.35"""

VIEWS["fx_freq_v3"] = """
select chrom, pos, ref, alt, cast(1 + pos % 5 as int) as n_alt, 30000 as n_allele, 0 as n_homo
from fx_scores where score_b > 0.8"""

VIEWS["fx_clinical"] = """
select pos as hg19_pos, ref, alt,
       case pos % 3 when 0 then 'Likely_benign' when 1 then 'Pathogenic' else 'Uncertain_significance' end as clinvar_interp
from fx_scores where score_a >= 0.7 or score_b < -1.4"""

# exons: one per supplier, eight to a gene, 1-based inclusive
VIEWS["fx_exons"] = """
select concat('G', cast(cast(floor(s_suppkey / 8e0) as int) as varchar(20))) as gene, '11' as chrom,
       case when cast(floor(s_suppkey / 8e0) as int) % 2 = 0 then '+' else '-' end as strand,
       cast(1 + s_suppkey % 8 as int) as exon_num,
       cast(1204 + s_suppkey * 20 as int) as start_pos, cast(1213 + s_suppkey * 20 as int) as end_pos
from supplier"""

# bedGraph without gaps, half-open and 0-based
VIEWS["fx_bedgraph"] = """
select '11' as chrom, cast(1199 + s_suppkey * 20 as int) as start_pos, cast(1219 + s_suppkey * 20 as int) as end_pos,
       (s_suppkey * 7 % 13 - 6) / 1e0 as value
from supplier"""

VIEWS["fx_eval"] = """
select d.doc_id, l.quality = 1 as truth, d.lang as category, cast(d.n_chars as double) as pred_a,
       cast(d.n_chars % 97 - 48 as double) as pred_b
from labels l join documents d on l.doc_id = d.doc_id"""

# per-sample variant table (replicates)
VIEWS["fx_long"] = """
select x.variant_list as varlist, r.sample, count(distinct r.barcode) as n_bc_passfilt, count(*) as sum_reads,
       sum(case when r.isoform = '[]' then 1 else 0 end) / (count(*) * 1e0) as wmean_skip,
       sum(case when r.isoform = '[[1267,1359]]' then 1 else 0 end) / (count(*) * 1e0) as wmean_full
from fx_reads r join fx_subasm x on r.barcode = x.barcode
where x.n_variants_passing = 1 and r.status is null
group by x.variant_list, r.sample"""

# the same with the variant split into columns
VIEWS["fx_tbv"] = """
select varlist, split_part(varlist, ':', 1) as chrom, cast(split_part(varlist, ':', 2) as int) as pos,
       split_part(varlist, ':', 3) as ref, split_part(varlist, ':', 4) as alt,
       sample, n_bc_passfilt, sum_reads, wmean_skip, wmean_full
from fx_long"""

# barcodes far from the exon, as a null distribution
VIEWS["fx_null"] = """
select c.sample, c.barcode, c.usable_reads, c.iso_skip / (c.usable_reads * 1e0) as skip_psi, c.iso_full / (c.usable_reads * 1e0) as full_psi
from fx_bcs c join fx_subasm s on c.barcode = s.barcode
where c.usable_reads > 0 and s.n_variants_passing = 1
  and (cast(split_part(s.variant_list, ':', 2) as int) < 1300 or cast(split_part(s.variant_list, ':', 2) as int) > 1350)"""

# raw mates: two rows per line item, positions 1-based, constant exons (649,696) and (3478,3533)
VIEWS["fx_mates"] = """
select concat('BC', lpad(cast(l_orderkey as varchar(20)), 9, '0')) as barcode,
       concat('S', cast(l_suppkey % 4 as varchar(20))) as sample,
       concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20)), '-',
              cast(l_suppkey as varchar(20)), '-', cast(cast(l_quantity as int) as varchar(20))) as qname,
       m.mate,
       cast(case when l_partkey % 47 = 0 then 0 else 1 end
            + case when l_partkey % 29 = 0 then 4 else 0 end
            + case when l_partkey % 53 = 0 then 8 else 0 end
            + case when m.mate = 1 then 64 else 128 + 16 end
            + case when l_partkey % 43 = 0 then 256 else 0 end as int) as flag,
       cast(case when m.mate = 1 then (case when l_partkey % 31 = 0 then 700 else 627 end)
                 when l_partkey % 3 = 0 then 3429 else 1300 + l_partkey % 5 end as int) as pos,
       case when l_partkey % 29 = 0 then '*'
            when m.mate = 1 then
              case when l_partkey % 31 = 0 then '90M'
                   when l_partkey % 41 = 0 then '30S40M'
                   when l_partkey % 3 = 0 then (case when l_partkey % 5 = 0 then '70M2781N20M' else '70M2781N50M' end)
                   when l_partkey % 11 = 0 then '70M539N20M4D60M1I9M'
                   when l_partkey % 13 = 0 then '70M570N30M30D33M'
                   when l_partkey % 17 = 0 then concat(cast(69 - l_partkey % 3 as varchar(20)), 'M', cast(571 + l_partkey % 3 + l_partkey % 7 as varchar(20)), 'N90M')
                   else '70M570N2M1D87M3S' end
            else case when l_partkey % 3 = 0 then '48M1N52M'
                   when l_partkey % 37 = 0 then '55M'
                   when l_partkey % 2 = 0 then concat(cast(60 - l_partkey % 5 as varchar(20)), 'M', cast(2119 + l_partkey % 3 as varchar(20)), 'N50M')
                   else concat(cast(51 - l_partkey % 5 as varchar(20)), 'M2127N40M2D8M') end end as cigar,
       substr('ACGTTGCA', cast(1 + l_partkey % 4 as int), cast(3 + l_partkey % 2 as int)) as seq,
       case when l_partkey % 19 = 0 then 2 when l_partkey % 23 = 0 then 1 end as hi
from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 1 as mate from lineitem
      union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 2 as mate from lineitem) m"""

# variant pairs: each variant with a second change a few bases further on
VIEWS["fx_pairs"] = """
select s.chrom, s.pos, s.ref, s.alt, s.score_a, s.score_b, b.pos as pos2, b.base as ref2,
       substr('ACGT', cast(1 + instr('ACGT', b.base) % 4 as int), 1) as alt2
from fx_scores s join fx_base b on b.pos = s.pos + 3 + s.pos % 5"""

# three contigs with equal positions: other bases, variants, frequencies and exons on each
VIEWS["fx_contigs"] = "select '11' as chrom, 0 as k union all select '12', 1 union all select '13', 2"

VIEWS["fx_base_c"] = """
select c.chrom, b.pos, substr('ACGT', cast(1 + (instr('ACGT', b.base) - 1 + c.k * (1 + b.pos % 3)) % 4 as int), 1) as base
from fx_base b cross join fx_contigs c"""

VIEWS["fx_scores_c"] = """
select c.chrom, s.pos, substr('ACGT', cast(1 + (instr('ACGT', s.ref) - 1 + c.k * (1 + s.pos % 3)) % 4 as int), 1) as ref,
       substr('ACGT', cast(1 + (instr('ACGT', s.alt) - 1 + c.k * (1 + s.pos % 3)) % 4 as int), 1) as alt, c.k, s.score_a + c.k as score
from fx_scores s cross join fx_contigs c"""

VIEWS["fx_freq_c"] = """
select chrom, pos, ref, alt, cast(1 + (pos + 3 * k) % 9 as int) as n_alt, 20000 + k as n_allele, cast((pos + k) % 2 as int) as n_homo
from fx_scores_c where (pos + k) % 3 < 2"""

VIEWS["fx_exons_c"] = """
select c.chrom, concat(e.gene, '.', cast(e.exon_num as varchar(20)), '.', c.chrom) as exon, e.strand,
       e.start_pos + 3 * c.k as start_pos, e.end_pos + 3 * c.k as end_pos
from fx_exons e cross join fx_contigs c where e.exon_num % 3 <> c.k"""

# packed annotation text of each variant, one column per format
VIEWS["fx_vcf"] = """
select chrom, pos, ref, alt,
       concat(alt, '|G', cast(pos % 5 as varchar(20)), '|0.', lpad(cast(pos * 13 % 100 as varchar(20)), 2, '0'), '|0.', lpad(cast(pos * 29 % 100 as varchar(20)), 2, '0'),
              '|0.', lpad(cast((pos + ascii(alt)) * 17 % 100 as varchar(20)), 2, '0'), '|0.', lpad(cast(pos * 7 % 50 as varchar(20)), 2, '0'),
              '|', cast(pos % 40 - 20 as varchar(20)), '|', cast(pos % 30 as varchar(20)), '|', cast(pos % 11 - 5 as varchar(20)), '|', cast(pos % 23 as varchar(20))) as site_info,
       concat('lcr;AC=', cast(pos % 9 as varchar(20)), ';AN=', cast(20000 + pos % 7 as varchar(20)), ';nhomalt=', cast(pos % 2 as varchar(20)), ';VT=snv') as freq_info,
       concat(alt, ',N') as alts,
       concat(alt, ':type', cast(pos % 4 as varchar(20)), ':0.', lpad(cast(pos * 11 % 100 as varchar(20)), 2, '0'), ':', case when pos % 3 = 0 then '.' else '0.25' end,
              ':', case when pos % 5 = 0 then 'COMMON' else '0.5' end, ':0.1:.:0.', cast(pos % 9 as varchar(20)),
              ',N:typeN:.:.:.:.:.:.') as class_info,
       case when pos % 10 <> 0 then concat('ENS1|', cast(pos % 50 - 25 as varchar(20)), ':0.', lpad(cast(pos * 3 % 100 as varchar(20)), 2, '0'), '|',
              cast(pos % 35 - 10 as varchar(20)), ':-0.', lpad(cast(pos * 19 % 100 as varchar(20)), 2, '0'), '|Warnings') end as shift_info,
       concat('Con=g|x|0.', lpad(cast(pos % 100 as varchar(20)), 2, '0'), ';ConML=g|0.', lpad(cast(pos * 3 % 100 as varchar(20)), 2, '0')) as constraint_info
from fx_scores"""

# gene models: one gene row, two transcripts (all exons; odd exons only), their exons and coding parts
VIEWS["fx_gtf"] = """
select 'chr11' as chrom, 'sim' as source, 'gene' as feature, min(start_pos) as start_pos, max(end_pos) as end_pos, '.' as score, strand, '.' as frame,
       concat('gene_id "', gene, '"; gene_type "coding";') as attribute
from fx_exons group by gene, strand
union all
select 'chr11', 'sim', 'transcript', min(start_pos), max(end_pos), '.', strand, '.', concat('gene_id "', gene, '"; transcript_id "', gene, 'T1.2"; gene_type "coding";')
from fx_exons group by gene, strand
union all
select 'chr11', 'sim', 'transcript', min(start_pos), max(end_pos), '.', strand, '.', concat('gene_id "', gene, '"; transcript_id "', gene, 'T2.1"; gene_type "coding";')
from fx_exons where exon_num % 2 = 1 group by gene, strand
union all
select 'chr11', 'sim', 'exon', start_pos, end_pos, '.', strand, '.', concat('gene_id "', gene, '"; transcript_id "', gene, 'T1.2"; gene_type "coding";') from fx_exons
union all
select 'chr11', 'sim', 'exon', start_pos, end_pos, '.', strand, '.', concat('gene_id "', gene, '"; transcript_id "', gene, 'T2.1"; gene_type "coding";') from fx_exons where exon_num % 2 = 1
union all
select 'chr11', 'sim', 'CDS', start_pos, end_pos, '.', strand, '0', concat('gene_id "', gene, '"; transcript_id "', gene, 'T1.2"; gene_type "coding";') from fx_exons
union all
select 'chr11', 'sim', 'CDS', start_pos, end_pos, '.', strand, '0', concat('gene_id "', gene, '"; transcript_id "', gene, 'T2.1"; gene_type "coding";') from fx_exons where exon_num % 2 = 1"""

# What Spark runs in place of some views, with the same rows. Reads and barcodes are dealt over ``{tasks}`` tasks by barcode, so
# that a task's share is a number of rows and not a part of the table, and all counts per barcode are made where its reads are.
SPARK_VIEWS = VIEWS | {
    "fx_reads_bc": "select /*+ repartition({tasks}, barcode) */ * from fx_reads",
    "fx_subasm_bc": "select /*+ repartition({tasks}, barcode) */ * from fx_subasm",
    "fx_bc": VIEWS["fx_bc"].replace("from fx_reads r", "from fx_reads_bc r"),
    "fx_bcs": VIEWS["fx_bcs"].replace("from fx_reads r", "from fx_reads_bc r"),
    # one row per barcode, sample and variant before the variants are counted
    "fx_long": """
select varlist, sample, count(*) as n_bc_passfilt, sum(n) as sum_reads, sum(n_skip) / (sum(n) * 1e0) as wmean_skip, sum(n_full) / (sum(n) * 1e0) as wmean_full
from (select x.variant_list as varlist, r.sample, r.n * x.k as n, r.n_skip * x.k as n_skip, r.n_full * x.k as n_full
      from (select barcode, sample, count(*) as n, sum(case when isoform = '[]' then 1 else 0 end) as n_skip,
              sum(case when isoform = '[[1267,1359]]' then 1 else 0 end) as n_full
            from fx_reads_bc where status is null group by barcode, sample) r
      join (select barcode, variant_list, count(*) as k from fx_subasm_bc where n_variants_passing = 1 group by barcode, variant_list) x
        on r.barcode = x.barcode) y
group by varlist, sample""",
    "fx_null": VIEWS["fx_null"].replace("join fx_subasm s", "join fx_subasm_bc s"),
}

_NAME = re.compile(r"\bfx_[a-z0-9_]+\b")


def _needed(text: str, seen: list[str], views: dict[str, str]) -> list[str]:
    for name in dict.fromkeys(_NAME.findall(text)):
        if name in views and name not in seen:
            _needed(views[name], seen, views)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(text: str, extra: list[str] | None = None, views: dict[str, str] = VIEWS) -> str:
    """Prefix ``text`` with the common table expressions it refers to, in dependency order."""
    names = _needed(" ".join([text, *(extra or [])]), [], views)
    if not names:
        return text
    ctes = ",\n".join(f"{n} as ({views[n].strip()}\n)" for n in names)
    if text.lstrip().lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{text.lstrip()[len('with recursive'):]}"
    if text.lstrip().lower().startswith("with "):
        return f"with {ctes},\n{text.lstrip()[len('with '):]}"
    return f"with {ctes}\n{text}"


_SOURCE = re.compile(r"\b(from|join)\s+(" + "|".join(BASE_TABLES) + r")\b", re.IGNORECASE)


def view_name(sf_dir: str, table: str) -> str:
    """Name of the temporary view of a base table; private to one data directory."""
    return f"jn_{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}_{table}"


def for_dir(text: str, sf_dir: str) -> str:
    """Point the base tables of a query at one data directory."""
    return _SOURCE.sub(lambda m: f"{m[1]} {view_name(sf_dir, m[2])}", text)


def register_base(spark: SparkSession, sf_dir: str) -> None:
    """Expose the base tables of ``sf_dir`` as temporary views of the session."""
    if spark.catalog.tableExists(view_name(sf_dir, BASE_TABLES[-1])):
        return
    for name in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view_name(sf_dir, name))
