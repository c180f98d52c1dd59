"""Plans of the isoform catalogue, path and statistics operators."""

from pyspark.sql import functions as F

from juncture.functions.coordinates import isoform_text, parse_isoform_text
from juncture.operators import barcodes as B
from juncture.operators import isoforms as I
from juncture.operators import reads as RD
from juncture.plans.barcodes import ISOS, SAMPLES
from juncture.plans.reads import BLOCKS_SQL, CNST, PE_SQL, SE_SQL, single_end, text_sql
from juncture.plans.registry import query

CANONICAL = ["[[1267,1359]]", "[[1267,1350]]", "[]"]
_COUNTS = "(select sample, coalesce(status, isoform) as isoform, count(*) as read_count from fx_reads group by 1, 2)"


def _counts(t):
    return I.isoform_read_counts(t("fx_reads"))


@query("isoform_read_counts", "sample:s isoform:s read_count:i", f"select * from {_COUNTS}")
def _(t):
    return _counts(t)


@query("isoform_read_counts_se", "sample:s isoform:s read_count:i",
       f"{SE_SQL} select sample, coalesce(status, isoform) as isoform, count(*) as read_count from se where status is null or status not in ('bad_ends', 'soft_clipped') group by 1, 2")
def _(t):
    return I.isoform_read_counts(single_end(t), keep_qc=False)


@query("soft_clipped_reads", "sample:s qname:s mate:i", f"{SE_SQL} select sample, qname, mate from se where status = 'soft_clipped'")
def _(t):
    return I.soft_clipped_reads(single_end(t))


_SE_KINDS = {"unmapped_reads": "unmapped", "bad_starts": "bad_starts", "bad_ends": "bad_ends", "soft_clipped": "soft_clipped"}


@query("barcode_isoform_counts_se", "sample:s barcode:s num_reads:i " + " ".join(f"{c}:i" for c in _SE_KINDS) + " other_isoform:i SKIP:i TAIL:i usable_reads:i",
       f"""{SE_SQL}, c as (select sample, barcode, count(*) as num_reads, {', '.join(f"count(*) filter (where status = '{w}') as {c}" for c, w in _SE_KINDS.items())},
         count(*) filter (where isoform = '[]') as "SKIP", count(*) filter (where isoform = '[[1268,1358]]') as "TAIL",
         count(*) filter (where status is null and isoform not in ('[]', '[[1268,1358]]')) as other_isoform from se group by 1, 2)
       select *, num_reads - unmapped_reads - bad_starts - bad_ends - soft_clipped - other_isoform as usable_reads from c""")
def _(t):
    names = t.spark.sql("select * from values ('[]', 'SKIP'), ('[[1268,1358]]', 'TAIL') as m(isoform, name)")
    # two mates per line item
    reads = single_end(t).repartition(2 * t.tasks("lineitem"), "barcode")
    return B.barcode_isoform_counts(reads, names, ["SKIP", "TAIL"], ["sample", "barcode"])


@query("append_unmapped_total", "sample:s isoform:s read_count:i",
       f"""select sample, isoform, case isoform when 'unmapped' then (select max(n) from (select mate, count(*) as n from fx_mates m
         where m.sample = c.sample and (flag // 4) % 2 = 1  group by mate)) else read_count end as read_count from {_COUNTS} c""")
def _(t):
    lost = t("fx_mates").filter(RD.flag(0x4))
    return I.append_unmapped_total(_counts(t), lost.filter("mate = 1"), lost.filter("mate = 2"))


_WIDE = ", ".join(f"coalesce(sum(case when sample = '{s}' then read_count end), 0) as \"{s}_read_count\"" for s in SAMPLES)


@query("isoform_catalog", "isonum:s isoform:s " + " ".join(f"{s}_read_count:i" for s in SAMPLES),
       f"""select concat('iso', lpad(cast(row_number() over (order by total desc, isoform) - 1 as varchar), cast(length(cast(count(*) over () as varchar)) as int), '0')) as isonum, *
       from (select isoform, sum(read_count) as total, {_WIDE} from {_COUNTS} group by isoform)""")
def _(t):
    return I.isoform_catalog(_counts(t), SAMPLES)


@query("barcode_isoform_counts_by_start", "barcode:s num_reads:i unmapped_reads:i bad_starts:i full:i skip:i usable_reads:i full_psi:d skip_psi:d",
       f"""with {BLOCKS_SQL},
       x as (select barcode, (flag // 4) % 2 = 1 as u, coalesce((flag // 4) % 2 = 0 and abs(blocks[1].s - 626) > 4, false) as s,
         list_filter([696, 1267, 1359, 3478], lambda j: len(list_filter(blocks, lambda b: b.s <= j + 4 and b.e - 1 >= j - 4)) > 0) as j from blk),
       g as (select barcode, count(*) as num_reads, sum(case when u then 1 else 0 end) as unmapped_reads, sum(case when s then 1 else 0 end) as bad_starts,
         sum(case when not u and not s and j = [696, 1267, 1359] then 1 else 0 end) as "full", sum(case when not u and not s and j = [696, 3478] then 1 else 0 end) as skip from x group by barcode)
       select *, num_reads - unmapped_reads - bad_starts as usable_reads, "full" / nullif((num_reads - unmapped_reads - bad_starts) * 1e0, 0) as full_psi,
         skip / nullif((num_reads - unmapped_reads - bad_starts) * 1e0, 0) as skip_psi from g""")
def _(t):
    return I.barcode_isoform_counts_by_start(RD.with_blocks(t("fx_mates")), {"full": [696, 1267, 1359], "skip": [696, 3478]}, 626, 4)


def _blocks(t):
    """Distinct normalised isoforms of the raw mates."""
    # equal pairs of positions and CIGARs are counted before they are normalised
    shapes = RD.pair_reads(t("fx_mates")).groupBy(*[F.struct(*[F.col(f"{m}.{c}").alias(c) for c in ("pos", "cigar")]).alias(m) for m in ("left", "right")]).agg(F.count(F.lit(1)).alias("pairs"))
    n = RD.normalize_junctions_pe(shapes, CNST).filter("status is null")
    return n.groupBy("isoform").agg(F.sum("pairs").alias("n")).withColumn("isonum", isoform_text("isoform"))


_CAT = f"(select res as iso, {text_sql('res')} as isonum, count(*) as n from pe where status is null group by res)"


@query("named_isoform_groups", "isonum:s group:s",
       f"""{PE_SQL}, c as (select isonum, list_filter(iso, lambda b: not (b.s between 1230 and 1239 or b.e between 1230 and 1239)) as c from {_CAT}),
       u as (select isonum, c, coalesce(list_sum(list_transform(c, lambda b: b.e - b.s + 1)), 0) + 60 as used from c)
       select isonum, case when c = [{{'s': 1267, 'e': 1359}}] or (used >= 138 and used < 162 and len(c) = 1 and c[1].s = 1267 and c[1].e >= 1347 and c[1].e < 1371) then 'FULL'
         when len(c) = 0 then 'SKIP' else 'OTHER' end as "group" from u""")
def _(t):
    return I.named_isoform_groups(_blocks(t), {"FULL": [(1267, 1359)], "SKIP": []}, [(1230, 1240)], 60, 150, 12)


@query("collapse_isoforms", "isogrp:s comb_isoform:s n:i max_n:i isoform_counts:i comb_iso_nums:s isoforms:s",
       f"""{PE_SQL}, c as (select isonum, n, {text_sql("list_filter(iso, lambda b: not (b.s between 1260 and 1269 or b.e between 1260 and 1269))")} as comb_isoform from {_CAT}),
       g as (select comb_isoform, sum(n) as n, max(n) as max_n, count(*) as isoform_counts, string_agg(isonum, ',' order by isonum) as comb_iso_nums,
         string_agg(isonum, ';' order by isonum) as isoforms from c group by comb_isoform)
       select *, concat('isogrp', lpad(cast(row_number() over (order by n desc, comb_isoform) - 1 as varchar), cast(length(cast(count(*) over () as varchar)) as int), '0')) as isogrp from g""")
def _(t):
    out = I.collapse_isoforms(_blocks(t).withColumn("max_n", F.col("n")), [(1260, 1270)], ["n"], ["max_n"], "n")
    return out.withColumn("comb_isoform", isoform_text("comb_isoform"))


PATHS_SQL = """ends as (select gene, min(start_pos) as f, max(end_pos) as l from fx_exons group by gene),
  walk(gene, tail, nums, txt, path) as (
    select e.gene, e.end_pos, [e.exon_num], concat('[', e.start_pos, ',', e.end_pos, ']'), [{'s': e.start_pos, 'e': e.end_pos}] from fx_exons e join ends on e.gene = ends.gene and e.start_pos = f
    union all
    select w.gene, e.end_pos, list_append(nums, e.exon_num), concat(txt, ',[', e.start_pos, ',', e.end_pos, ']'), list_append(path, {'s': e.start_pos, 'e': e.end_pos})
    from walk w join fx_exons e on e.gene = w.gene and e.start_pos > w.tail),
  paths as (select w.gene, path, concat('[', txt, ']') as txt, row_number() over (partition by w.gene order by nums) - 1 as i from walk w join ends on w.gene = ends.gene and w.tail = l)"""
_NAME = "case when i < 10 then concat('iso0', i) else concat('iso', i) end"


@query("exon_path_enumeration", "gene:s iso:s path:s", f"with recursive {PATHS_SQL} select gene, txt as path, {_NAME} as iso from paths")
def _(t):
    return I.exon_path_enumeration(t("fx_exons")).withColumn("path", isoform_text("path"))


@query("junction_path_enumeration", "gene:s path:s",
       """with recursive s as (select gene, min(start_pos) + 3 as st, max(end_pos) as l from fx_exons group by gene),
       walk(gene, tail, txt, n) as (
         select e.gene, e.end_pos, concat(s.st, ',', e.end_pos), 2 from fx_exons e join s on e.gene = s.gene and s.st between e.start_pos and e.end_pos
         union all
         select w.gene, e.end_pos, concat(txt, ',', e.start_pos, ',', e.end_pos), n + 2 from walk w join fx_exons e on e.gene = w.gene and e.start_pos > w.tail)
       select w.gene, txt as path from walk w join s on w.gene = s.gene and w.tail = s.l where n >= 3""")
def _(t):
    starts = t("fx_exons").groupBy("gene").agg((F.min("start_pos") + 3).alias("read_start"))
    out = I.junction_path_enumeration(t("fx_exons"), starts)
    return out.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query("visible_isoforms", "gene:s visible:s members:s isogrp:s",
       f"""with recursive {PATHS_SQL}, st as (select gene, min(start_pos) + 3 as st from fx_exons group by gene),
       ex as (select p.gene, p.i, s.st, unnest(list_transform(range(1, len(path) + 1), lambda k: {{'k': k, 's': path[k].s, 'e': path[k].e}})) as x from paths p join st s on p.gene = s.gene),
       f as (select gene, i, x.k as k, greatest(x.s, st) as s, x.e as e, st from ex where x.e >= st),
       u as (select *, coalesce(sum(e - s + 1) over (partition by gene, i order by k rows between unbounded preceding and 1 preceding), 0) as used from f),
       v as (select gene, i, concat('[', string_agg(concat('[', s, ',', cast(least(e, s + 25 - used - 1) as int), ']'), ',' order by k), ']') as visible from u where used < 25 group by gene, i),
       g as (select p.gene, v.visible, string_agg({_NAME.replace('i <', 'p.i <').replace(', i)', ', p.i)')}, ',' order by {_NAME.replace('i <', 'p.i <').replace(', i)', ', p.i)')}) as members
         from paths p left join v on p.gene = v.gene and p.i = v.i group by 1, 2)
       select *, concat('isogrp', lpad(cast(row_number() over (partition by gene order by visible nulls last) - 1 as varchar), 2, '0')) as isogrp from g""")
def _(t):
    starts = t("fx_exons").groupBy("gene").agg((F.min("start_pos") + 3).alias("read_start"))
    paths = I.exon_path_enumeration(t("fx_exons")).join(starts, "gene")
    return I.visible_isoforms(paths, F.col("read_start"), 25).withColumn("visible", isoform_text("visible"))


_BC = "(select sample, coalesce(status, isoform) as isoform, barcode, count(*) as n from fx_reads group by 1, 2, 3)"
_PV = f"(select sample, isoform, variant_list, count(*) as n_bc, max(n) as max_n, sum(n) as sum_n from {_BC} b join fx_subasm s on b.barcode = s.barcode group by 1, 2, 3)"
_ST = f"(select sample, isoform, sum(n_bc) as num_bcs, count(*) as num_vars, max(max_n) as max_reads_per_bc, sum(sum_n) as sum_sa_reads, max(n_bc) as max_bc_per_var from {_PV} group by 1, 2)"


def _bc_iso(t):
    return t("fx_reads").groupBy("sample", F.coalesce("status", "isoform").alias("isoform"), "barcode").agg(F.count(F.lit(1)).alias("n"))


def _per_variant(t):
    return I.isoform_variant_counts(_bc_iso(t), t("fx_subasm"))


@query("isoform_variant_stats", "sample:s isoform:s num_bcs:i num_vars:i max_reads_per_bc:i sum_sa_reads:i max_bc_per_var:i", f"select * from {_ST}")
def _(t):
    return I.isoform_variant_stats(_per_variant(t))


_CLUSTER = f"""v as (select sample, isoform, cast(split_part(variant_list, ':', 2) as int) as pos, n_bc,
    row_number() over (partition by sample, isoform order by n_bc desc, variant_list) as k from {_PV}),
  r(sample, isoform, k, cl, found) as (
    select distinct sample, isoform, 0, cast([] as struct(p int, n int, b bigint)[]), false from v
    union all
    select sample, isoform, k + 1, case when i is null then list_append(cl, {{'p': pos, 'n': 1, 'b': n_bc}})
        else list_transform(range(1, len(cl) + 1), lambda x: case when x = i then {{'p': cl[x].p, 'n': cl[x].n + 1, 'b': cl[x].b + n_bc}} else cl[x] end) end,
      i is not null and cl[i].n + 1 = 3 and (cl[i].b + n_bc) / 3e0 >= 3
    from (select r.sample, r.isoform, r.k, cl, v.pos, v.n_bc, nullif(list_position(list_transform(cl, lambda c: abs(c.p - v.pos) <= 10), true), 0) as i
          from r join v on r.sample = v.sample and r.isoform = v.isoform and v.k = r.k + 1 where not found)),
  cluster as (select sample, isoform, bool_or(found) as clustered from r group by 1, 2)"""


@query("variant_position_cluster", "sample:s isoform:s clustered:b", f"with recursive {_CLUSTER} select * from cluster")
def _(t):
    return I.variant_position_cluster(_per_variant(t))


@query("isoform_filter_code", "sample:s isoform:s num_bcs:i top_var:s filter:i",
       f"""with recursive {_CLUSTER}, top as (select sample, isoform, min(variant_list) as top_var from (select *, max(n_bc) over (partition by sample, isoform) as m from {_PV}) where n_bc = m group by 1, 2),
       odd as (select '[[1236,1359]]' as isoform, 1236 as j)
       select s.sample, s.isoform, num_bcs, top_var, case when s.isoform not like '[%' then 0 when s.isoform in ('[[1267,1350]]', '[]') then 1 when max_bc_per_var >= 30 then 2
         when max_bc_per_var <= 2 and max_reads_per_bc <= 2 then 0
         when exists (select 1 from odd o where o.isoform = s.isoform and abs(cast(split_part(top_var, ':', 2) as int) - o.j) <= 10) then 3
         when clustered then 4 else 0 end as "filter"
       from {_ST} s join top t on s.sample = t.sample and s.isoform = t.isoform join cluster c on s.sample = c.sample and s.isoform = c.isoform""")
def _(t):
    catalog = t("fx_reads").filter("isoform is not null").select("isoform").distinct()
    catalog = catalog.withColumn("blocks", parse_isoform_text("isoform"))
    return I.isoform_filter_code(_per_variant(t), catalog, [1267, 1350, 1359], ["[[1267,1350]]", "[]"], min_top=30)


# lists of several variants: every code occurs
_LPV = """pv as (select sample, isoform, variant_list, count(*) as n_bc, max(n) as max_n, sum(n) as sum_n
    from fx_list_counts b join fx_lists s on b.barcode = s.barcode group by 1, 2, 3),
  st as (select sample, isoform, sum(n_bc) as num_bcs, count(*) as num_vars, max(max_n) as max_reads_per_bc, sum(sum_n) as sum_sa_reads, max(n_bc) as max_bc_per_var from pv group by 1, 2),
  one as (select sample, isoform, variant_list, n_bc, unnest(string_split(variant_list, ',')) as v, unnest(range(1, len(string_split(variant_list, ',')) + 1)) as i from pv),
  twice as (select sample, isoform, max(c) > 1 as twice from (select sample, isoform, v, count(*) as c from one group by 1, 2, 3) group by 1, 2),
  top as (select sample, isoform, arg_min(variant_list, row(-n_bc, variant_list)) as top_var from pv group by 1, 2),
  v as (select sample, isoform, cast(split_part(v, ':', 2) as int) as pos, n_bc, row_number() over (partition by sample, isoform order by n_bc desc, variant_list, i) as k from one),
  r(sample, isoform, k, cl, found) as (
    select distinct sample, isoform, 0, cast([] as struct(p int, n int, b bigint)[]), false from v
    union all
    select sample, isoform, k + 1, case when i is null then list_append(cl, {'p': pos, 'n': 1, 'b': n_bc})
        else list_transform(range(1, len(cl) + 1), lambda x: case when x = i then {'p': cl[x].p, 'n': cl[x].n + 1, 'b': cl[x].b + n_bc} else cl[x] end) end,
      i is not null and cl[i].n + 1 = 3 and (cl[i].b + n_bc) / 3e0 >= 3
    from (select r.sample, r.isoform, r.k, cl, v.pos, v.n_bc, nullif(list_position(list_transform(cl, lambda c: abs(c.p - v.pos) <= 10), true), 0) as i
          from r join v on r.sample = v.sample and r.isoform = v.isoform and v.k = r.k + 1 where not found)),
  cluster as (select sample, isoform, bool_or(found) as clustered from r group by 1, 2),
  odd as (select isoform, cast(unnest(regexp_extract_all(isoform, '[0-9]+')) as int) as j from (select distinct isoform from pv where isoform like '[%'))"""


def _code_sql(first_only):
    odd = "(select isoform, min(j) as j from odd where j not in (1267, 1350, 1359) group by isoform)" if first_only else "(select isoform, j from odd where j not in (1267, 1350, 1359))"
    return f"""select s.*, top_var, case when s.isoform not like '[%' then 0 when s.isoform = '[[1267,1350]]' then 1 when max_bc_per_var >= 60 then 2
         when max_bc_per_var <= 2 and max_reads_per_bc <= 2 then 0
         when exists (select 1 from {odd} o, (select unnest(string_split(top_var, ',')) as x) p where o.isoform = s.isoform and abs(cast(split_part(p.x, ':', 2) as int) - o.j) <= 10) then 3
         when clustered then 4 when twice then 5 else 0 end as "filter"
       from st s join top t on s.sample = t.sample and s.isoform = t.isoform join cluster c on s.sample = c.sample and s.isoform = c.isoform
       join twice w on s.sample = w.sample and s.isoform = w.isoform"""


def _list_codes(t, first_only=False):
    per_variant = I.isoform_variant_counts(t("fx_list_counts"), t("fx_lists"))
    catalog = t("fx_list_counts").filter("isoform like '[%'").select("isoform").distinct().withColumn("blocks", parse_isoform_text("isoform"))
    return I.isoform_filter_code(per_variant, catalog, [1267, 1350, 1359], ["[[1267,1350]]"], min_top=60, first_only=first_only)


@query("isoform_filter_code_lists", "sample:s isoform:s num_bcs:i num_vars:i top_var:s filter:i", f"with recursive {_LPV} {_code_sql(False)}")
def _(t):
    return _list_codes(t)


@query("isoform_filter_code_first_junction", "sample:s isoform:s num_bcs:i num_vars:i top_var:s filter:i", f"with recursive {_LPV} {_code_sql(True)}")
def _(t):
    return _list_codes(t, first_only=True)


@query("isoform_totals", "isoform:s total_read_count:i total_num_bcs:i total_num_vars:i total_sum_sa_reads:i total_passfilt:i",
       f"""with recursive {_LPV}, x as ({_code_sql(False)}), n as (select sample, isoform, sum(n) as read_count from fx_list_counts group by 1, 2)
       select x.isoform, sum(read_count) as total_read_count, sum(num_bcs) as total_num_bcs, sum(num_vars) as total_num_vars, sum(sum_sa_reads) as total_sum_sa_reads,
         count(*) filter (where "filter" <> 0) as total_passfilt from x join n on x.sample = n.sample and x.isoform = n.isoform group by 1""")
def _(t):
    counts = t("fx_list_counts").groupBy("sample", "isoform").agg(F.sum("n").alias("read_count"))
    return I.isoform_totals(counts.join(_list_codes(t), ["sample", "isoform"]))


_WTB = "(select barcode from fx_subasm where status = 'apparently_wt_no_passing_vars')"


@query("wt_isoform_stats", "sample:s isoform:s num_bcs:i max_reads_per_bc:i filter:i",
       f"""select *, case when isoform in ('[[1267,1350]]', '[]') then 1 when num_bcs >= 300 then 2 when num_bcs > 2 and max_reads_per_bc > 2 then 6 else 0 end as "filter"
       from (select sample, isoform, count(*) as num_bcs, max(n) as max_reads_per_bc from {_BC} where barcode in {_WTB} group by 1, 2)""")
def _(t):
    wt = B.barcodes_by_status(t("fx_subasm"), "apparently_wt_no_passing_vars")
    return I.wt_isoform_stats(_bc_iso(t), wt, ["[[1267,1350]]", "[]"], min_top=300)


_QC = ["unpaired", "secondary", "unmapped", "bad_starts", "bad_ends", "soft_clipped"]


@query("isoform_qc_summary", "sample:s total_reads:i sa_reads:i per_sa_reads:d " + " ".join(f"total_{w}:i per_total_{w}:d" for w in _QC),
       f"""with g as (select c.sample, sum(read_count) as total_reads, coalesce(sum(sum_sa_reads), 0) as sa_reads,
         {', '.join(f"sum(case when c.isoform = '{w}' then read_count else 0 end) as total_{w}" for w in _QC)}
         from {_COUNTS} c left join {_ST} s on c.sample = s.sample and c.isoform = s.isoform group by c.sample)
       select *, sa_reads / (total_reads * 1e0) as per_sa_reads, {', '.join(f'total_{w} / (total_reads * 1e0) as per_total_{w}' for w in _QC)} from g""")
def _(t):
    stats = _counts(t).join(I.isoform_variant_stats(_per_variant(t)), ["sample", "isoform"], "left")
    return I.isoform_qc_summary(stats)


_SUMMED = ["usable_reads", "unmapped_reads", "bad_ends"]


def _usage(i):
    p = "usable_reads > y"
    v = f"case when {p} and usable_reads > 0 then \"{i}\" / (usable_reads * 1e0) end"
    return f"avg({v}) as mean_{i}, sum(case when {p} then \"{i}\" end) / nullif(sum(case when {p} then usable_reads end) * 1e0, 0) as wmean_{i}"


CUT_SQL = """(select sample, percentile, arg_min(v, k) as y, log10(min(k)) as x from (
    select sample, {v} as v, percentile, row_number() over (partition by sample, percentile order by {v} desc, barcode) as k,
      100e0 * sum({v}) over (partition by sample, percentile order by {v} desc, barcode rows unbounded preceding) / sum({v}) over (partition by sample, percentile) as cum
    from fx_bcs, (select unnest([{ps}]) as percentile) p) where cum >= percentile group by 1, 2)"""


@query("read_barcodes_to_variants",
       "sample:s varlist:s n_bc:i n_bc_passfilt:i sum_reads:i sum_reads_passfilt:i n_bc_sa:i " + " ".join(f"sum_{c}:i" for c in _SUMMED) + " mean_FULL:d wmean_FULL:d mean_SKIP:d wmean_SKIP:d",
       f"""with c as (select b.*, k.y, iso_full as "FULL", iso_skip as "SKIP" from fx_bcs b join {CUT_SQL.format(v='usable_reads', ps='95e0')} k on b.sample = k.sample),
       g as (select sample, variant_list as varlist, count(*) as n_bc, sum(case when usable_reads > y then 1 else 0 end) as n_bc_passfilt, sum(num_reads) as sum_reads,
         coalesce(sum(case when usable_reads > y then num_reads end), 0) as sum_reads_passfilt,
         {', '.join(f"coalesce(sum(case when usable_reads > y then {c} end), 0) as sum_{c}" for c in _SUMMED)}, {_usage('FULL')}, {_usage('SKIP')}
         from c join fx_subasm s on c.barcode = s.barcode where n_variants_passing = 1 group by 1, 2)
       select g.*, n.n_bc_sa from g join (select variant_list, count(*) as n_bc_sa from fx_subasm where n_variants_passing = 1 group by 1) n on n.variant_list = g.varlist""")
def _(t):
    out = I.read_barcodes_to_variants(t("fx_reads_bc"), t("fx_isonames"), ["FULL", "SHORT", "SKIP"], t("fx_subasm_bc"), summary=tuple(_SUMMED))
    return out["variants"]


@query("inspect_barcode_isoforms", "isoform:s barcode:s n:i",
       "select coalesce(status, isoform) as isoform, barcode, count(*) as n from fx_reads where barcode in (select barcode from fx_subasm where n_variants_passing = 2) group by 1, 2")
def _(t):
    return _inspected(t)[0]


def _inspected(t):
    reads = t("fx_reads").withColumn("isoform", F.coalesce("status", "isoform"))
    return I.inspect_barcode_isoforms(reads, t("fx_subasm").filter("n_variants_passing = 2"), ["[[1236,1359]]", "soft_clipped"])


@query("inspect_suspicious_reads", "sample:s barcode:s qname:s isoform:s",
       """select sample, barcode, qname, coalesce(status, isoform) as isoform from fx_reads
       where barcode in (select barcode from fx_subasm where n_variants_passing = 2) and coalesce(status, isoform) in ('[[1236,1359]]', 'soft_clipped')""")
def _(t):
    return _inspected(t)[1]
