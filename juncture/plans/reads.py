"""Plans of the read-to-isoform section, up to one isoform per read pair."""

from pyspark.sql import functions as F

from juncture.functions.coordinates import isoform_text
from juncture.operators import reads as RD
from juncture.operators.reference import reference_chunks
from juncture.plans.registry import query

CNST = ((649, 696), (3478, 3533))

# blocks of every record, in the oracle
BLOCKS_SQL = r"""ops as (select barcode, qname, mate, flag, pos, cigar, regexp_extract_all(cigar, '\d+([A-Z=])', 1) as op,
    list_transform(regexp_extract_all(cigar, '(\d+)[A-Z=]', 1), lambda x: cast(x as int)) as n from fx_mates),
  ends as (select *, list_transform(range(1, len(op) + 1), lambda i: pos - 1 + coalesce(list_sum(list_transform(range(1, i),
    lambda k: case when op[k] in ('M', '=', 'X', 'D', 'N') then n[k] else 0 end)), 0)) as s from ops),
  blk as (select *, list_transform(list_filter(range(1, len(op) + 1), lambda i: op[i] in ('M', '=', 'X')),
    lambda i: {'s': cast(s[i] as int), 'e': cast(s[i] + n[i] as int)}) as blocks from ends)"""


def text_sql(col, s="s", e="e"):
    return f"concat('[', array_to_string(list_transform({col}, lambda x: concat('[', x.{s}, ',', x.{e}, ']')), ','), ']')"


@query("read_status", "qname:s mate:i discovery:s counting:s",
       """select qname, mate, case when s then 'secondary' when not p then 'unpaired' when u then 'unmapped' end as discovery,
       case when not p then 'unpaired' when s then 'secondary' when u then 'unmapped' end as counting from (select qname, mate,
       (flag // 256) % 2 = 1 as s, flag % 2 = 1 as p, (flag // 4) % 2 = 1 or (flag // 8) % 2 = 1 as u from fx_mates)""")
def _(t):
    return t("fx_mates").withColumns({"discovery": RD.read_status(), "counting": RD.read_status("flag", True)})


@query("pair_reads", "qname:s left_pos:i left_cigar:s right_pos:i right_cigar:s",
       """select qname, case when swap then p2 else p1 end as left_pos, case when swap then c2 else c1 end as left_cigar,
       case when swap then p1 else p2 end as right_pos, case when swap then c1 else c2 end as right_cigar
       from (select a.qname, a.pos as p1, b.pos as p2, a.cigar as c1, b.cigar as c2, a.cigar <> '*' and b.cigar <> '*' and a.pos > b.pos as swap
       from fx_mates a join fx_mates b on a.qname = b.qname and a.mate = 1 and b.mate = 2)""")
def _(t):
    p = RD.pair_reads(t("fx_mates"))
    return p.select("qname", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in ("pos", "cigar")])


@query("normalize_junctions_se", "qname:s mate:i status:s isoform:s",
       f"""with recursive {BLOCKS_SQL},
       base as (select qname, mate, blocks, list_filter(list_transform(blocks, lambda x: {{'s': x.s + 1, 'e': x.e}}), lambda x: x.s >= 696 and x.e < 3479) as ins from blk),
       r(qname, mate, k, res) as (
         select qname, mate, 0, cast([] as struct(s int, e int)[]) from base
         union all
         select r.qname, r.mate, k + 1, case when k > 0 and ins[k + 1].s = ins[k].e + 1
             then list_concat(res[1:len(res) - 1], [{{'s': ins[k].s, 'e': ins[k + 1].e}}]) else list_append(res, ins[k + 1]) end
         from r join base b on r.qname = b.qname and r.mate = b.mate where k < len(ins)),
       f as (select b.qname, b.mate, b.blocks, case when len(res) > 0 and res[len(res)].e - res[len(res)].s <= 3 then res[1:len(res) - 1] else res end as iso
         from base b join r on r.qname = b.qname and r.mate = b.mate and r.k = len(b.ins)),
       g as (select *, case when not (len(blocks) = 0 or blocks[len(blocks)].e < 3478 or len(list_filter(blocks, lambda x: x.s between 3475 and 3481)) > 0) then 'bad_ends'
         when coalesce(list_sum(list_transform(blocks, lambda x: x.e - x.s + 1)), 0) < 95 then 'soft_clipped' end as status from f)
       select qname, mate, status, case when status is null then {text_sql('iso')} end as isoform from g""")
def _(t):
    n = RD.with_blocks(t("fx_mates")).withColumn("n", RD.normalize_junctions_se("blocks", CNST, 3, 95))
    return n.select("qname", "mate", "n.status", isoform_text("n.isoform").alias("isoform"))


# single-end outcomes: every mate as a read of its own
SE_SQL = f"""with recursive {BLOCKS_SQL},
       base as (select barcode, qname, mate, flag, blocks, list_filter(list_transform(blocks, lambda x: {{'s': x.s + 1, 'e': x.e}}), lambda x: x.s >= 696 and x.e < 3479) as ins from blk),
       r(qname, mate, k, res) as (
         select qname, mate, 0, cast([] as struct(s int, e int)[]) from base
         union all
         select r.qname, r.mate, k + 1, case when k > 0 and ins[k + 1].s = ins[k].e + 1
             then list_concat(res[1:len(res) - 1], [{{'s': ins[k].s, 'e': ins[k + 1].e}}]) else list_append(res, ins[k + 1]) end
         from r join base b on r.qname = b.qname and r.mate = b.mate where k < len(ins)),
       f as (select b.*, case when len(res) > 0 and res[len(res)].e - res[len(res)].s <= 3 then res[1:len(res) - 1] else res end as iso
         from base b join r on r.qname = b.qname and r.mate = b.mate and r.k = len(b.ins)),
       g as (select *, case when (flag // 4) % 2 = 1 then 'unmapped' when len(list_filter(blocks, lambda x: x.e between 693 and 699)) = 0 then 'bad_starts'
         when not (len(blocks) = 0 or blocks[len(blocks)].e < 3478 or len(list_filter(blocks, lambda x: x.s between 3475 and 3481)) > 0) then 'bad_ends'
         when coalesce(list_sum(list_transform(blocks, lambda x: x.e - x.s + 1)), 0) < 95 then 'soft_clipped' end as status from f),
       se as (select concat('S', cast(cast(split_part(qname, '-', 4) as int) % 4 as varchar)) as sample, barcode, qname, mate, status,
         case when status is null then {text_sql('iso')} end as isoform from g)"""


def single_end(t):
    """Every mate as a single-end read, with the isoform as text."""
    return RD.single_end_outcomes(t("fx_mates"), CNST, 3, 95).withColumn("isoform", isoform_text("isoform"))


@query("single_end_outcomes", "qname:s mate:i status:s isoform:s", f"{SE_SQL} select qname, mate, status, isoform from se")
def _(t):
    return single_end(t)


@query("rejected_reads", "qname:s mate:i status:s", f"{SE_SQL} select qname, mate, status from se where status is not null")
def _(t):
    return RD.rejected_reads(single_end(t))


PE_SQL = f"""with recursive {BLOCKS_SQL},
  ri(qname, mate, k, j, skip, res) as (
    select qname, mate, 1, 1, false, cast([] as struct(s int, e int)[]) from blk
    union all
    select q, m, k + 1, case when mt or ind then j + 1 else j end, ind,
      case when mt and here is not null then list_append(res, here)
           when ind then list_concat(res[1:len(res) - 1], [{{'s': res[len(res)].s, 'e': coalesce(here.e, res[len(res)].e)}}]) else res end
    from (select b.qname as q, b.mate as m, k, j, res, b.blocks[j] as here, not skip and op[k] = 'M' and n[k] >= 3 as mt,
            not skip and not (op[k] = 'M' and n[k] >= 3) and len(res) > 0 and op[k] in ('I', 'D') and n[k] <= 20 as ind
          from ri join blk b on ri.qname = b.qname and ri.mate = b.mate where k <= len(op))),
  col as (select b.barcode, b.qname, b.mate, b.flag, b.blocks, case when list_contains(op, 'I') or list_contains(op, 'D') then res else b.blocks end as c
    from blk b join ri on ri.qname = b.qname and ri.mate = b.mate and ri.k = len(b.op) + 1),
  pr as (select x.barcode, x.qname, x.flag as flag, case when sw then y.blocks else x.blocks end as a, case when sw then x.blocks else y.blocks end as b,
      case when sw then y.c else x.c end as ca, case when sw then x.c else y.c end as cb
    from (select p.*, coalesce(p.blocks[1].s > q.blocks[1].s, false) as sw from col p join col q on p.qname = q.qname and p.mate = 1 and q.mate = 2) x
    join col y on x.qname = y.qname and y.mate = 2),
  al as (select *, list_sort(case when coalesce(ca[len(ca)].e <= cb[1].s, false)
      then list_concat(list_concat(ca[1:len(ca) - 1], [{{'s': ca[len(ca)].s, 'e': cb[1].e}}]), cb[2:]) else list_concat(ca, cb) end) as al from pr),
  st(qname, k, us, ds, res) as (
    select qname, 1, false, false, cast([] as struct(s int, e int)[]) from al
    union all
    select q, k + 1, us or u, ds or d, case when u or d or not (x.s + 1 >= 696 and x.e < 3479) then res
      when len(res) = 0 or x.s + 1 > res[len(res)].e then list_append(res, {{'s': x.s + 1, 'e': x.e}})
      else list_concat(res[1:len(res) - 1], [{{'s': res[len(res)].s, 'e': x.e}}]) end
    from (select st.qname as q, k, us, ds, res, al[k] as x, al[k].e between 693 and 699 as u, not (al[k].e between 693 and 699) and al[k].s between 3475 and 3481 as d
          from st join al on st.qname = al.qname where k <= len(al))),
  pe as (select al.barcode, al.qname, al.flag, case when len(a) = 0 or len(b) = 0 then 'unmapped'
      when list_sum(list_transform(a, lambda x: x.e - x.s + 1)) < 70 or list_sum(list_transform(b, lambda x: x.e - x.s + 1)) < 50 then 'soft_clipped'
      when not ds then 'bad_ends' when not us then 'bad_starts' end as status, res
    from al join st on al.qname = st.qname and st.k = len(al.al) + 1)"""


@query("normalize_junctions_pe", "qname:s status:s isoform:s",
       f"{PE_SQL} select qname, status, case when status is null then {text_sql('res')} end as isoform from pe")
def _(t):
    n = RD.normalize_junctions_pe(RD.pair_reads(t("fx_mates")), CNST)
    return n.withColumn("isoform", isoform_text("isoform"))


_VEC = "(select repeat(string_agg(base, '' order by pos), 20) as v from fx_base)"


@query("repair_constant_junctions", "qname:s mate:i blocks:s",
       f"""with {BLOCKS_SQL},
       w as (select qname, mate, blocks, v, (flag // 4) % 2 = 0 and len(blocks) > 1 and len(list_filter(blocks, lambda x: x.e >= 696)) > 0
           and len(list_filter(blocks, lambda x: x.s <= 3478)) > 0 as ok,
         len(list_filter(blocks, lambda x: x.e < 696)) as i, len(list_filter(blocks, lambda x: x.e = 696)) as i0,
         len(list_filter(blocks, lambda x: x.s <= 3478)) + 1 as j, len(list_filter(blocks, lambda x: x.s = 3478)) as j0 from blk, {_VEC}),
       z as (select *, ok and i > 0 and i0 = 0 as up, ok and not (i > 0 and i0 = 0) and j <= len(blocks) and j0 = 0 as dn from w),
       y as (select *, up and blocks[i + 1].e - blocks[i + 1].s >= 696 - blocks[i].e and substr(v, blocks[i].e + 1, 696 - blocks[i].e) = substr(v, blocks[i + 1].s + 1, 696 - blocks[i].e) as fu,
         dn and blocks[j - 1].e - blocks[j - 1].s >= blocks[j].s - 3478 and substr(v, 3479, blocks[j].s - 3478) = substr(v, blocks[j - 1].e - (blocks[j].s - 3478) + 1, blocks[j].s - 3478) as fd from z),
       o as (select qname, mate, list_transform(range(1, len(blocks) + 1), lambda k:
         case when coalesce(fu, false) and k = i then {{'s': blocks[k].s, 'e': 696}} when coalesce(fu, false) and k = i + 1 then {{'s': blocks[k].s + 696 - blocks[i].e, 'e': blocks[k].e}}
              when coalesce(fd, false) and k = j then {{'s': 3478, 'e': blocks[k].e}} when coalesce(fd, false) and k = j - 1 then {{'s': blocks[k].s, 'e': blocks[k].e - (blocks[j].s - 3478)}}
              else {{'s': blocks[k].s, 'e': blocks[k].e}} end) as nb from y)
       select qname, mate, {text_sql('nb')} as blocks from o""")
def _(t):
    # the construct: the reference bases twenty times over, one row per position
    size = t("fx_base").agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    first = t("fx_base").agg(F.min("pos").alias("p")).scalar()
    bases = t("fx_base").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19))))
    bases = bases.select(F.lit("construct").alias("chrom"), (F.col("pos") - first + 1 + F.col("k") * size).alias("pos"), "base")
    return RD.repair_constant_junctions(RD.with_blocks(t("fx_mates")), reference_chunks(bases), CNST, "construct").withColumn("blocks", isoform_text("blocks"))


@query("primary_alignments", "qname:s mate:i hi:i", "select qname, mate, hi from fx_mates where hi is null or hi = 1")
def _(t):
    return RD.primary_alignments(t("fx_mates"))


@query("barcode_sequences", "barcode:s seq:s n:i",
       """select barcode, case when mate = 2 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq, count(*) as n
       from fx_mates where (flag // 4) % 2 = 0 group by 1, 2""")
def _(t):
    return RD.barcode_sequences(t("fx_mates"))


@query("compare_aligners", "barcode:s qname:s a_prim_cigar:s a_alt_cigar:s b_prim_cigar:s b_alt_cigar:s same_primary:b",
       """with a as (select barcode, qname, max(case when u or not s then c end) as a_prim_cigar, max(case when not u and s then c end) as a_alt_cigar from
         (select barcode, qname, (flag // 4) % 2 = 1 as u, (flag // 256) % 2 = 1 as s, case when (flag // 4) % 2 = 1 then '*' else cigar end as c from fx_mates) group by 1, 2),
       b as (select barcode, qname, max(case when u or hi = 1 then c end) as b_prim_cigar, max(case when not u and (hi is null or hi <> 1) then c end) as b_alt_cigar from
         (select barcode, qname, hi, (flag // 4) % 2 = 1 as u, case when (flag // 4) % 2 = 1 then '*' else cigar end as c from fx_mates) group by 1, 2)
       select a.*, b_prim_cigar, b_alt_cigar, coalesce(a_prim_cigar = b_prim_cigar, false) as same_primary from a left join b on a.barcode = b.barcode and a.qname = b.qname""")
def _(t):
    return RD.compare_aligners(t("fx_mates"), t("fx_mates"))


@query("read_layout_mode", "kind:s rank:i value:i n:i percent:d low_share:b",
       """with v as (select 'start' as kind, pos as value from fx_mates where (flag // 4) % 2 = 0 union all select 'length', length(seq) from fx_mates where (flag // 4) % 2 = 0),
       c as (select kind, value, count(*) as n from v group by 1, 2),
       k as (select *, row_number() over (partition by kind order by n desc, value) as rank, 100e0 * n / sum(n) over (partition by kind) as percent from c)
       select *, max(percent) over (partition by kind) < 80 as low_share from k where rank <= 3""")
def _(t):
    return RD.read_layout_mode(t("fx_mates"))
