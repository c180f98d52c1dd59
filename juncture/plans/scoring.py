"""Plans of the sequence-scoring section."""

from pyspark.sql import functions as F

from juncture.functions import sequence as Q
from juncture.operators import annotation as A
from juncture.operators import scoring as S
from juncture.operators.reference import with_window
from juncture.plans.annotation import ANNOT_ALL, stranded, transcripts
from juncture.plans.expressions import ORACLE_REF, chunks
from juncture.plans.registry import query
from juncture.sources.sinks import write_once

KEYS = "chrom:s pos:i ref:s alt:s"
VAR = ["chrom", "pos", "ref", "alt"]


def atn(pos, n):
    """Oracle text for bases from a position, N outside the contig."""
    return f"substr(concat(repeat('N', 300), r.s, repeat('N', 300)), cast({pos} - 1199 + 300 as bigint), {n})"


def revc(x):
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


# ---- context windows

_BASE = f"""(select p.*, {atn('p.pos - 2', 1)} as b2, translate({atn('p.pos - 2', 1)}, 'ACGT', 'CATG') as b2a, case when p.pos % 3 = 0 then concat(p.alt, 'GG') else p.alt end as alt_x,
   case when p.pos % 2 = 0 then '+' else '-' end as strand, {atn('p.pos - 20', 41)} as w from fx_pairs p, {ORACLE_REF} r)"""
_MASKED = f"""(select v.chrom, v.pos, v.ref, v.alt_x as alt, v.pos2, v.alt2, v.b2a, v.strand, a.transcript_id,
   greatest(20 - (pos - tx_start - 1), 0) as lo, greatest(20 - (tx_end - pos), 0) as ro, w
   from {_BASE} v join {ANNOT_ALL} a on a.strand = v.strand and v.pos between a.tx_start and a.tx_end)"""


@query("context_windows", f"transcript_id:s {KEYS} strand:s ref_seq:s var_seq:s",
       f"""with m as (select *, concat(repeat('N', cast(lo as bigint)), substr(w, cast(lo + 1 as bigint), cast(41 - lo - ro as bigint)), repeat('N', cast(ro as bigint))) as x from {_MASKED}),
       b as (select *, concat(substr(x, 1, 18), b2a, substr(x, 20)) as rs from m),
       v as (select *, concat(substr(rs, 1, 20), alt, substr(rs, 22, cast(pos2 - pos - 1 as bigint)), alt2, substr(rs, cast(22 + pos2 - pos as bigint))) as vs from b)
       select transcript_id, chrom, pos, ref, alt, strand, case when strand = '-' then {revc('rs')} else rs end as ref_seq, case when strand = '-' then {revc('vs')} else vs end as var_seq from v""")
def _(t):
    p = with_window(t("fx_pairs"), chunks(t), 2, 0, "b").withColumn("b2", F.substr("b", F.lit(1), F.lit(1)))
    p = p.withColumns({
        "strand": F.when(F.col("pos") % 2 == 0, "+").otherwise("-"),
        "alt": F.when(F.col("pos") % 3 == 0, F.concat("alt", F.lit("GG"))).otherwise(F.col("alt")),
        "haplotype": F.array(F.struct(F.col("pos2").alias("pos"), F.col("ref2").alias("ref"), F.col("alt2").alias("alt"))),
        "background": F.array(F.struct((F.col("pos") - 2).alias("pos"), F.col("b2").alias("ref"), F.translate("b2", "ACGT", "CATG").alias("alt"))),
    })
    out = A.gene_flank_overhang(p, transcripts(t), 20)
    return S.context_windows(out, chunks(t), 20)


# ---- motifs

_MS = "((ascii(substr({0}, 1, 1)) * 3 + ascii(substr({0}, 3, 1)) * 5 + ascii(substr({0}, 6, 1)) * 7) % 50 - 20) / 1e1"
_MOTIFS = f"(select kmer, {_MS.format('kmer')} as score from (select distinct substr(r.s, cast(i as bigint), 6) as kmer from {ORACLE_REF} r, (select unnest(range(1, (select count(*) from fx_base) - 4)) as i)))"


def motifs(t):
    w = with_window(t("fx_base"), chunks(t), 0, 5, "kmer").filter(~F.col("kmer").contains("N")).select("kmer").distinct()
    return w.withColumn("score", F.expr(_MS.format("kmer")))


def _motif_sql(stat, tag):
    return f"""(select v.chrom, v.pos, v.ref, v.alt, {stat}(coalesce(a.score, 0)) as m_wt{tag}, {stat}(coalesce(b.score, 0)) as m_snv{tag}, {stat}(coalesce(b.score, 0)) - {stat}(coalesce(a.score, 0)) as m_chg{tag}
      from (select s.*, substr({atn('s.pos - 5', 11)}, k + 1, 6) as kw, substr(concat({atn('s.pos - 5', 5)}, s.alt, {atn('s.pos + 1', 5)}), k + 1, 6) as ks
            from fx_scores s, {ORACLE_REF} r, (select unnest(range(6)) as k) k) v left join {_MOTIFS} a on a.kmer = v.kw left join {_MOTIFS} b on b.kmer = v.ks group by 1, 2, 3, 4)"""


@query("motif_score_max", f"{KEYS} m_wtMAX:d m_snvMAX:d m_chgMAX:d", f"select * from {_motif_sql('max', 'MAX')}")
def _(t):
    return S.motif_scores(t("fx_scores"), chunks(t), motifs(t), 6, "m", "max")


# stretches long enough for a window: from a gene's first exon to its last
_BODIES = "(select gene as exon, chrom, strand, min(start_pos) as start_pos, max(end_pos) as end_pos from fx_exons group by gene, chrom, strand)"


@query("motif_score_mean", f"exon:s strand:s {KEYS} m_wtMEAN:d m_snvMEAN:d m_chgMEAN:d kind:s",
       f"""select null as exon, null as strand, *, 'listed' as kind from {_motif_sql('avg', 'MEAN')}
       union all
       select x.exon, x.strand, x.chrom, x.pos, x.ref, x.alt, avg(coalesce(a.score, 0)), avg(coalesce(b.score, 0)), avg(coalesce(b.score, 0)) - avg(coalesce(a.score, 0)), 'exon' from (
         select *, substr(w, k + 1, 6) as kw, substr(concat(substr(w, 1, 5), alt, substr(w, 7)), k + 1, 6) as ks from (
           select e.exon, e.strand, b.chrom, b.pos, case when e.strand = '-' then translate(b.base, 'ACGT', 'TGCA') else b.base end as ref, c.alt,
             case when e.strand = '-' then {revc(atn('b.pos - 5', 11))} else {atn('b.pos - 5', 11)} end as w
           from fx_base b join {_BODIES} e on b.pos between e.start_pos + 5 and e.end_pos - 5, {ORACLE_REF} r, (select unnest(['A', 'C', 'G', 'T']) as alt) c)
         , (select unnest(range(6)) as k) k where alt <> ref) x
       left join {_MOTIFS} a on a.kmer = x.kw left join {_MOTIFS} b on b.kmer = x.ks group by 1, 2, 3, 4, 5, 6""")
def _(t):
    listed = S.motif_scores(t("fx_scores"), chunks(t), motifs(t), 6, "m", "mean").withColumn("kind", F.lit("listed"))
    bodies = t("fx_exons").groupBy(F.col("gene").alias("exon"), "chrom", "strand").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    exon = S.motif_score_exon(bodies, chunks(t), motifs(t), 6, "m").withColumn("kind", F.lit("exon"))
    return listed.unionByName(exon, allowMissingColumns=True)


@query("wt_binding", "chrom:s pos:i ref:s m_WT:d",
       f"""select v.chrom, v.pos, v.ref, avg(coalesce(a.score, 0)) as "m_WT" from (
         select s.chrom, s.pos, s.ref, {atn('s.pos - 6 + k', 6)} as kw from (select distinct chrom, pos, ref from fx_scores) s, {ORACLE_REF} r, (select unnest(range(6)) as k) k
         where s.pos between (select min(pos) + 7 from fx_scores) and (select max(pos) - 6 from fx_scores)) v left join {_MOTIFS} a on a.kmer = v.kw group by 1, 2, 3""")
def _(t):
    return S.wt_binding(t("fx_scores"), chunks(t), motifs(t), 6, "m")


# ---- window tables: the score is a fixed function of the text, the table lists the windows that occur

_WS = "(length(replace({0}, 'A', '')) * 3 + length(replace({0}, 'CG', '')) * 2 + length(replace({0}, 'T', '')) * 5 + ascii(substr({0}, 3, 1))) / 1e1"


def table(*windows):
    one = windows[0]
    for w in windows[1:]:
        one = one.union(w)
    return one.distinct().toDF("window").withColumn("score", F.expr(_WS.format("window")))


_SITES = [1300, 1500, 2000]


def _site_sql(kind, before, after, rev=False):
    cols = []
    for s in _SITES:
        text = f"concat({atn(f'{s} - {before}', f'cast(v.pos - {s} + {before} as bigint)')}, v.alt, {atn('v.pos + 1', f'cast({s} + {after} - v.pos as bigint)')})"
        cols.append(f"case when v.pos between {s} - {before} and {s} + {after} then {_WS.format(revc(text) if rev else text)} end as {kind}_{s}")
    return ", ".join(cols)


@query("window_lookup_score", f"{KEYS} wt_acc_pr:d wt_don_pr:d " + " ".join(f"{k}_{s}:d" for k in ("acc", "don") for s in _SITES),
       f"""select v.chrom, v.pos, v.ref, v.alt, {_WS.format(atn('v.pos - 20', 23))} as wt_acc_pr, {_WS.format(atn('v.pos - 2', 9))} as wt_don_pr,
       {_site_sql('acc', 20, 2)}, {_site_sql('don', 2, 6)} from fx_scores v, {ORACLE_REF} r""")
def _(t):
    v, c = t("fx_scores"), chunks(t)
    tabs = {k: table(S.site_windows(v, c, k).select("window"), S.variant_site_windows(v, c, _SITES, k).select("window")) for k in ("acc", "don")}
    out = S.window_lookup_wt(v, c, tabs["acc"], tabs["don"])
    for k in ("acc", "don"):
        out = S.window_lookup_variants(out, c, _SITES, k, tabs[k])
    return out


@query("window_lookup_reverse", f"{KEYS} wt_acc_pr:d wt_don_pr:d " + " ".join(f"don_{s}:d" for s in _SITES),
       f"""select v.chrom, v.pos, translate(v.ref, 'ACGT', 'TGCA') as ref, v.alt, {_WS.format(revc(atn('v.pos - 2', 23)))} as wt_acc_pr, {_WS.format(revc(atn('v.pos - 6', 9)))} as wt_don_pr,
       {_site_sql('don', 6, 2, True)} from fx_scores v, {ORACLE_REF} r""")
def _(t):
    v, c = t("fx_scores").withColumn("ref", Q.complement("ref")), chunks(t)
    acc = table(S.site_windows(v, c, "acc", True).select("window"))
    don = table(S.site_windows(v, c, "don", True).select("window"), S.variant_site_windows(v, c, _SITES, "don", True).select("window"))
    return S.window_lookup_variants(S.window_lookup_wt(v, c, acc, don, True), c, _SITES, "don", don, True)


_FLAGS = {"wt_acc_maxent": ("fa", "acc"), "wt_don_maxent": ("fd", "don"), "snv_acc_maxent": ("sa", "acc"), "snv_don_maxent": ("sd", "don")}


def _flag_sql(base, kind, alt):
    spans = S.FLAGGED_SPANS[kind]
    mid = "v.alt" if alt else atn("v.pos", 1)
    return "case " + " ".join(f"when {base} = '{b}' then {_WS.format(f'concat({atn(f'v.pos - {x}', x)}, {mid}, {atn('v.pos + 1', y)})')}" for b, (x, y) in spans.items()) + " end"


@query("flagged_site_scores", f"{KEYS} wt_acc_maxent:d wt_don_maxent:d snv_acc_maxent:d snv_don_maxent:d",
       f"""select v.chrom, v.pos, v.ref, v.alt, case when score_a > 0.2 then {_flag_sql('v.ref', 'acc', False)} end as wt_acc_maxent, case when score_a > 0.4 then {_flag_sql('v.ref', 'don', False)} end as wt_don_maxent,
       {_flag_sql('v.alt', 'acc', True)} as snv_acc_maxent, {_flag_sql('v.alt', 'don', True)} as snv_don_maxent from fx_scores v, {ORACLE_REF} r""")
def _(t):
    v = t("fx_scores").withColumns({
        "fa": (F.col("score_a") > 0.2) & F.col("ref").isin("A", "G"), "fd": (F.col("score_a") > 0.4) & F.col("ref").isin("G", "T"),
        "sa": F.col("alt").isin("A", "G"), "sd": F.col("alt").isin("G", "T")})
    w = S.flagged_windows(v, chunks(t), _FLAGS)
    tabs = {k: table(*[w.filter(F.col(o).isNotNull()).select(o) for o, (_, kind) in _FLAGS.items() if kind == k]) for k in ("acc", "don")}
    return S.flagged_site_scores(v, chunks(t), _FLAGS, tabs)


_INDEL = f"""(select s.chrom, s.pos, case when s.pos % 7 = 0 then {atn('s.pos', 3)} else s.ref end as ref, case when s.pos % 5 = 0 then concat(s.alt, 'AC') else s.alt end as alt from fx_scores s, {ORACLE_REF} r)"""


def _scan_sql(size, name):
    begin = f"v.pos + i - {size} + lr - 1"
    var = f"concat({atn(f'{begin} + 1', f'cast(v.pos - 1 - ({begin}) as bigint)')}, v.alt, {atn('v.pos + lr', 'cast(i + lr - la as bigint)')})"
    return f"""(select chrom, pos, ref, alt, case when abs(max(d)) >= abs(min(d)) then max(d) else min(d) end as {name} from (
      select v.*, {_WS.format(var)} - {_WS.format(atn(f'{begin} + 1', size))} as d from (select *, unnest(range(la - lr, {size} - lr - 1)) as i from (select *, length(ref) as lr, length(alt) as la from {_INDEL})) v, {ORACLE_REF} r) group by 1, 2, 3, 4)"""


@query("window_delta_scan", f"{KEYS} maxent_3ss:d maxent_5ss:d",
       f"select a.*, b.maxent_5ss from {_scan_sql(23, 'maxent_3ss')} a join {_scan_sql(9, 'maxent_5ss')} b on a.pos = b.pos and a.ref = b.ref and a.alt = b.alt")
def _(t):
    v = with_window(t("fx_scores"), chunks(t), 0, 2, "w")
    v = v.select("chrom", "pos", F.when(F.col("pos") % 7 == 0, F.col("w")).otherwise(F.col("ref")).alias("ref"), F.when(F.col("pos") % 5 == 0, F.concat("alt", F.lit("AC"))).otherwise(F.col("alt")).alias("alt"))
    v = write_once(v, "changes")
    tabs = {}
    for size, name in ((23, "maxent_3ss"), (9, "maxent_5ss")):
        w = S.scan_windows(v, chunks(t), size)
        tabs[size] = (name, table(w.select("wt"), w.select("var")))
    # up to 31 windows a variant
    return S.window_delta_scan(v, chunks(t), tabs, tasks=4 * t.tasks("orders"))


# ---- inputs of splicing models

_IN_EXON = f"(select concat(e.gene, '.', e.exon_num) as exon, e.strand, e.start_pos, e.end_pos, v.chrom, v.pos, v.ref, v.alt, r.s from fx_scores v join fx_exons e on v.pos between e.start_pos and e.end_pos, {ORACLE_REF} r)"


def _changed(end):
    """Oracle text of an exon after the change."""
    return f"concat({atn('start_pos', 'cast(pos - start_pos as bigint)')}, alt, {atn('pos + length(ref)', f'cast({end} - pos - length(ref) + 1 as bigint)')})"


@query("skip_model_input", f"exon:s strand:s {KEYS} refseq:s altseq:s psi:d",
       f"""with f as (select *, {atn('start_pos', 'cast(end_pos - start_pos + 1 as bigint)')} as a, {_changed('end_pos')} as b, lower({atn('end_pos + 1', 6)}) as right_in, lower({atn('start_pos - 6', 6)}) as left_in from {_IN_EXON} r)
       select exon, strand, chrom, pos, ref, alt, 0.4 as psi,
         case when strand = '-' then reverse(translate(concat(left_in, a), 'ACGTacgt', 'TGCAtgca')) else concat(a, right_in) end as refseq,
         case when strand = '-' then reverse(translate(concat(left_in, b), 'ACGTacgt', 'TGCAtgca')) else concat(b, right_in) end as altseq from f""")
def _(t):
    return S.skip_model_input(t("fx_scores"), _named_exons(t).withColumn("psi", F.lit(0.4)), chunks(t))


def _named_exons(t):
    return t("fx_exons").select(F.concat_ws(".", "gene", "exon_num").alias("exon"), "chrom", "strand", "start_pos", "end_pos")


# the shorter form ends in the exon's middle
@query("donor_model_input", f"exon:s strand:s {KEYS} donor:i refseq:s altseq:s",
       f"""with f as (select *, case when strand = '-' then start_pos + 5 else start_pos + 4 end as donor, {atn('start_pos', 10)} as a, {_changed('end_pos')} as b from {_IN_EXON} r)
       select exon, strand, chrom, pos, ref, alt, donor,
         case when strand = '-' then reverse(translate(concat(lower(substr(a, 1, 5)), substr(a, 6)), 'ACGTacgt', 'TGCAtgca')) else concat(substr(a, 1, 5), lower(substr(a, 6))) end as refseq,
         case when strand = '-' then reverse(translate(concat(lower(substr(b, 1, 5)), substr(b, 6)), 'ACGTacgt', 'TGCAtgca')) else concat(substr(b, 1, 5), lower(substr(b, 6))) end as altseq from f""")
def _(t):
    exons = _named_exons(t).withColumn("donor", F.col("start_pos") + F.when(F.col("strand") == "-", 5).otherwise(4))
    return S.donor_model_input(t("fx_scores"), exons, chunks(t))


# ---- tracks

_PARTS = {"ref_acc": 0, "var_acc": 15, "ref_don": 30, "var_don": 45}
TRACKS = "(select vec_id, 1300 + vec_id % 20 as pos, " + ", ".join(f"list_transform(embedding[{o + 1}:{o + 15}], lambda x: cast(x as double)) as {n}" for n, o in _PARTS.items()) + " from embeddings)"


def tracks(t):
    parts = {n: F.transform(F.slice("embedding", o + 1, 15), lambda x: x.cast("double")) for n, o in _PARTS.items()}
    return t("embeddings").select("vec_id", (F.col("vec_id") % 20 + 1300).alias("pos"), *[v.alias(n) for n, v in parts.items()])


def _nums(col):
    return F.array_join(F.transform(col, lambda x: F.round(x, 6).cast("decimal(20,6)").cast("string")), ",")


def _nums_sql(col):
    return f"array_to_string(list_transform({col}, lambda x: cast(cast(round(x, 6) as decimal(20,6)) as varchar)), ',')"


@query("indel_track_align", "vec_id:i track:s",
       f"""with a as (select vec_id, vec_id % 5 + 1 as p, 8 + vec_id % 3 as q, ref_acc as x from {TRACKS}),
       d as (select *, list_concat(list_concat(x[1:p + 1], [0.0::double, 0.0::double]), x[p + 2:]) as y from a),
       i as (select vec_id, list_concat(list_concat(y[1:q], [list_max(y[q + 1:q + 3])]), y[q + 4:]) as z from d)
       select vec_id, {_nums_sql('z')} as track from i""")
def _(t):
    ch = F.array(F.struct((F.col("vec_id") % 3 + 8).cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("ATT").alias("alt")),
                 F.struct((F.col("vec_id") % 5 + 1).cast("int").alias("pos"), F.lit("ACG").alias("ref"), F.lit("A").alias("alt")))
    return tracks(t).withColumn("track", _nums(S.indel_track_align(F.col("ref_acc"), ch)))


_EV = ["AG", "AL", "DG", "DL"]


def event_cols(suffix):
    return " ".join(f"DS_{e}{suffix}:d DP_{e}{suffix}:i" for e in _EV) + f" DS_max{suffix}:d DS_max{suffix}_type:s POS_max{suffix}:i"


def event_sql(suffix, src):
    """Scores and places from the arrays da and dd of ``src``."""
    parts = []
    for k, d in (("A", "da"), ("D", "dd")):
        parts.append(f'abs(least(0, list_min({d}))) as "DS_{k}G{suffix}", greatest(0, list_max({d})) as "DS_{k}L{suffix}", '
                     f'list_position({d}, list_min({d})) - 8 as "DP_{k}G{suffix}", list_position({d}, list_max({d})) - 8 as "DP_{k}L{suffix}"')
    names = [f'"DS_{e}{suffix}"' for e in _EV]
    top = f"greatest({', '.join(names)})"
    kind = " ".join(f"when {n} = {top} then '{n.strip(chr(34))}'" for n in names)
    place = " ".join(f'when {n} = {top} then "DP_{e}{suffix}"' for n, e in zip(names, _EV))
    return f"""select *, {top} as "DS_max{suffix}", case {kind} end as "DS_max{suffix}_type", case {place} end as "POS_max{suffix}" from (select *, {', '.join(parts)} from ({src}))"""


_DIFF = "list_transform(range(1, 16), lambda i: ref_{0}[i] - var_{0}[i])"
_RAW = f"select *, {_DIFF.format('acc')} as ra, {_DIFF.format('don')} as rd from {TRACKS}"


@query("delta_scores", f"vec_id:i acc_abs_chg:d don_abs_chg:d {event_cols('')}",
       event_sql("", f"select *, ra as da, rd as dd, list_sum(list_transform(ra, lambda x: abs(x))) as acc_abs_chg, list_sum(list_transform(rd, lambda x: abs(x))) as don_abs_chg from ({_RAW})"))
def _(t):
    return S.delta_scores(tracks(t))


def _w(d, weight):
    return f"list_transform(range(1, 16), lambda i: case when {d}[i] > 0 then {d}[i] * ({weight}) when {d}[i] < 0 then {d}[i] * (1 - ({weight})) else 0e0 end)"


_ACC, _DON = ("vec_id % 7 - 7", "vec_id % 5"), ("vec_id % 6 - 6", "vec_id % 4 + 1")


def _bounds(t):
    return tracks(t).withColumns({
        "acceptors": F.array(*[F.expr(f"cast({x} as int)") for x in _ACC]), "donors": F.array(*[F.expr(f"cast({x} as int)") for x in _DON]),
        "acc_use": F.map_from_arrays(F.array(*[F.expr(f"cast({x} as int)") for x in _ACC]), F.expr("array(vec_id % 10 / 1e1, 0.5D)")),
        "don_use": F.map_from_arrays(F.array(*[F.expr(f"cast({x} as int)") for x in _DON]), F.expr("array(0.25D, vec_id % 4 / 4e0)"))})


_IN = "case when i - 8 = {0} or i - 8 = {1} then 1e0 else 0e0 end"


@query("delta_scores_masked", f"vec_id:i {event_cols('m')}",
       event_sql("m", f"select *, {_w('ra', _IN.format(*_ACC))} as da, {_w('rd', _IN.format(*_DON))} as dd from ({_RAW})"))
def _(t):
    return S.delta_scores_masked(_bounds(t))


_UA = "case when i - 8 = {0} then vec_id % 10 / 1e1 when i - 8 = {1} then 0.5e0 else 0e0 end".format(*_ACC)
_UD = "case when i - 8 = {0} then 0.25e0 when i - 8 = {1} then vec_id % 4 / 4e0 else 0e0 end".format(*_DON)
_SIGNED = ", ".join(f"coalesce(list_sum(list_filter({d}, lambda x: x {o} 0)), 0) as \"{k}_chg\"" for k, d, o in (("AL", "ra", ">"), ("AG", "ra", "<"), ("DL", "rd", ">"), ("DG", "rd", "<")))


@query("delta_scores_usage", f"vec_id:i AL_chg:d AG_chg:d DL_chg:d DG_chg:d {event_cols('rw')}",
       event_sql("rw", f"select *, {_w('ra', _UA)} as da, {_w('rd', _UD)} as dd, {_SIGNED} from ({_RAW})"))
def _(t):
    return S.delta_scores_usage(_bounds(t))


@query("site_probabilities", "vec_id:i wt_acc_pr:d wt_don_pr:d ss_acc_prob_1305:d ss_don_prob_1305:d ss_acc_prob_1321:d ss_don_prob_1321:d",
       f"""select vec_id, ref_acc[8] as wt_acc_pr, ref_don[8] as wt_don_pr, {', '.join(f'case when {s} - pos between -7 and 7 then var_{k}[8 + {s} - pos] end as ss_{k}_prob_{s}' for s in (1305, 1321) for k in ('acc', 'don'))} from {TRACKS}""")
def _(t):
    return S.site_probabilities(tracks(t), [1305, 1321])


@query("track_long", "vec_id:i position:i ref_acc:d var_acc:d ref_don:d var_don:d diff_acc:d diff_don:d",
       f"""select vec_id, pos - 8 + i as position, ref_acc[i] as ref_acc, var_acc[i] as var_acc, ref_don[i] as ref_don, var_don[i] as var_don, ref_acc[i] - var_acc[i] as diff_acc, ref_don[i] - var_don[i] as diff_don
       from {TRACKS}, (select unnest(range(1, 16)) as i) where pos - 8 + i between pos - 3 and pos + 4""")
def _(t):
    return S.track_long(tracks(t), F.col("pos") - 3, F.col("pos") + 4)


def stub_ensemble():
    """A stand-in for a trained model: two members that read a value off each base.

    Built here as a closure, so that tasks do not need this package.
    """

    def load():
        import numpy as np

        values = np.zeros(128)
        values[[65, 67, 71, 84]] = [0.1, 0.2, 0.3, 0.4]

        def member(scale):
            def run(seqs):
                v = values[np.array([[ord(c) for c in s] for s in seqs])] * scale
                return np.stack([1 - v, v, v / 2], axis=2)

            return run

        return [member(1.0), member(3.0)]

    return load


_VAL = "case {0} when 'A' then 0.2e0 when 'C' then 0.4e0 when 'G' then 0.6e0 when 'T' then 0.8e0 else 0e0 end"
_CH = "case when strand = '-' then translate(substr({0}, i, 1), 'ACGT', 'TGCA') else substr({0}, i, 1) end"


@query("score_batches", f"{KEYS} ref_sum:d var_sum:d center:d",
       f"""with v as (select v.*, case when v.pos % 2 = 0 then '+' else '-' end as strand, {atn('v.pos - 5', 11)} as rs, concat({atn('v.pos - 5', 5)}, v.alt, {atn('v.pos + 1', 5)}) as vs from fx_scores v, {ORACLE_REF} r),
       x as (select chrom, pos, ref, alt, i, {_VAL.format(_CH.format('rs'))} as a, {_VAL.format(_CH.format('vs'))} as b from v, (select unnest(range(1, 12)) as i))
       select chrom, pos, ref, alt, sum(a * i) as ref_sum, sum(b / 2 * i) as var_sum, max(b) filter (where i = 6) as center from x group by 1, 2, 3, 4""")
def _(t):
    w = S.context_windows(stranded(t).select(*VAR, "strand"), chunks(t), 5)
    out = S.score_batches(w, stub_ensemble())

    def weighted(col):
        return F.aggregate(F.transform(col, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)

    return out.select(*VAR, weighted("ref_acc").alias("ref_sum"), weighted("var_don").alias("var_sum"), F.get("var_acc", F.lit(5)).alias("center"))
