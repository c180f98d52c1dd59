"""Sequence windows scored as table jobs: motif tables, window tables and probability tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import KEY, position_bin
from juncture.functions.sequence import kmers, reverse_complement
from juncture.operators.annotation import BIN, bins_of
from juncture.operators.reference import CHUNK, FLANK, check_reference, with_span, with_window
from juncture.sources.sinks import explode_range

CHANGE = "struct<pos:int,ref:string,alt:string>"


# ---- context windows --------------------------------------------------------------------------


def _apply(seq: Column, changes: Column, center: Column, half: int, same_length: bool) -> Column:
    """Apply changes, given in order, to a window around a position; checks every reference base that isn't masked."""

    def step(acc: Column, c: Column) -> Column:
        at = c["pos"] - center + half + 1
        here = F.upper(F.substr(acc, at, F.length(c["ref"])))
        # masked bases are N and go with anything
        ok = F.rlike(F.upper(c["ref"]), F.concat(F.lit("^"), F.translate(here, "N", "."), F.lit("$"))) & ((F.length(c["ref"]) == F.length(c["alt"])) | F.lit(not same_length))
        changed = F.concat(F.substr(acc, F.lit(1), at - 1), c["alt"], F.substr(acc, at + F.length(c["ref"])))
        return F.when(ok, changed).otherwise(F.raise_error(F.concat(F.lit("reference mismatch at "), c["pos"].cast("string"))))

    return F.aggregate(changes, seq, step)


def context_windows(variants: DataFrame, chunks: DataFrame, half: int, chunk: int = CHUNK, flank: int = FLANK) -> DataFrame:
    """Reference and variant sequence around each variant, in the direction of its strand.

    Columns read: the key, ``strand``, and optionally ``left_out``/``right_out`` (bases outside the gene,
    replaced by N), ``haplotype`` (further changes of the variant sequence) and ``background``
    (substitutions of both sequences).  Changes go in from the right, so indels do not move the rest.
    """
    has = set(variants.columns)
    df = with_window(variants, chunks, half, half, "_w", chunk=chunk, flank=flank)
    left = F.col("left_out") if "left_out" in has else F.lit(0)
    right = F.col("right_out") if "right_out" in has else F.lit(0)
    size = 2 * half + 1
    masked = F.concat(
        F.repeat(F.lit("N"), left.cast("int")), F.substr("_w", (left + 1).cast("int"), (F.lit(size) - left - right).cast("int")), F.repeat(F.lit("N"), right.cast("int"))
    )
    none = F.array().cast(f"array<{CHANGE}>")
    background = F.coalesce("background", none) if "background" in has else none
    others = F.coalesce("haplotype", none) if "haplotype" in has else none
    own = F.struct(F.col("pos").cast("int").alias("pos"), F.col("ref").alias("ref"), F.col("alt").alias("alt")).cast(CHANGE)
    changes = F.reverse(F.array_sort(F.concat(others, F.array(own))))
    df = df.withColumn("_r", _apply(masked, background, F.col("pos"), half, True))
    df = df.withColumn("_v", _apply(F.col("_r"), changes, F.col("pos"), half, False))
    rev = F.col("strand") == "-"
    return df.withColumns(
        {
            "ref_seq": F.when(rev, reverse_complement("_r")).otherwise(F.col("_r")),
            "var_seq": F.when(rev, reverse_complement("_v")).otherwise(F.col("_v")),
        }
    ).drop("_w", "_r", "_v")


# ---- motif tables -----------------------------------------------------------------------------


def _score_kmers(windows: DataFrame, keys: list[str], motifs: DataFrame, k: int, stat: str, stem: str, missing: float | None = 0.0) -> DataFrame:
    """Largest or mean motif score of the k-mers of ``_wt`` and ``_snv``; a missing motif counts 0."""
    each = F.array(*[F.struct(F.lit(n).alias("which"), kmers(f"_{n}", k).alias("kmers")) for n in ("wt", "snv")])
    long = windows.select(*keys, F.explode(each).alias("e")).select(*keys, "e.which", F.explode("e.kmers").alias("kmer"))
    hit = long.join(motifs.select("kmer", "score"), "kmer", "left")
    value = F.coalesce("score", F.lit(missing)).cast("double")
    fn = F.max if stat == "max" else F.avg
    tag = "MAX" if stat == "max" else "MEAN"
    out = hit.groupBy(*keys).agg(*[fn(F.when(F.col("which") == n, value)).alias(f"{stem}_{n}{tag}") for n in ("wt", "snv")])
    return out.withColumn(f"{stem}_chg{tag}", F.col(f"{stem}_snv{tag}") - F.col(f"{stem}_wt{tag}"))


def _with_snv(df: DataFrame, k: int) -> DataFrame:
    changed = F.concat(F.substr("_wt", F.lit(1), F.lit(k - 1)), F.col("alt"), F.substr("_wt", F.lit(k + 1), F.lit(k - 1)))
    return df.withColumn("_snv", F.when(F.substr("_wt", F.lit(k), F.lit(1)) != F.col("alt"), changed))


def motif_scores(tbv: DataFrame, chunks: DataFrame, motifs: DataFrame, k: int, stem: str, stat: str = "max") -> DataFrame:
    """Score of the 2k-1 bases around each variant before and after the change."""
    windows = _with_snv(with_window(tbv.select(*KEY), chunks, k - 1, k - 1, "_wt"), k)
    return tbv.join(_score_kmers(windows, KEY, motifs, k, stat, stem), KEY, "left")


def motif_score_exon(exons: DataFrame, chunks: DataFrame, motifs: DataFrame, k: int, stem: str) -> DataFrame:
    """Mean scores of every possible change of each exon whose windows lie inside it.

    ``exons`` has (exon, chrom, strand, start_pos, end_pos), 1-based and both included. Alleles are those of the strand,
    positions 1-based on both. A change that several exons hold gets a row in each.
    """
    ranges = exons.select("exon", "chrom", "strand", (F.col("start_pos") + k - 1).alias("_lo"), (F.col("end_pos") - k + 1).alias("_hi")).filter("_lo <= _hi")
    df = with_window(explode_range(ranges, "_lo", "_hi", "pos").drop("_lo", "_hi"), chunks, k - 1, k - 1, "_wt")
    df = df.withColumn("_wt", F.when(F.col("strand") == "-", reverse_complement("_wt")).otherwise(F.col("_wt")))
    df = df.withColumn("ref", F.substr("_wt", F.lit(k), F.lit(1)))
    df = df.withColumn("alt", F.explode(F.array_except(F.array(*[F.lit(b) for b in "ACGT"]), F.array("ref"))))
    return _score_kmers(_with_snv(df, k), ["exon", "strand", *KEY], motifs, k, "mean", stem)


def wt_binding(tbv: DataFrame, chunks: DataFrame, motifs: DataFrame, k: int, stem: str) -> DataFrame:
    """Mean score of the k k-mers that start before each position, away from the ends of its contig in the table."""
    bounds = tbv.groupBy("chrom").agg((F.min("pos") + k + 1).alias("_lo"), (F.max("pos") - k).alias("_hi"))
    keep = [c for c in ("ref", "hgvs_pos") if c in tbv.columns]
    sites = tbv.groupBy("chrom", "pos").agg(*[F.min(c).alias(c) for c in keep])
    sites = sites.join(bounds, "chrom").filter(F.col("pos").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    windows = with_window(sites, chunks, k, k - 2, "_wt").withColumn("_snv", F.lit(None).cast("string"))
    out = _score_kmers(windows, ["chrom", "pos"], motifs, k, "mean", stem)
    return sites.join(out.select("chrom", "pos", F.col(f"{stem}_wtMEAN").alias(f"{stem}_WT")), ["chrom", "pos"])


# ---- window tables ----------------------------------------------------------------------------

# bases before and after a splice site, on its own strand: first exonic base of an acceptor, last of a donor
SITE_SPANS = {"acc": (20, 2), "don": (2, 6)}


def _site_span(kind: str, rev: bool) -> tuple[int, int]:
    before, after = SITE_SPANS[kind]
    return (after, before) if rev else (before, after)


def site_windows(sites: DataFrame, chunks: DataFrame, kind: str, rev: bool = False, out: str = "window") -> DataFrame:
    """The 23 bases of an acceptor or the 9 of a donor around each position, mirrored on the minus strand."""
    before, after = _site_span(kind, rev)
    df = with_window(sites, chunks, before, after, out)
    return df.withColumn(out, reverse_complement(out)) if rev else df


def lookup(df: DataFrame, table: DataFrame, window: str, out: str) -> DataFrame:
    """Score of a window from a table (window, score)."""
    return df.join(table.select(F.col("window").alias(window), F.col("score").alias(out)), window, "left")


def window_lookup_wt(positions: DataFrame, chunks: DataFrame, acc: DataFrame, don: DataFrame, rev: bool = False) -> DataFrame:
    """Acceptor and donor score of every position as it stands."""
    df = site_windows(positions, chunks, "acc", rev, "_a")
    df = lookup(site_windows(df, chunks, "don", rev, "_d"), acc, "_a", "wt_acc_pr")
    return lookup(df, don, "_d", "wt_don_pr").drop("_a", "_d")


def variant_site_windows(tbv: DataFrame, chunks: DataFrame, sites: list[int], kind: str, rev: bool = False) -> DataFrame:
    """Windows of listed sites with each variant inside them (chrom, pos, ref, alt, site, window).

    The reference allele of a minus-strand table is read on its strand, the alternate one is used as
    it is, before the window is turned.
    """
    before, after = _site_span(kind, rev)
    span = before + after
    df = with_window(tbv.select(*KEY), chunks, span, span, "_w")
    here = F.substr("_w", F.lit(span + 1), F.lit(1))
    same = F.upper(reverse_complement("ref") if rev else F.col("ref")) == here
    df = df.withColumn("_w", F.when(same, F.col("_w")).otherwise(F.raise_error(F.lit("reference mismatch")).cast("string")))
    near = F.filter(F.array(*[F.lit(s) for s in sites]), lambda s: F.col("pos").between(s - before, s + after))
    df = df.withColumn("site", F.explode(near))
    changed = F.concat(F.substr("_w", F.lit(1), F.lit(span)), F.col("alt"), F.substr("_w", F.lit(span + 2)))
    cut = F.substr(changed, F.col("site") - before - F.col("pos") + span + 1, F.lit(span + 1))
    return df.select(*KEY, "site", (reverse_complement(cut) if rev else cut).alias("window"))


def window_lookup_variants(tbv: DataFrame, chunks: DataFrame, sites: list[int], kind: str, table: DataFrame, rev: bool = False) -> DataFrame:
    """Score of listed sites with each variant, a column per site; null when the variant is outside."""
    scored = lookup(variant_site_windows(tbv, chunks, sites, kind, rev), table, "window", "score")
    wide = scored.groupBy(*KEY).agg(*[F.max(F.when(F.col("site") == s, F.col("score"))).alias(f"{kind}_{s}") for s in sites])
    return tbv.join(wide, KEY, "left")


# window of a flagged base by what the base is: bases before it and after it
FLAGGED_SPANS = {"acc": {"A": (18, 4), "G": (19, 3)}, "don": {"G": (3, 5), "T": (4, 4)}}


def flagged_windows(tbv: DataFrame, chunks: DataFrame, flags: dict[str, tuple[str, str]]) -> DataFrame:
    """Add the site window of rows under a flag; ``flags`` maps an output to (flag column, site kind).

    Outputs that start with ``snv`` use the alternate base.
    """
    span = 20
    df = with_window(tbv, chunks, span, span, "_w")
    cols = {}
    for out, (flag, kind) in flags.items():
        base = F.col("alt") if out.startswith("snv") else F.substr("_w", F.lit(span + 1), F.lit(1))
        text = F.concat(F.substr("_w", F.lit(1), F.lit(span)), base, F.substr("_w", F.lit(span + 2)))
        window = F.lit(None).cast("string")
        for b, (before, after) in FLAGGED_SPANS[kind].items():
            window = F.when(base == b, F.substr(text, F.lit(span + 1 - before), F.lit(before + after + 1))).otherwise(window)
        bad = F.raise_error(F.concat(F.lit(f"no {kind} base at "), F.col("pos").cast("string"))).cast("string")
        cols[out] = F.when(F.coalesce(F.col(flag), F.lit(False)), F.coalesce(window, bad))
    return df.withColumns(cols).drop("_w")


def flagged_site_scores(tbv: DataFrame, chunks: DataFrame, flags: dict[str, tuple[str, str]], tables: dict[str, DataFrame]) -> DataFrame:
    """Scores of the windows of :func:`flagged_windows`."""
    df = flagged_windows(tbv, chunks, flags)
    for out, (_, kind) in flags.items():
        df = lookup(df.withColumnRenamed(out, "_x"), tables[kind], "_x", out).drop("_x")
    return df


def scan_windows(tbv: DataFrame, chunks: DataFrame, size: int, rev: bool = False) -> DataFrame:
    """Every scored window over a variant, before and after it (key, step, wt, var); handles indels of any length."""
    left = size + 1
    # what lies in a chunk's flank is one lookup; longer reference alleles are put together from their chunks
    within = F.length("ref") + size <= FLANK
    keys = tbv.select(*KEY)
    near = with_window(keys.filter(within), chunks, left, FLANK, "_w")
    far = keys.filter(~within).withColumns({"_from": F.col("pos") - left, "_to": F.col("pos") + F.length("ref") + size})
    far = with_span(far, chunks, "_from", "_to", "_w").select(*near.columns)
    df = check_reference(near.unionByName(far), "_w", left)
    r, a = F.length("ref"), F.length("alt")
    first, last = a - r, F.lit(size) - r - 2
    df = df.filter(first <= last).withColumn("step", F.explode(F.sequence(first, last)))

    def part(start: Column, end: Column) -> Column:
        """Bases [start, end), 0-based, around the variant."""
        return F.substr("_w", start - F.col("pos") + left + 2, end - start)

    p, i = F.col("pos"), F.col("step")
    begin = p + i - size + r - 1
    wt = part(begin, begin + size)
    var = F.concat(part(begin, p - 1), F.col("alt"), part(p + r - 1, p + i + r - 1 + (r - a)))
    turn = reverse_complement if rev else (lambda c: c)
    return df.select(*KEY, "step", turn(wt).alias("wt"), turn(var).alias("var"))


def window_delta_scan(
    tbv: DataFrame, chunks: DataFrame, tables: dict[int, tuple[str, DataFrame]], rev: bool = False, tasks: int | None = None
) -> DataFrame:
    """Change of largest size, with its sign, over all windows of a variant.

    ``tables`` maps a window size to (output column, score table).  A rise wins a tie. The windows are shared by ``tasks`` tasks
    when they meet the tables, or by as many as Spark chooses.
    """

    def dealt(df: DataFrame, window: str) -> DataFrame:
        return df.repartition(tasks, window) if tasks else df

    out = tbv
    for size, (name, table) in tables.items():
        w = scan_windows(tbv, chunks, size, rev)
        w = lookup(dealt(lookup(dealt(w, "wt"), table, "wt", "_wt").select(*KEY, "var", "_wt"), "var"), table, "var", "_var")
        d = F.col("_var") - F.col("_wt")
        ends = w.groupBy(*KEY).agg(F.max(d).alias("_hi"), F.min(d).alias("_lo"))
        best = F.when(F.abs("_hi") >= F.abs("_lo"), F.col("_hi")).otherwise(F.col("_lo"))
        out = out.join(ends.select(*KEY, best.alias(name)), KEY, "left")
    return out


# ---- inputs of splicing models ----------------------------------------------------------------


def _in_stretch(variants: DataFrame, stretches: DataFrame, chunks: DataFrame, lo: str, hi: str, first: str, last: str, width: int) -> DataFrame:
    """Variants at ``first`` to ``last`` of each stretch, with the reference from ``lo`` to ``hi`` in ``_s``; stops where an allele differs.

    The bases are looked up once per stretch; variants then meet the stretches by bins of positions.
    """
    held = with_span(stretches, chunks, lo, hi, "_s").withColumn("_bin", bins_of(F.col(first), F.col(last), width))
    rows = variants.withColumn("_bin", position_bin(F.col("pos"), width)).join(held, ["chrom", "_bin"]).drop("_bin")
    rows = rows.filter(F.col("pos").between(F.col(first), F.col(last)))
    here = F.substr("_s", F.col("pos") - F.col(lo) + 1, F.length("ref"))
    ok = F.when(here == F.upper("ref"), F.col("_s")).otherwise(F.raise_error(F.lit("reference mismatch")).cast("string"))
    return rows.withColumns({"_s": ok, "alt": F.upper("alt")})


def skip_model_input(variants: DataFrame, exons: DataFrame, chunks: DataFrame, width: int = BIN) -> DataFrame:
    """Exonic variants: the exon in capitals and six intron bases after it in small letters, both alleles.

    ``exons`` has (chrom, strand, start_pos, end_pos), 1-based and both included, and any other columns, such as a name
    and the inclusion of the exon; they go along. A variant in several exons gets a row in each.
    """
    rev = F.col("strand") == "-"
    held = exons.withColumns({"_lo": F.col("start_pos") - F.when(rev, 6).otherwise(0), "_hi": F.col("end_pos") + F.when(rev, 0).otherwise(6)})
    df = _in_stretch(variants, held, chunks, "_lo", "_hi", "start_pos", "end_pos", width)
    size = F.col("end_pos") - F.col("start_pos") + 1
    ex = F.substr("_s", F.when(rev, 7).otherwise(1), size)
    intron = F.lower(F.substr("_s", F.when(rev, 1).otherwise(size + 1), F.lit(6)))
    at = F.col("pos") - F.col("start_pos")
    changed = F.concat(F.substr(ex, F.lit(1), at), F.col("alt"), F.substr(ex, at + 1 + F.length("ref")))

    def text(body: Column) -> Column:
        return F.when(rev, reverse_complement(F.concat(intron, body))).otherwise(F.concat(body, intron))

    return df.withColumns({"refseq": text(ex), "altseq": text(changed)}).drop("_s", "_lo", "_hi")


def donor_model_input(variants: DataFrame, exons: DataFrame, chunks: DataFrame, width: int = BIN) -> DataFrame:
    """The same for two competing donors: capitals up to the first, small letters between the two.

    ``exons`` has (chrom, strand, start_pos, end_pos, donor), ``donor`` being the last base of the exon's shorter form on its
    strand, and any other columns. Bounds are 1-based and both included.
    """
    rev = F.col("strand") == "-"
    df = _in_stretch(variants, exons, chunks, "start_pos", "end_pos", "start_pos", "end_pos", width)
    small = F.when(rev, F.col("pos") < F.col("donor")).otherwise(F.col("pos") > F.col("donor"))
    cut = F.col("donor") - F.col("start_pos") + F.when(rev, 0).otherwise(1)

    def text(body: Column, split: Column) -> Column:
        head, tail = F.substr(body, F.lit(1), split), F.substr(body, split + 1)
        return F.when(rev, reverse_complement(F.concat(F.lower(head), tail))).otherwise(F.concat(head, F.lower(tail)))

    at = F.col("pos") - F.col("start_pos")
    changed = F.concat(F.substr("_s", F.lit(1), at), F.col("alt"), F.substr("_s", at + 1 + F.length("ref")))
    # bases gained or lost before the border move it
    moved = F.when(small == rev, F.length("alt") - F.length("ref")).otherwise(0)
    return df.withColumns({"refseq": text(F.col("_s"), cut), "altseq": text(changed, cut + moved)}).drop("_s")


# ---- probability tracks -----------------------------------------------------------------------


def indel_track_align(track: Column, changes: Column) -> Column:
    """Bring a variant's track to reference length.

    ``changes`` holds (pos, ref, alt) with the 0-based index in the track.  Deleted bases get 0, an
    insertion keeps its largest value.
    """

    def step(acc: Column, c: Column) -> Column:
        r, a = F.length(c["ref"]), F.length(c["alt"])
        n, at = F.size(acc), c["pos"]

        def tail(start: Column) -> Column:
            return F.slice(acc, start + 1, F.greatest(n - start, F.lit(0)))

        deleted = F.concat(F.slice(acc, F.lit(1), at + a), F.array_repeat(F.lit(0.0), r - a), tail(at + a))
        peak = F.array_max(F.slice(acc, at + 1, a - r + 1))
        inserted = F.concat(F.slice(acc, F.lit(1), at), F.array(peak), tail(at + a - r + 1))
        return F.when(r > a, deleted).when(a > r, inserted).otherwise(acc)

    return F.aggregate(F.array_sort(changes), track, step)


def _diff(ref: str, var: str) -> Column:
    return F.zip_with(ref, var, lambda x, y: x - y)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


EVENTS = ["AG", "AL", "DG", "DL"]


def _event_scores(df: DataFrame, acc: Column, don: Column, suffix: str, center: Column) -> DataFrame:
    """Gain and loss of either site kind with their places, and the largest of the four."""
    df = df.withColumns({"_da": acc, "_dd": don})
    score, place = {}, {}
    for kind, d in (("A", F.col("_da")), ("D", F.col("_dd"))):
        low, high = F.array_min(d), F.array_max(d)
        score[f"DS_{kind}G{suffix}"] = F.abs(F.least(F.lit(0.0), low))
        score[f"DS_{kind}L{suffix}"] = F.greatest(F.lit(0.0), high)
        place[f"DP_{kind}G{suffix}"] = F.array_position(d, low) - 1 - center
        place[f"DP_{kind}L{suffix}"] = F.array_position(d, high) - 1 - center
    df = df.withColumns({**score, **place})
    names = [f"DS_{e}{suffix}" for e in EVENTS]
    top = F.greatest(*names)
    kind, pos = F.lit(None).cast("string"), F.lit(None).cast("long")
    for n in reversed(names):
        kind = F.when(F.col(n) == top, F.lit(n)).otherwise(kind)
        pos = F.when(F.col(n) == top, F.col(n.replace("DS", "DP", 1))).otherwise(pos)
    return df.withColumns({f"DS_max{suffix}": top, f"DS_max{suffix}_type": kind, f"POS_max{suffix}": pos}).drop("_da", "_dd")


def _center(df_col: str = "ref_acc") -> Column:
    return F.floor((F.size(df_col) - 1) / 2)


def delta_scores(tracks: DataFrame) -> DataFrame:
    """Differences of reference and variant tracks (ref_acc, var_acc, ref_don, var_don)."""
    acc, don = _diff("ref_acc", "var_acc"), _diff("ref_don", "var_don")
    sizes = {n: _sum(F.transform(d, lambda x: F.abs(x))) for n, d in (("acc_abs_chg", acc), ("don_abs_chg", don))}
    return _event_scores(tracks.withColumns(sizes), acc, don, "", _center())


def _weighted(diff: Column, weight) -> Column:
    """A loss counts with the weight of its place, a gain with the rest."""
    return F.transform(diff, lambda x, i: F.when(x > 0, x * weight(i)).when(x < 0, x * (1 - weight(i))).otherwise(F.lit(0.0)))


def delta_scores_masked(tracks: DataFrame, acceptors: str = "acceptors", donors: str = "donors") -> DataFrame:
    """As :func:`delta_scores`, with losses only at annotated boundaries (distances) and gains elsewhere."""

    def at(bounds: str):
        return lambda i: F.when(F.array_contains(F.col(bounds), (i - _center()).cast("int")), 1.0).otherwise(0.0)

    acc, don = _weighted(_diff("ref_acc", "var_acc"), at(acceptors)), _weighted(_diff("ref_don", "var_don"), at(donors))
    return _event_scores(tracks, acc, don, "m", _center())


def delta_scores_usage(tracks: DataFrame, acc_use: str = "acc_use", don_use: str = "don_use") -> DataFrame:
    """As :func:`delta_scores`, weighted by the usage of each boundary (maps from distance to share)."""
    acc, don = _diff("ref_acc", "var_acc"), _diff("ref_don", "var_don")
    signed = {}
    for n, d in (("A", acc), ("D", don)):
        signed[f"{n}L_chg"] = _sum(F.filter(d, lambda x: x > 0))
        signed[f"{n}G_chg"] = _sum(F.filter(d, lambda x: x < 0))

    def at(use: str):
        return lambda i: F.coalesce(F.try_element_at(F.col(use), (i - _center()).cast("int")), F.lit(0.0))

    return _event_scores(tracks.withColumns(signed), _weighted(acc, at(acc_use)), _weighted(don, at(don_use)), "rw", _center())


def site_probabilities(tracks: DataFrame, sites: list[int]) -> DataFrame:
    """Probability at the centre of the reference and, with the variant, at listed genome positions."""
    c = _center()

    def at(track: str, index: Column) -> Column:
        inside = (index >= 0) & (index < F.size(track))
        return F.when(inside, F.get(F.col(track), F.when(inside, index).otherwise(F.lit(0)).cast("int")))

    cols = {"wt_acc_pr": at("ref_acc", c), "wt_don_pr": at("ref_don", c)}
    for s in sites:
        index = c + F.lit(s) - F.col("pos")
        cols[f"ss_acc_prob_{s}"] = at("var_acc", index)
        cols[f"ss_don_prob_{s}"] = at("var_don", index)
    return tracks.withColumns(cols)


def track_long(tracks: DataFrame, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """One row per position of a variant's tracks, with differences; optionally only a range."""
    z = F.arrays_zip("ref_acc", "var_acc", "ref_don", "var_don")
    keep = [c for c in tracks.columns if c not in ("ref_acc", "var_acc", "ref_don", "var_don")]
    out = tracks.select(*keep, _center().alias("_c"), F.posexplode(z).alias("_i", "z"))
    out = out.withColumn("position", F.col("pos") - F.col("_c") + F.col("_i")).select(*keep, "position", "z.*")
    if lo is not None:
        out = out.filter((F.col("position") >= lo) & (F.col("position") <= hi))
    return out.withColumns({"diff_acc": F.col("ref_acc") - F.col("var_acc"), "diff_don": F.col("ref_don") - F.col("var_don")})


def score_batches(windows: DataFrame, predictors: Callable[[], list[Callable[[list[str]], np.ndarray]]]) -> DataFrame:
    """Run predictors over (ref_seq, var_seq) and average them into four tracks.

    ``predictors`` is called once per task and returns the ensemble; each member maps sequences of one
    length to an array (sequence, position, [none, acceptor, donor]).  Minus-strand results are turned
    to the forward direction.  Windows are independent rows, so nothing is shuffled: a chromosome with
    most variants is spread like the table is.
    """
    names = ["ref_acc", "ref_don", "var_acc", "var_don"]
    keep = [f for f in windows.schema if f.name not in ("ref_seq", "var_seq")]
    order = [f.name for f in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + "".join(f", {n} array<double>" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = predictors()

        def predict(seqs: list[str]) -> list:
            out: list = [None] * len(seqs)
            sizes: dict[int, list[int]] = {}
            for i, s in enumerate(seqs):
                sizes.setdefault(len(s), []).append(i)
            for rows in sizes.values():
                got = np.mean([m([seqs[i] for i in rows]) for m in models], axis=0)
                for i, y in zip(rows, got):
                    out[i] = y
            return out

        for pdf in batches:
            cols = {n: [] for n in names}
            for kind in ("ref", "var"):
                for y, strand in zip(predict(pdf[f"{kind}_seq"].tolist()), pdf["strand"]):
                    y = y[::-1] if strand == "-" else y
                    cols[f"{kind}_acc"].append(y[:, 1].astype(float))
                    cols[f"{kind}_don"].append(y[:, 2].astype(float))
            yield pdf[order].assign(**cols)

    return windows.mapInPandas(run, schema)


def usage_map(sites: Column, use: Column) -> Column:
    """Map from distance to usage share of each boundary."""
    return F.map_from_arrays(sites, use)
