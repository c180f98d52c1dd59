"""Variant pairs: what kind of splice event each one is, and single and double changes side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import KEY, attach
from juncture.functions.coordinates import hg19_to_hg38, threshold_flag
from juncture.functions.sequence import complement
from juncture.operators.annotation import all_dnvs, all_snvs, contig_join, join_gene, merge_population
from juncture.operators.reference import with_window
from juncture.sources.sinks import write_once

DISTAL = 20


def _far(event: Column, variants: list[Column], distance: int) -> Column:
    out = F.lit(True)
    for v in variants:
        out = out & (F.abs(event - v) >= distance)
    return out


def classify_loss(event: Column, bounds: Column, variants: list[Column], distance: int = DISTAL) -> Column:
    """Is the lost site annotated, and is it away from every variant?"""
    far, native = _far(event, variants, distance), F.array_contains(bounds, event)
    return F.when(native, F.when(far, "Distal native").otherwise("Native")).otherwise(F.when(far, "Distal non-native").otherwise("Non-native"))


def classify_gain(event: Column, bounds: Column, wt: Column, var: Column, variants: list[Column], singles: list[Column] = (), distance: int = DISTAL) -> Column:
    """Annotated, already there, created or unknown.

    ``wt`` and ``var`` tell whether the site motif is present before and after; ``singles`` tell it for
    each change of a pair alone.
    """
    far, native = _far(event, variants, distance), F.array_contains(bounds, event)
    if singles:
        alone = singles[0] | singles[1]
        created = F.when(alone, "SNV created cryptic").otherwise("DNV created cryptic")
    else:
        created = F.lit("Created cryptic")
    return (
        F.when(native, F.when(far, "Distal native").otherwise("Native"))
        .when(wt & var, F.when(far, "Existing distal cryptic").otherwise("Existing cryptic"))
        .when(~wt & var, created)
        .otherwise("Unknown NC cryptic")
    )


def _center(center: Column, offset: Column) -> Column:
    """Genome position ``offset`` bases along the strand from ``center``."""
    return F.when(F.col("strand") == "-", center - offset).otherwise(center + offset)


def _base_at(window: str, center: Column, place: Column, changes: list[tuple[Column, Column]]) -> Column:
    """Base at a genome position within two bases of ``center``, which ``window`` surrounds, on the variant's strand."""
    out = F.substr(F.col(window), (place - center + 3).cast("int"), F.lit(1))
    for p, a in changes:
        out = F.when(place == p, a).otherwise(out)
    return F.when(F.col("strand") == "-", complement(out)).otherwise(out)


def _motif(window: str, center: Column, span: Column, event: Column, motif: str, changes: list[tuple[Column, Column]]) -> Column:
    """Is the motif at the event, counted along the strand from the start of a sequence with ``span`` bases on each side of a change?

    ``center`` is the event's genome position, anywhere in the sequence, and ``window`` has the reference two bases to
    each side of it.  An acceptor motif ends before the event, a donor motif starts after it.
    """
    steps = (-2, -1) if motif == "AG" else (1, 2)
    text = F.concat(*[_base_at(window, center, _center(center, F.lit(s)), changes) for s in steps])
    size = span * 2 + 1
    inside = (event >= 2) & (event < size) if motif == "AG" else (event >= 0) & (event <= size - 3)
    return inside & (text == motif)


def _categories(event: str, place: str, context: Column, pair: bool, distance: int) -> Column:
    kind, off = F.col(event), F.col(place)
    at = F.col("pos") + off
    acc = F.transform("exon_starts", lambda s: (s + 1).cast("long"))
    don = F.transform("exon_ends", lambda e: e.cast("long"))
    at = at.cast("long")
    own, here = (F.col("pos"), F.col("alt")), F.col("_event")
    j = context + off
    if pair:
        other = (F.col("pos2"), F.col("alt2"))
        gap = F.abs(F.col("pos") - F.col("pos2"))
        places = [F.col("pos"), F.col("pos2")]

        def tests(motif: str) -> tuple[Column, Column, list[Column]]:
            wt = _motif("_w", here, context, j, motif, [])
            both = _motif("_w", here, context, j, motif, [own, other])
            first = _motif("_w2", F.col("_event2"), context + gap, j, motif, [other])
            second = _motif("_w", here, context, j, motif, [own])
            return wt, both, [first, second]
    else:
        places = [F.col("pos")]

        def tests(motif: str) -> tuple[Column, Column, list[Column]]:
            return _motif("_w", here, context, j, motif, []), _motif("_w", here, context, j, motif, [own]), []

    def gain(bounds: Column, motif: str) -> Column:
        wt, var, singles = tests(motif)
        return classify_gain(at, bounds, wt, var, places, singles, distance)

    label = F.substr(kind, F.lit(4))

    def named(outcome: Column, *words: str) -> Column:
        return F.concat_ws(" ", outcome, *[F.lit(w) for w in words], label)

    donor = F.when(tests("GT")[1], named(gain(don, "GT"))).when(tests("GC")[1], named(gain(don, "GC"), "GC")).otherwise(named(F.lit("Unknown NC cryptic")))
    return (
        F.when(kind.contains("DS_AL"), named(classify_loss(at, acc, places, distance)))
        .when(kind.contains("DS_DL"), named(classify_loss(at, don, places, distance)))
        .when(kind.contains("DS_AG"), named(gain(acc, "AG")))
        .when(kind.contains("DS_DG"), donor)
    )


def _categorized(tbv: DataFrame, chunks: DataFrame, annot: DataFrame, exon_len: int, event: str, place: str, out: str, distance: int, pair: bool) -> DataFrame:
    """Only the bases next to the event matter, so they are looked up there, however far it is from the change."""
    df = join_gene(tbv, annot).withColumn("_event", _center(F.col("pos"), F.col(place)))
    df = with_window(df, chunks, 2, 2, "_w", pos="_event")
    if pair:
        # the same offset in the sequence around the second change, which is wider by the gap
        gap = F.abs(F.col("pos") - F.col("pos2"))
        df = with_window(df.withColumn("_event2", _center(F.col("pos2"), F.col(place) - gap)), chunks, 2, 2, "_w2", pos="_event2")
    cat = _categories(event, place, F.lit(exon_len + 10), pair, distance)
    return df.withColumns({out: cat, f"{place}_hg19": F.col("pos") + F.col(place)}).select(*tbv.columns, f"{place}_hg19", out)


def categorize_snvs(
    tbv: DataFrame, chunks: DataFrame, annot: DataFrame, exon_len: int, event: str = "DS_maxrw_type", place: str = "POS_maxrw",
    out: str = "splai_cat", distance: int = DISTAL,
) -> DataFrame:
    """Category of the strongest event of each single change."""
    return _categorized(tbv, chunks, annot, exon_len, event, place, out, distance, False)


def categorize_dnvs(
    tbv: DataFrame, chunks: DataFrame, annot: DataFrame, exon_len: int, event: str = "DS_maxrw_type", place: str = "POS_maxrw",
    out: str = "splai_cat", distance: int = DISTAL,
) -> DataFrame:
    """The same for pairs: the change itself (pos, ref, alt) and a second one (pos2, ref2, alt2)."""
    return _categorized(tbv, chunks, annot, exon_len, event, place, out, distance, True)


def _in_exon(pos: Column, rev: bool) -> Column:
    lo, hi = F.col("_s"), F.col("_e")
    return (pos >= lo) & (pos < hi) if rev else (pos > lo) & (pos <= hi)


def _exon_bounds(annot: DataFrame, exon: object) -> DataFrame:
    return annot.filter(F.col("exon") == exon).agg(F.max("start_hg19").alias("_s"), F.max("end_hg19").alias("_e"))


def process_snvs(
    snvs: DataFrame, chunks: DataFrame, annot: DataFrame, bed: DataFrame, exon: object, exon_len: int, freq2: DataFrame, freq3: DataFrame,
    score: str = "DS_maxrw", rev: bool = False, common: float = 0.01, threshold: float = 0.2, distance: int = DISTAL,
) -> tuple[DataFrame, DataFrame]:
    """Categories, second genome build, two frequency joins, common and disrupting flags; all and exonic rows."""
    df = categorize_snvs(snvs, chunks, annot, exon_len, f"{score}_type", "POS" + score[2:], distance=distance)
    df = hg19_to_hg38(df.withColumn("hg19_pos", F.col("pos")), bed, exon)
    df = merge_population(df, freq2, ["hg19_pos", "ref", "alt"], "v2")
    df = merge_population(df, freq3, ["hg38_pos", "ref", "alt"], "v3")
    df = df.withColumns({f"common_{v}": threshold_flag(f"af_{v}", common, "ge") for v in ("v2", "v3")})
    df = df.withColumns({"common": F.col("common_v2") | F.col("common_v3"), "sdv": threshold_flag(score, threshold, "ge")})
    inside = attach(df, _exon_bounds(bed, exon)).filter(_in_exon(F.col("pos"), rev)).drop("_s", "_e")
    return df, inside


def process_dnvs(
    dnvs: DataFrame, chunks: DataFrame, annot: DataFrame, bed: DataFrame, exon: object, exon_len: int,
    score: str = "DS_maxrw", rev: bool = False, threshold: float = 0.2, distance: int = DISTAL,
) -> tuple[DataFrame, DataFrame]:
    """The same for pairs; the further change comes as text ``pos:ref>alt`` in ``other_var``."""
    where, change = F.split("other_var", ":"), F.split(F.split("other_var", ":")[1], ">")
    df = dnvs.withColumns({"pos2": where[0].cast("int"), "ref2": change[0], "alt2": change[1]})
    df = categorize_dnvs(df, chunks, annot, exon_len, f"{score}_type", "POS" + score[2:], distance=distance)
    df = df.withColumnsRenamed(
        {"other_var": "var_snv1", "pos2": "pos_snv1", "ref2": "ref_snv1", "alt2": "alt_snv1", "pos": "pos_snv2", "ref": "ref_snv2", "alt": "alt_snv2"}
    )
    text = F.concat(F.col("pos_snv2").cast("string"), F.lit(":"), F.col("ref_snv2"), F.lit(">"), F.col("alt_snv2"))
    df = df.withColumn("var_snv2", text)
    for n in ("snv1", "snv2"):
        df = hg19_to_hg38(df.withColumn(f"hg19_pos_{n}", F.col(f"pos_{n}")), bed, exon, f"hg19_pos_{n}", f"hg38_pos_{n}")
    df = df.withColumn("sdv", threshold_flag(score, threshold, "ge"))
    inside = attach(df, _exon_bounds(bed, exon)).filter(_in_exon(F.col("pos_snv1"), rev) & _in_exon(F.col("pos_snv2"), rev)).drop("_s", "_e")
    return df, inside


def pairs_long(snvs: DataFrame, dnvs: DataFrame) -> DataFrame:
    """Single and double changes in one table; ``snv`` marks the single ones."""
    one = snvs.withColumnsRenamed({"pos": "pos_snv1", "ref": "ref_snv1", "alt": "alt_snv1"})
    return one.unionByName(dnvs, allowMissingColumns=True).withColumn("snv", F.col("pos_snv2").isNull())


def pairs_wide(snvs: DataFrame, dnvs: DataFrame) -> DataFrame:
    """Each pair with the columns of both its single changes, which are written once."""
    snvs = write_once(snvs, "singles")
    out = dnvs
    for n in ("snv1", "snv2"):
        keys = [f"{c}_{n}" for c in ("pos", "ref", "alt", "hg19_pos", "hg38_pos")]
        # the contig is part of the key, under its own name
        side = snvs.select(*[F.col(c).alias(c if c == "chrom" else f"{c}_{n}") for c in snvs.columns if c != "strand"])
        out = contig_join(out, side, keys)
    return out


def pair_effects(
    exons: DataFrame, base: DataFrame, chunks: DataFrame, annot: DataFrame, bed: DataFrame, exon: object, exon_len: int, half: int,
    predictors, freq2: DataFrame, freq3: DataFrame, rev: bool = False,
) -> dict[str, DataFrame]:
    """Enumerate the single and double changes of exons, score, categorise and combine them.

    ``exons`` carries the strand; ``bed`` and ``exon`` give the range the combined tables keep.
    """
    from juncture.operators.annotation import boundaries_in_window
    from juncture.operators.scoring import context_windows, delta_scores_masked, score_batches

    snvs = all_snvs(exons, base, ("exon", "strand"))
    change = F.array(F.struct(F.col("pos2").cast("int").alias("pos"), F.col("ref2").alias("ref"), F.col("alt2").alias("alt")))
    dnvs = all_dnvs(snvs, ("exon", "chrom", "strand")).withColumn("haplotype", change)

    def scored(rows: DataFrame, keep: list[str]) -> DataFrame:
        ready = boundaries_in_window(rows, annot, half).select(*rows.columns, "acceptors", "donors")
        tracks = score_batches(context_windows(ready, chunks, half), predictors)
        out = delta_scores_masked(tracks)
        return out.select(*keep, "DS_maxm", "DS_maxm_type", "POS_maxm")

    one = scored(snvs, [*KEY, "strand"])
    text = F.concat(F.col("pos2").cast("string"), F.lit(":"), F.col("ref2"), F.lit(">"), F.col("alt2"))
    two = scored(dnvs, [*KEY, "strand", "pos2", "ref2", "alt2"]).withColumn("other_var", text).drop("pos2", "ref2", "alt2")
    # categories read the scores several times, and a predictor should see each change once
    one, two = write_once(one, "singles"), write_once(two, "doubles")
    # the files of the single changes are small beside their rows, which would be broadcast to meet the genes
    one = one.hint("merge")
    all_one, ex_one = process_snvs(one, chunks, annot, bed, exon, exon_len, freq2, freq3, "DS_maxm", rev)
    all_two, ex_two = process_dnvs(two, chunks, annot, bed, exon, exon_len, "DS_maxm", rev)
    return {"snvs": all_one, "dnvs": all_two, "long": pairs_long(ex_one, ex_two), "wide": pairs_wide(ex_one, ex_two)}
