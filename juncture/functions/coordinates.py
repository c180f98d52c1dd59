"""Position arithmetic and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import as_col, attach, is_true


def pos_to_hgvs(pos: Column | str, cloned: tuple[int, int], exon: tuple[int, int], cdna: tuple[int, int]) -> Column:
    """Vector position to coding position around one exon; null outside the cloned range."""
    if exon[1] - exon[0] != cdna[1] - cdna[0]:
        raise ValueError("exon and coding range differ in length")
    if exon[0] < cloned[0] or exon[1] > cloned[1]:
        raise ValueError("exon reaches outside the cloned range")
    p = as_col(pos)

    def text(base: Column, sign: str, far: Column | None) -> Column:
        parts = [F.lit("c."), base.cast("string")]
        return F.concat(*parts, *([] if far is None else [F.lit(sign), far.cast("string")]))

    inside = text(p - exon[0] + cdna[0], "", None)
    before = text(F.lit(cdna[0]), "-", F.lit(exon[0]) - p)
    after = text(F.lit(cdna[1]), "+", p - exon[1])
    return F.when(p.between(*cloned), F.when(p < exon[0], before).when(p > exon[1], after).otherwise(inside))


def pos_to_gdna(pos: Column | str, genome_end: int, vector_end: int, rev: bool = False) -> Column:
    """Affine map through one pair of matched exon ends."""
    shift = F.lit(vector_end) - as_col(pos)
    return F.lit(genome_end) + shift if rev else F.lit(genome_end) - shift


def vpos_to_gpos(pos: Column | str, vector: tuple[int, int], genome: tuple[int, int], rev: bool = False) -> Column:
    """Affine map between two ranges of equal length, mirrored on the minus strand."""
    low, high = min(genome), max(genome)
    if vector[1] - vector[0] != high - low:
        raise ValueError("ranges differ in length")
    p = as_col(pos)
    return F.lit(low) + (F.lit(vector[1]) - p if rev else p - F.lit(vector[0]))


def hg19_to_hg38(tbv: DataFrame, annot: DataFrame, exon: object, src: str = "hg19_pos", dst: str = "hg38_pos") -> DataFrame:
    """Shift positions by the distance between the two starts of an exon."""
    same = F.max(F.col("exon_len_hg19") == F.col("exon_len_hg38"))
    one = annot.filter(F.col("exon") == exon).agg(
        F.when(same, F.max(F.col("start_hg38") - F.col("start_hg19"))).otherwise(F.raise_error(F.lit("exon lengths differ"))).alias("_shift")
    )
    return attach(tbv, one).withColumn(dst, F.col(src) + F.col("_shift")).drop("_shift")


def threshold_flag(col: Column | str, threshold: float, op: str) -> Column:
    c = as_col(col)
    test = {"gt": c > threshold, "ge": c >= threshold, "lt": c < threshold, "le": c <= threshold}[op.lower()]
    return is_true(test)


def sdv_flag(col: Column | str, threshold: float, absolute: bool = True) -> Column:
    c = as_col(col)
    return is_true((F.abs(c) if absolute else c) >= threshold)


def log2_ratio(a: Column | str, b: Column | str, pseudo: float = 0.001) -> Column:
    return F.log2((as_col(a) + pseudo) / (as_col(b) + pseudo))


def splice_site_distance(pos: Column | str, sites: list[int]) -> Column:
    p = as_col(pos)
    return F.array_min(F.transform(F.array(*[F.lit(s) for s in sites]), lambda s: F.abs(p - s)))


def nullsafe_row_sum(cols: list[Column | str]) -> Column:
    """Sum over columns that skips nulls; null only when all are null."""
    cs = [as_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs])
    return F.when(F.coalesce(*cs).isNotNull(), total)


def interpretation_label(clinical: Column | str, lab: Column | str) -> Column:
    """One label from two free-text interpretations; the first matching rule decides."""
    c, a = F.coalesce(as_col(clinical), F.lit("")), F.coalesce(as_col(lab), F.lit(""))
    # fixed values: the labels and the text they are recognised by
    return (
        F.when(c.isin("Uncertain_significance", "Conflicting_interpretations_of_pathogenicity"), "VUS/Conflicting (CV)")
        .when(c.contains("nign") | a.contains("nign"), "Benign/Likely_benign (CV/ACMG)")
        .when(c.contains("ogenic"), "Pathogenic/Likely_pathogenic (CV)")
        .when(a.contains("ogenic"), "Pathogenic/Likely_pathogenic (ACMG)")
        .otherwise("")
    )


def parse_isoform_text(text: Column | str) -> Column:
    """Text such as ``((10, 20), (30, 40))`` or ``()`` as an array of blocks."""
    square = F.regexp_replace(F.translate(as_col(text), "()", "[]"), r",\s*\]", "]")
    pairs = F.from_json(square, "array<array<int>>")
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end")))


def isoform_text(blocks: Column | str) -> Column:
    """Canonical text of an array of blocks: ``[[10,20],[30,40]]``."""
    one = F.transform(as_col(blocks), lambda b: F.concat(F.lit("["), b["start"].cast("string"), F.lit(","), b["end"].cast("string"), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(one, ","), F.lit("]"))
