"""Joins to genes, intervals, frequencies, clinical tables and predictor scores.

Interval and nearest joins are equi-joins on position bins with the exact test on top; plain
range predicates would become nested loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juncture.functions.columns import KEY, attach, position_bin, ratio
from juncture.functions.sequence import CODE_BASES, amino_acid, complement, codon_table, reverse_complement, with_chars
from juncture.sources.sinks import explode_range

BIN = 16384


def bins_of(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(position_bin(lo, width), position_bin(hi, width)))


# ---- variant enumeration ----------------------------------------------------------------------


def all_snvs(exons: DataFrame, base: DataFrame, keys: tuple[str, ...] = ("exon",)) -> DataFrame:
    """Every single-base change of each exon; ``exons`` has half-open ``start_pos`` and ``end_pos``."""
    ranges = exons.select(*keys, "chrom", (F.col("start_pos") + 1).alias("_lo"), F.col("end_pos").alias("_hi"))
    rows = explode_range(ranges, "_lo", "_hi", "pos").drop("_lo", "_hi")
    # Catalyst sees the size of the exons, not of their positions: left to it, these are broadcast
    return _changes(rows.hint("merge").join(base.select("chrom", "pos", F.upper("base").alias("ref")), ["chrom", "pos"]))


def _changes(rows: DataFrame) -> DataFrame:
    others = F.array_except(F.array(*[F.lit(b) for b in "ACGT"]), F.array("ref"))
    return rows.withColumn("alt", F.explode(others))


def saturate_variants(tbv: DataFrame, base: DataFrame, exon: str = "exon", distance: int = 100, fill_introns: bool = False, width: int = BIN) -> DataFrame:
    """Measured rows of each exon and its surroundings beside every possible single-base change.

    The range of an exon is that of its labelled rows plus ``distance``; without ``fill_introns`` it
    shrinks to the measured rows inside.
    """
    p = F.col("pos")
    bounds = tbv.filter(F.col(exon).isNotNull()).groupBy(exon, "chrom").agg((F.min(p) - distance).alias("_lo"), (F.max(p) + distance).alias("_hi"))
    bounds = bounds.withColumnRenamed(exon, "_exon")
    binned = bounds.withColumn("_bin", bins_of(F.col("_lo"), F.col("_hi"), width))
    inside = tbv.withColumn("_bin", position_bin(p, width)).join(binned, ["chrom", "_bin"]).filter(p.between(F.col("_lo"), F.col("_hi")))
    inside = inside.drop("_bin")
    if not fill_introns:
        span = inside.groupBy("_exon", "chrom").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    else:
        span = bounds
    every = explode_range(span, "_lo", "_hi", "pos").select(F.col("_exon"), "chrom", "pos")
    every = _changes(every.join(base.select("chrom", "pos", F.upper("base").alias("ref")), ["chrom", "pos"]))
    rest = [c for c in tbv.columns if c not in (*KEY, exon)]
    out = every.join(inside.select("_exon", *KEY, *rest), ["_exon", *KEY], "full_outer").withColumnRenamed("_exon", exon)
    return out.withColumns({"ref_c": complement("ref"), "alt_c": complement("alt")})


def all_dnvs(snvs: DataFrame, keys: tuple[str, ...] = ("exon", "chrom"), block: int = 256) -> DataFrame:
    """Pairs of changes of one exon, the first one at the smaller position.

    Positions are cut into blocks, and each two blocks of an exon, or one with itself, are a tile; rows meet by tile, so the
    pairs of a long exon are made by many tasks.
    """
    cols = ["pos", "ref", "alt"]
    rows = snvs.select(*keys, *cols, position_bin(F.col("pos"), block).alias("_b"))
    span = rows.groupBy(*keys).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    rows = rows.join(span, list(keys))
    first = rows.select(*keys, *cols, F.col("_b").alias("_i"), F.explode(F.sequence("_b", "_hi")).alias("_j"))
    second = rows.select(*keys, *[F.col(c).alias(f"{c}2") for c in cols], F.col("_b").alias("_j"), F.explode(F.sequence("_lo", "_b")).alias("_i"))
    # a row of a long exon lies in many tiles: rows that Catalyst takes for few are not broadcast
    return first.hint("merge").join(second, [*keys, "_i", "_j"]).filter(F.col("pos") < F.col("pos2")).drop("_i", "_j")


# ---- gene models ------------------------------------------------------------------------------


def transcript_annotation(gtf: DataFrame) -> DataFrame:
    """One row per transcript: bounds and exon lists, starts 0-based, chromosome without ``chr``."""
    rows = gtf.filter(F.col("transcript_id").isNotNull())
    exon = F.when(F.col("feature") == "exon", F.struct((F.col("start_pos") - 1).alias("s"), F.col("end_pos").alias("e")))
    tx = F.col("feature") == "transcript"
    out = rows.groupBy("transcript_id").agg(
        F.min("gene_id").alias("name"),
        F.regexp_replace(F.min("chrom"), "^chr", "").alias("chrom"),
        F.min("strand").alias("strand"),
        F.min(F.when(tx, F.col("start_pos") - 1)).alias("tx_start"),
        F.max(F.when(tx, F.col("end_pos"))).alias("tx_end"),
        F.array_sort(F.collect_list(exon)).alias("_e"),
        F.count_distinct("gene_id").alias("_genes"),
    )
    one = F.when(F.col("_genes") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("several genes for "), F.col("transcript_id"))))
    return out.withColumns({"name": one, "exon_starts": F.col("_e.s"), "exon_ends": F.col("_e.e")}).drop("_e", "_genes")


def gene_gtf(gtf: DataFrame, gene: str, transcript: str) -> DataFrame:
    """Rows of a gene; limited to one transcript when it has several."""
    rows = gtf.filter(F.col("gene_id").startswith(gene))
    check = rows.agg(
        F.count_distinct("transcript_id").alias("_n"), F.max(F.split("transcript_id", r"\.")[0] == transcript).alias("_has")
    )
    known = F.when(F.col("_has"), F.col("_n")).otherwise(F.raise_error(F.lit(f"transcript {transcript} not in table")).cast("long"))
    rows = attach(rows, check.select(known.alias("_n")))
    keep = (F.col("_n") <= 1) | F.col("transcript_id").isNull() | F.col("transcript_id").startswith(transcript)
    return rows.filter(keep).drop("_n")


def compare_annotations(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """Do the bounds of two annotations of each transcript (or of each gene, by its name) agree, and which exon ends are in one only?"""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in ("tx_start", "tx_end", "exon_starts", "exon_ends")])

    both = side(a, "a").join(side(b, "b"), key)
    out = both.withColumn("same_bounds", (F.col("tx_start_a") == F.col("tx_start_b")) & (F.col("tx_end_a") == F.col("tx_end_b")))
    for c in ("exon_starts", "exon_ends"):
        out = out.withColumns(
            {f"{c}_only_a": F.array_sort(F.array_except(f"{c}_a", f"{c}_b")), f"{c}_only_b": F.array_sort(F.array_except(f"{c}_b", f"{c}_a"))}
        )
    return out.select(key, "same_bounds", *[f"{c}_only_{s}" for c in ("exon_starts", "exon_ends") for s in "ab"])


def join_gene(tbv: DataFrame, annot: DataFrame, strand: bool = True, width: int = BIN) -> DataFrame:
    """Attach the transcript that contains each position (and, by default, lies on its strand)."""
    genes = annot.withColumn("_bin", bins_of(F.col("tx_start"), F.col("tx_end"), width))
    keys = ["chrom", "_bin"] + (["strand"] if strand else [])
    if not strand:
        genes = genes.drop("strand")
    hit = tbv.withColumn("_bin", position_bin(F.col("pos"), width)).join(genes, keys)
    return hit.filter(F.col("pos").between(F.col("tx_start"), F.col("tx_end"))).drop("_bin")


def gene_flank_overhang(tbv: DataFrame, annot: DataFrame, context: int) -> DataFrame:
    """Bases of the context that lie outside the transcript on either side."""
    df = join_gene(tbv, annot)
    left = F.greatest(F.lit(context) - (F.col("pos") - (F.col("tx_start") + 1)), F.lit(0))
    right = F.greatest(F.lit(context) - (F.col("tx_end") - F.col("pos")), F.lit(0))
    return df.withColumns({"left_out": left, "right_out": right})


def _nearest(distances: Column) -> Column:
    return F.array_min(F.transform(distances, lambda d: F.struct(F.abs(d).alias("a"), d.alias("d"))))["d"]


def nearest_exon_boundaries(tbv: DataFrame, annot: DataFrame) -> DataFrame:
    """Signed distance to the nearest acceptor and donor; starts are donors on the minus strand."""
    df = join_gene(tbv, annot)
    start = _nearest(F.transform("exon_starts", lambda s: s + 1 - F.col("pos")))
    end = _nearest(F.transform("exon_ends", lambda e: e - F.col("pos")))
    rev = F.col("strand") == "-"
    return df.withColumns({"acceptor": F.when(rev, end).otherwise(start), "donor": F.when(rev, start).otherwise(end)})


def boundaries_in_window(tbv: DataFrame, annot: DataFrame, context: int, positions: bool = False) -> DataFrame:
    """All annotated acceptors and donors within the context, as distances or as positions."""
    df = join_gene(tbv, annot)
    pos = F.col("pos")

    def near(sites: Column) -> Column:
        kept = F.filter(sites, lambda s: F.abs(s - pos) <= context)
        return kept if positions else F.transform(kept, lambda s: s - pos)

    starts, ends = near(F.transform("exon_starts", lambda s: s + 1)), near(F.col("exon_ends"))
    rev = F.col("strand") == "-"
    return df.withColumns({"acceptors": F.when(rev, ends).otherwise(starts), "donors": F.when(rev, starts).otherwise(ends)})


#: Bins whose running bests one task works out.
BIN_BLOCK = 4096


def exon_bins(exons: DataFrame, tbv: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per bin, the exons that overlap it and the closest one on either side.

    The list is as long as the annotation is dense in one bin, whatever the number of variants; a
    variant then needs one lookup and no row multiplies.  The closest exons further away come from
    a running maximum over bins, which are few.
    """
    item = F.struct("start_pos", "end_pos", *[c for c in exons.columns if c not in (*keys, "start_pos", "end_pos")])
    ex = exons.select(*keys, item.alias("x"))
    inside = ex.withColumn("_bin", bins_of(F.col("x.start_pos"), F.col("x.end_pos"), width)).groupBy(*keys, "_bin").agg(F.collect_list("x").alias("_in"))
    ends = ex.withColumn("_bin", position_bin(F.col("x.end_pos"), width)).groupBy(*keys, "_bin").agg(F.max(F.struct(F.col("x.end_pos").alias("k"), "x")).alias("_l"))
    starts = ex.withColumn("_bin", position_bin(F.col("x.start_pos"), width)).groupBy(*keys, "_bin").agg(F.min(F.struct(F.col("x.start_pos").alias("k"), "x")).alias("_r"))
    wanted = tbv.select(*keys, position_bin(F.col("pos"), width).alias("_bin")).distinct()
    on = [*keys, "_bin"]
    every = wanted.join(inside, on, "full_outer").join(ends, on, "full_outer").join(starts, on, "full_outer")
    # running bests in two levels: over blocks of bins, which are few, and over the bins of a block.  Both frames lie
    # before the row, so no bin is read twice, and a chromosome spreads over its blocks.
    every = every.withColumn("_block", F.floor(F.col("_bin") / BIN_BLOCK))
    blocks = every.groupBy(*keys, "_block").agg(F.max("_l").alias("_bl"), F.min("_r").alias("_br"))
    up, down = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(F.desc("_block"))
    before = (Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.max("_bl").over(up.rowsBetween(*before)).alias("_ol"), F.min("_br").over(down.rowsBetween(*before)).alias("_or"))
    every = every.join(blocks, [*keys, "_block"])
    rise, fall = Window.partitionBy(*keys, "_block").orderBy("_bin"), Window.partitionBy(*keys, "_block").orderBy(F.desc("_bin"))
    left = F.greatest(F.max("_l").over(rise.rowsBetween(*before)), F.col("_ol"))["x"]
    right = F.least(F.min("_r").over(fall.rowsBetween(*before)), F.col("_or"))["x"]
    found = F.concat(F.coalesce("_in", F.array().cast(inside.schema["_in"].dataType)), F.array(left, right))
    return every.select(*on, F.filter(found, lambda x: x.isNotNull()).alias("_exons"))


def nearest_exon(tbv: DataFrame, exons: DataFrame, width: int = BIN) -> DataFrame:
    """Closest exon on the variant's strand with its distance, 0 inside; the first one on a tie."""
    keys = ["chrom", "strand"]
    table = exon_bins(exons, tbv, keys, width)
    df = tbv.withColumn("_bin", position_bin(F.col("pos"), width)).join(table, [*keys, "_bin"])
    pos = F.col("pos")
    ranked = F.transform(
        "_exons", lambda x: F.struct(F.greatest(x["start_pos"] - pos, pos - x["end_pos"], F.lit(0)).alias("dist"), x.alias("x"))
    )
    best = F.array_min(ranked)
    out = df.withColumn("_m", best).filter(F.col("_m").isNotNull())
    fields = table.schema["_exons"].dataType.elementType.names
    return out.select(*tbv.columns, F.col("_m.dist").alias("dist"), *[F.col(f"_m.x.{f}").alias(f"exon_{f}") for f in fields])


def annotate_exon(vcf: DataFrame, exons: DataFrame, width: int = BIN) -> DataFrame:
    """Distance to the nearest exon end on either strand, its strand, and the exon around the variant.

    Two exons around one position are an error.
    """
    table = exon_bins(exons.select("chrom", "start_pos", "end_pos", "strand"), vcf, ["chrom"], width)
    df = vcf.withColumn("_bin", position_bin(F.col("pos"), width)).join(table, ["chrom", "_bin"])
    pos = F.col("pos")
    near = F.array_min(
        F.transform("_exons", lambda x: F.struct(F.least(F.abs(x["start_pos"] - pos), F.abs(x["end_pos"] - pos)).alias("d"), x["start_pos"].alias("s"), x["strand"].alias("strand")))
    )
    around = F.filter("_exons", lambda x: (x["start_pos"] <= pos) & (x["end_pos"] >= pos))
    df = df.withColumns({"_n": near, "_a": around})
    one = F.when(F.size("_a") <= 1, F.get("_a", F.lit(0))).otherwise(
        F.raise_error(F.concat(F.lit("several exons at "), pos.cast("string"))).cast(table.schema["_exons"].dataType.elementType)
    )
    df = df.withColumn("_x", one)
    return df.select(
        *vcf.columns,
        F.col("_n.strand").alias("strand"),
        F.col("_n.d").alias("nearest_bd"),
        F.col("_x").isNotNull().alias("exon"),
        (F.col("_x.start_pos") - 1).alias("exon_start"),
        F.col("_x.end_pos").alias("exon_end"),
    )


def exon_table(seqs: DataFrame, annot: DataFrame, utr5: int = 0) -> DataFrame:
    """Exon number, length, genome range, sequence and coding start per gene.

    ``seqs`` (name, num, seq) in transcript order; on the minus strand the exon lists run backwards
    and the sequence is reverse complemented.
    """
    rev = F.col("strand") == "-"
    df = seqs.join(annot.select("name", "strand", "exon_starts", "exon_ends"), "name")
    place = F.when(rev, -F.col("num")).otherwise(F.col("num"))
    first = F.col("num") == F.min("num").over(Window.partitionBy("name"))
    start = F.try_element_at("exon_starts", place) + F.when(first & ~rev, utr5).otherwise(0)
    end = F.try_element_at("exon_ends", place) - F.when(first & rev, utr5).otherwise(0)
    size = F.length("seq")
    # exons of one gene: a narrow window
    before = Window.partitionBy("name").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "name",
        "strand",
        "num",
        size.alias("len"),
        start.alias("gdna_start"),
        end.alias("gdna_end"),
        F.when(rev, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("ccds_start"),
    )


def exon_region(exons: DataFrame, numbers: tuple[int, int] | None = None, flank: int = 200, rev: bool = False) -> DataFrame:
    """Range of the chosen exons of each gene plus a flank, kept inside the chromosome."""
    order = Window.partitionBy("gene").orderBy(F.desc("start_pos") if rev else F.asc("start_pos"))
    rows = exons.withColumn("_n", F.row_number().over(order))
    if numbers:
        rows = rows.filter(F.col("_n").between(*numbers))
    # one entry per chromosome, looked up as a scalar
    longest = exons.groupBy("chrom").agg(F.max("end_pos").alias("_max")).agg(F.map_from_entries(F.collect_list(F.struct("chrom", "_max"))).alias("m"))
    out = rows.groupBy("gene", "chrom").agg(F.min("start_pos").alias("_s"), F.max("end_pos").alias("_e"))
    limit = F.try_element_at(longest.scalar(), F.col("chrom"))
    return out.select(
        "gene", "chrom", F.greatest(F.col("_s") - flank, F.lit(0)).alias("start_pos"), F.least(F.col("_e") + flank, limit).alias("end_pos")
    )


def codon_substitutions(exon_tbl: DataFrame, flanks: int) -> DataFrame:
    """Every other codon for each codon of a gene, as a centre change and the changes after it.

    The first mismatch is the centre; later ones form the haplotype, with ``skip`` for a base too far
    from the centre.  Genome positions go through the exon table, on both strands.
    """
    item = F.struct("num", "ccds_start", "gdna_start", "gdna_end", "seq")
    genes = exon_tbl.groupBy("name", "strand").agg(F.array_sort(F.collect_list(item)).alias("_ex"))
    coding = F.array_join(F.col("_ex.seq"), "")
    codons = with_chars(
        F.upper(coding),
        lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 3).cast("int") - 1), lambda i: F.array_join(F.slice(c, i * 3 + 1, F.lit(3)), "")),
    )
    df = genes.select("name", "strand", "_ex", F.posexplode(codons).alias("i", "codon"))
    table = [c for c in codon_table()]
    df = df.withColumn("sub", F.explode(F.array(*[F.lit(c) for c in table]))).filter(F.col("sub") != F.col("codon"))
    rev = F.col("strand") == "-"

    def genome(offset: Column) -> Column:
        cur = F.col("i") * 3 + offset
        home = F.try_element_at(F.filter("_ex", lambda x: x["ccds_start"] <= cur), F.lit(-1))
        ahead = cur - home["ccds_start"]
        return F.when(rev, home["gdna_end"] - ahead).otherwise(home["gdna_start"] + 1 + ahead)

    def strand_base(b: Column) -> Column:
        return F.when(rev, reverse_complement(b)).otherwise(b)

    changed = F.filter(
        F.array(*[F.lit(j) for j in range(3)]), lambda j: F.substr("codon", j + 1, F.lit(1)) != F.substr("sub", j + 1, F.lit(1))
    )
    steps = F.transform(
        changed,
        lambda j: F.struct(
            genome(j).alias("pos"), strand_base(F.substr("codon", j + 1, F.lit(1))).alias("ref"), strand_base(F.substr("sub", j + 1, F.lit(1))).alias("alt")
        ),
    )
    df = df.withColumn("_s", steps).withColumn("_c", F.get("_s", F.lit(0)))
    later = F.slice("_s", F.lit(2), F.lit(2))
    text = F.transform(
        later,
        lambda s: F.when(s["pos"] < F.col("_c.pos") + flanks, F.concat_ws(":", s["pos"].cast("string"), s["ref"], s["alt"])).otherwise("skip"),
    )
    return df.select(
        "name",
        (F.col("i") + 1).alias("aa_num"),
        amino_acid("codon").alias("ref_aa"),
        amino_acid("sub").alias("alt_aa"),
        "codon",
        "sub",
        F.col("_c.pos").alias("pos"),
        F.col("_c.ref").alias("ref"),
        F.col("_c.alt").alias("alt"),
        F.array_join(text, ",").alias("haplotype"),
    )


# ---- interval tables --------------------------------------------------------------------------


def interval_filter(vcf: DataFrame, bed: DataFrame, width: int = BIN) -> DataFrame:
    """Records that overlap any interval (0-based, half-open), once each."""
    b = bed.select("chrom", F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"))
    b = b.withColumn("_bin", bins_of(F.col("_s"), F.col("_e") - 1, width))
    lo, hi = F.col("pos") - 1, F.col("pos") - 1 + F.length("ref")
    first, last = position_bin(lo, width), position_bin(hi - 1, width)

    def hits(df: DataFrame) -> DataFrame:
        same = (df["chrom"] == b["chrom"]) & (df["_bin"] == b["_bin"])
        return df.join(b, same & (df["_lo"] < b["_e"]) & (df["_hi"] > b["_s"]), "left_semi")

    rows = vcf.withColumns({"_lo": lo, "_hi": hi})
    short = hits(rows.filter(first == last).withColumn("_bin", first))
    # a record across a bin edge is looked up in each of its bins
    long = rows.filter(first != last).withColumn("_id", F.monotonically_increasing_id())
    long = hits(long.withColumn("_bin", F.explode(F.sequence(first, last)))).dropDuplicates(["_id"])
    return short.select(*vcf.columns).union(long.select(*vcf.columns))


def position_intersect_merge(a: DataFrame, b: DataFrame, scores: str = "scores", low: float = 0.1) -> DataFrame:
    """Rows of two call sets at positions both have, whatever the allele, merged on the key.

    Records of the second set whose scores are all below the limit are dropped first.
    """
    kept = b.filter(F.exists(scores, lambda s: s >= low))
    at = ["chrom", "pos"]
    left = a.join(kept.select(*at).distinct(), at, "left_semi")
    right = kept.join(a.select(*at).distinct(), at, "left_semi")
    return left.join(right, KEY, "full_outer").orderBy(*KEY)


def expand_bedgraph(bg: DataFrame, value: str = "value") -> DataFrame:
    """Interval values to one row per 1-based position; a gap inside a chromosome is an error.

    An interval whose end is no start and not the last end of its chromosome leaves a gap: two
    equi-joins find them, without sorting a chromosome.
    """
    ends = bg.select("chrom", F.col("end_pos").alias("_p"))
    final = bg.groupBy("chrom").agg(F.max("end_pos").alias("_p"))
    starts = bg.select("chrom", F.col("start_pos").alias("_p")).union(final)
    gaps = ends.join(starts, ["chrom", "_p"], "left_anti").agg(F.count(F.lit(1)).alias("_gaps"))
    rows = explode_range(bg.withColumns({"_lo": F.col("start_pos") + 1, "_hi": F.col("end_pos")}), "_lo", "_hi", "pos")
    checked = attach(rows.select("chrom", "pos", value), gaps)
    ok = F.when(F.col("_gaps") == 0, F.col(value)).otherwise(F.raise_error(F.lit("bedGraph has gaps")).cast("double"))
    return checked.select("chrom", "pos", ok.alias(value))


def relative_junction_use(bounds: DataFrame, expression: DataFrame, col: str = "mean_proportion", extend: int = 100, width: int = BIN) -> DataFrame:
    """Expression share at each exon boundary (chrom, jn).

    The mean at the position itself, else the mean within ``extend`` bases, else 1.
    """
    sites = bounds.select("chrom", "jn").distinct()
    wide = sites.withColumn("_bin", bins_of(F.col("jn") - extend, F.col("jn") + extend, width))
    near = expression.select("chrom", "pos", F.col(col).alias("_v"), position_bin(F.col("pos"), width).alias("_bin")).join(wide, ["chrom", "_bin"])
    near = near.filter(F.abs(F.col("pos") - F.col("jn")) <= extend)
    use = near.groupBy("chrom", "jn").agg(F.avg(F.when(F.col("pos") == F.col("jn"), F.col("_v"))).alias("_at"), F.avg("_v").alias("_near"))
    return sites.join(use, ["chrom", "jn"], "left").select("chrom", "jn", F.coalesce("_at", "_near", F.lit(1.0)).alias("pext"))


# ---- key joins --------------------------------------------------------------------------------


def with_chrom(keys: list[str] | tuple[str, ...], *tables: DataFrame) -> list[str]:
    """The keys, and the chromosome too if all tables have it."""
    return [*keys, *(["chrom"] if "chrom" not in keys and all("chrom" in t.columns for t in tables) else [])]


def contig_join(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...], how: str = "left") -> DataFrame:
    """Join by key and, where both sides have it, by chromosome, spelled with or without ``chr``; the left spelling stays."""
    on = [k for k in with_chrom(keys, left, right) if k != "chrom"]
    if len(on) == len(with_chrom(keys, left, right)):
        return left.join(right, on, how)
    bare = lambda df: df.withColumn("_contig", F.regexp_replace("chrom", "^chr", ""))
    out = bare(left).join(bare(right).withColumnRenamed("chrom", "_right"), [*on, "_contig"], how)
    return out.withColumn("chrom", F.coalesce("chrom", "_right")).drop("_contig", "_right")


def merge_scores(tbv: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """All measured rows with the scores of their key, where there are any."""
    return contig_join(tbv, scores, keys)


def merge_conservation(tbv: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ("pos",)) -> DataFrame:
    return merge_scores(tbv, scores, list(keys))


def merge_population(tbv: DataFrame, freq: DataFrame, keys: list[str], suffix: str | None = None) -> DataFrame:
    """Frequency columns by key, with a suffix."""
    if suffix:
        freq = freq.withColumnsRenamed({c: f"{c}_{suffix}" for c in freq.columns if c not in (*keys, "chrom")})
    return merge_scores(tbv, freq, keys)


def merge_versions(v2: DataFrame, v3: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of two releases added up, a missing one as zero, and the frequency of the sum."""
    keys = with_chrom(keys, v2, v3)
    shared = [c for c in v2.columns if c in v3.columns and c not in keys and c != "af"]
    left = v2.select(*keys, *[F.col(c).alias(f"{c}_2") for c in shared])
    right = v3.select(*keys, *[F.col(c).alias(f"{c}_3") for c in shared])
    out = left.join(right, keys, "full_outer")
    sums = [(F.coalesce(f"{c}_2", F.lit(0)) + F.coalesce(f"{c}_3", F.lit(0))).alias(c) for c in shared]
    return out.select(*keys, *sums).withColumn("alt_AF", ratio("n_alt", "n_allele"))


def population_flag(tbv: DataFrame, suffixes: tuple[str, ...] = ("v2", "v3")) -> DataFrame:
    """Is the variant listed in a release (``listed``), and was it seen at all (``seen``)?"""
    listed = reduce(lambda a, b: a | b, [F.col(f"n_allele_{s}").isNotNull() for s in suffixes])
    seen = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"n_alt_{s}") > 0, F.lit(False)) for s in suffixes])
    top = F.greatest(*[ratio(f"n_alt_{s}", f"n_allele_{s}") for s in suffixes])
    return tbv.withColumns({"listed": listed, "seen": seen, "max_af": top})


def merge_clinical(tbv: DataFrame, clinical: DataFrame, keys: list[str], interp: str = "clinvar_interp", flag: str = "clinvar") -> DataFrame:
    return merge_scores(tbv, clinical, keys).withColumn(flag, F.col(interp).isNotNull())


def merge_splice_scores_full(measured: DataFrame, scores: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Scores of measured variants beside all measured rows."""
    return merge_scores(measured, scores, keys)


def merge_hal(tbv: DataFrame, hal: DataFrame, raw: str = "hal_PSI", change: str = "hal_chgPER") -> DataFrame:
    h = hal.select(F.col("VARIANT_NAME").alias("varlist"), F.col("MUT_PSI").alias(raw), F.col("DELTA_PSI").alias(change))
    return merge_scores(tbv, h, ["varlist"])


def merge_squirls(tbv: DataFrame, sq: DataFrame, keys: list[str], transcript: str | None = None) -> DataFrame:
    rows = sq if transcript is None else sq.filter(F.col("tx_accession").startswith(transcript))
    rows = rows.select(*with_chrom(keys, rows), "squirls_score", (F.col("interpretation") == "pathogenic").alias("squirls_sdv"))
    return merge_scores(tbv, rows, keys)


SPIDEX_NAMES = {
    "#Chr": "chrom",
    "Start": "hg19_pos",
    "Ref": "ref",
    "Alt": "alt",
    "dpsi_max_tissue": "spanr_chgPER_tissue",
    "dpsi_zscore": "spanr_chgZPER",
}


def spidex_scores(
    sp: DataFrame, chrom: str | None = None, region: tuple[int, int] | None = None, variants: DataFrame | None = None, rev: bool = False
) -> DataFrame:
    """Scores of a region (start beyond, end within) or of listed variants, under the common names.

    Alleles are complemented, not reversed, on the minus strand: before a lookup by variant, after
    one by region.
    """
    out = sp
    if region:
        out = out.filter((F.col("#Chr") == chrom.removeprefix("chr")) & (F.col("Start") > region[0]) & (F.col("End") <= region[1]))
    if rev:
        out = out.withColumns({"Ref": complement("Ref"), "Alt": complement("Alt")})
    out = out.drop("End").withColumnsRenamed(SPIDEX_NAMES)
    return out if variants is None else out.join(variants, ["chrom", "hg19_pos", "ref", "alt"], "left_semi")


def merge_spidex(tbv: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ("hg19_pos", "ref", "alt")) -> DataFrame:
    return merge_scores(tbv, scores, list(keys))


MMSPLICE_NAMES = {
    "delta_logit_psi": "mmsplice_chgPERlogit",
    "pathogenicity": "mmsplice_pathogen",
    "efficiency": "mmsplice_eff",
    "transcript_id": "mmsplice_trans",
}


def merge_mmsplice(tbv: DataFrame, mm: DataFrame, keys: list[str], transcript: str | None = None) -> DataFrame:
    """Largest scores per key and transcript, joined by key."""
    rows = mm if transcript is None else mm.filter(F.col("transcript_id").startswith(transcript))
    rows = rows.withColumnsRenamed(MMSPLICE_NAMES)
    values = [n for n in MMSPLICE_NAMES.values() if n != "mmsplice_trans"]
    return merge_scores(tbv, rows.groupBy(*with_chrom(keys, rows), "mmsplice_trans").agg(*[F.max(v).alias(v) for v in values]), keys)


def merge_cadd(tbv: DataFrame, cadd: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over repeated rows, joined by key."""
    rows = cadd.withColumnsRenamed({"Chrom": "chrom", "#Chrom": "chrom", "Pos": "pos", "Ref": "ref", "Alt": "alt"})
    means = rows.groupBy(*with_chrom(keys, rows)).agg(F.avg("RawScore").alias("cadd_raw"), F.avg("PHRED").alias("cadd_scaled"))
    return merge_scores(tbv, means, keys)


def mask_training(tbv: DataFrame, train: DataFrame, cols: list[str], flag: str, keys: list[str], suffix: str = "_not") -> DataFrame:
    """Flag variants of a training set and blank their scores in a copy of each column."""
    listed = train.select(*keys).distinct().withColumn("_t", F.lit(True))
    df = tbv.join(listed, keys, "left").withColumn(flag, F.coalesce("_t", F.lit(False))).drop("_t")
    return df.withColumns({f"{c}{suffix}": F.when(~F.col(flag), F.col(c)) for c in cols})


# ---- branch points ----------------------------------------------------------------------------

BP_KEYS = ["id", "start", "ref_allele", "alt_allele", "test_site"]


def branchpoint_delta(bp: DataFrame) -> DataFrame:
    """Reference and alternate probability of each site side by side; one aggregation, no self-join."""
    def prob(s: str) -> Column:
        return F.max(F.when(F.col("status") == s, F.col("branchpoint_prob")))

    out = bp.groupBy(*BP_KEYS).agg(prob("REF").alias("branchpoint_prob_ref"), prob("ALT").alias("branchpoint_prob_alt"))
    return out.withColumn("DBP", F.col("branchpoint_prob_alt") - F.col("branchpoint_prob_ref"))


def branchpoint_max(delta: DataFrame) -> DataFrame:
    """Largest change per variant by size, whether gain or loss, and how far away; first site on a tie."""
    size = F.abs("DBP")
    top = F.max(F.when(size.isNotNull(), F.struct(size.alias("a"), (-F.col("test_site")).alias("s"), "DBP"))).alias("_m")
    out = delta.groupBy("id", F.col("start").alias("hg19_pos"), F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt")).agg(top)
    return out.select(
        "id", "hg19_pos", "ref", "alt",
        F.col("_m.a").alias("DBP_max"),
        F.when(F.col("_m.DBP") > 0, "GAIN").otherwise("LOSS").alias("DBP_event"),
        (-F.col("_m.s") - F.col("hg19_pos")).alias("DBP_POS_max"),
    )


def merge_branchpoint(tbv: DataFrame, top: DataFrame, keys: tuple[str, ...] = ("hg19_pos", "ref", "alt")) -> DataFrame:
    return contig_join(tbv, top.select(*with_chrom(keys, top), "DBP_max", "DBP_event", "DBP_POS_max"), keys, "full_outer")


BPP_SCORES = ["sc_bps", "sc_ppt", "sc", "zsc_bps", "zsc_ppt", "zsc"]
BPP_Z = ["zsc_bps", "zsc_ppt", "zsc"]


def bpp_delta(scores: DataFrame, wt: DataFrame) -> DataFrame:
    """Scores of all variants (id such as ``g123:A>G``) beside the reference at each branch position.

    Branch positions are few and every variant has them, so the reference joins from the left, where
    Catalyst may broadcast it; positions of the reference alone are added after.
    """
    where, change = F.split(F.col("id"), ":")[0], F.split(F.col("id"), ":")[1]
    df = scores.withColumns(
        {"hg19_pos": F.substr(where, F.lit(2)).cast("int"), "ref": F.split(change, ">")[0], "alt": F.split(change, ">")[1]}
    )
    base = wt.select("bp_pos", *[F.col(c).alias(f"{c}_wt") for c in BPP_SCORES])
    out = df.join(base, "bp_pos", "left")
    alone = base.join(scores.select("bp_pos").distinct(), "bp_pos", "left_anti")
    out = out.unionByName(alone, allowMissingColumns=True)
    return out.withColumns({f"DS_{c}": F.col(c) - F.col(f"{c}_wt") for c in BPP_Z})


def bpp_max(delta: DataFrame, first_bp: int, rev: bool = False) -> DataFrame:
    """Per variant and score: the change of largest size with its sign, and its genome offset."""
    sign = -1 if rev else 1
    aggs = []
    for c in BPP_Z:
        d = F.col(f"DS_{c}")
        aggs.append(F.max(F.when(d.isNotNull(), F.struct(F.abs(d).alias("a"), (-F.col("bp_pos")).alias("p"), d.alias("d")))).alias(f"_{c}"))
    out = delta.filter(F.col("id").isNotNull()).groupBy("id", "hg19_pos", "ref", "alt").agg(*aggs)
    cols = {}
    for c in BPP_Z:
        cols[f"DS_{c}_max"] = F.col(f"_{c}.d")
        cols[f"DS_{c}_POS_max"] = F.lit(first_bp) + F.col(f"_{c}.p") * sign - F.col("hg19_pos")
    return out.withColumns(cols).drop(*[f"_{c}" for c in BPP_Z])


def merge_bpp(tbv: DataFrame, top: DataFrame, keys: tuple[str, ...] = ("hg19_pos", "ref", "alt")) -> DataFrame:
    return contig_join(tbv, top.select(*with_chrom(keys, top), *[c for c in top.columns if c.startswith("DS_")]), keys, "full_outer")


def merge_bpp_wt(tbv: DataFrame, wt: DataFrame, first_bp: int, rev: bool = False, pos: str = "hg19_pos") -> DataFrame:
    """Reference scores at the genome position of each branch position."""
    at = F.lit(first_bp) - F.col("bp_pos") * (-1 if rev else 1)
    rows = wt.select(at.alias(pos), F.col("zsc_bps").alias("zbpp_wt_bps"), F.col("zsc_ppt").alias("zbpp_wt_ppt"), F.col("zsc").alias("zbpp_wt"))
    return tbv.join(rows, pos, "full_outer")


def merge_wt_branchpoint(tbv: DataFrame, bp: DataFrame, keys: tuple[str, ...] = ("hg19_pos",)) -> DataFrame:
    """Reference branch-point probability at each position."""
    return merge_scores(tbv, bp.select(F.col("test_site").alias("hg19_pos"), F.col("branchpoint_prob").alias("bp_wt_prob")), list(keys))
