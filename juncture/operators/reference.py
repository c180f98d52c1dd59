"""Reference sequence as overlapping chunks, and everything read from it per variant.

A contig is cut into chunks of fixed length that overlap by a flank, so a window around a
position is one equi-join on (contig, chunk).  No task ever holds a whole contig and a contig
that owns most variants spreads over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import is_true
from juncture.functions.sequence import amino_acid, reverse_complement

CHUNK = 4096
FLANK = 256


def reference_chunks(base: DataFrame, chunk: int = CHUNK, flank: int = FLANK) -> DataFrame:
    """Chunks (chrom, chunk, start, seq) from one row per position (chrom, pos, base)."""
    low = F.floor((F.col("pos") - flank) / chunk)
    high = F.floor((F.col("pos") + flank) / chunk)
    rows = base.select("chrom", "pos", "base", F.explode(F.sequence(low, high)).alias("chunk"))
    # a group holds at most chunk + 2 * flank rows
    return rows.groupBy("chrom", "chunk").agg(
        F.min("pos").alias("start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"),
    )


def chunk_sequences(seqs: DataFrame, chunk: int = CHUNK, flank: int = FLANK) -> DataFrame:
    """The same from whole sequences (name, seq), first base at position 1; no shuffle.

    A sequence is cut in two steps, so each chunk is read from a piece of about the square root of the
    sequence's chunks and the work grows with length to the power 1.5 at most.  Contigs of a genome come line by
    line instead, see :func:`chunk_lines`.
    """
    piece = 64 * chunk
    n = F.length("seq")
    pieces = F.sequence(F.floor((1 - F.lit(flank)) / piece), F.floor((n + flank) / piece))
    rows = seqs.select(F.col("name").alias("chrom"), "seq", F.explode(pieces).alias("_piece"))
    first = F.greatest(F.col("_piece") * piece - flank, F.lit(1)).cast("int")
    part = F.substr("seq", first, (F.col("_piece") * piece + piece + flank - first).cast("int"))
    cut = rows.select("chrom", "_piece", first.alias("_first"), part.alias("_part")).filter(F.length("_part") > 0)
    ids = F.sequence(F.floor(F.greatest(F.col("_piece") * piece, F.lit(1 - flank)) / chunk), F.floor((F.col("_piece") * piece + piece - 1) / chunk))
    rows = cut.select("chrom", "_first", "_part", F.explode(ids).alias("chunk"))
    start = F.greatest(F.col("chunk") * chunk - flank, F.lit(1)).cast("int")
    end = F.col("chunk") * chunk + chunk + flank - 1
    seq = F.substr("_part", start - F.col("_first") + 1, (end - start + 1).cast("int"))
    return rows.select("chrom", "chunk", start.alias("start"), seq.alias("seq")).filter(F.length("seq") > 0)


def chunk_lines(lines: DataFrame, chunk: int = CHUNK, flank: int = FLANK) -> DataFrame:
    """The same from lines of records (name, start, seq), ``start`` being the position of a line's first base.

    No row and no task ever holds a contig: a line goes to the chunks it touches, and a group has the lines of one chunk.
    """
    end = F.col("start") + F.length("seq") - 1
    ids = F.sequence(F.floor((F.col("start") - flank) / chunk), F.floor((end + flank) / chunk))
    rows = lines.filter(F.length("seq") > 0).select(F.col("name").alias("chrom"), "start", "seq", F.explode(ids).alias("chunk"))
    low = F.greatest(F.col("chunk") * chunk - flank, F.lit(1))
    high = F.col("chunk") * chunk + chunk + flank - 1
    skipped = F.greatest(low - F.col("start"), F.lit(0)).cast("int")
    part = F.substr("seq", skipped + 1, F.greatest(high - F.col("start") - skipped + 1, F.lit(0)).cast("int"))
    cut = rows.select("chrom", "chunk", (F.col("start") + skipped).alias("start"), part.alias("seq")).filter(F.length("seq") > 0)
    return cut.groupBy("chrom", "chunk").agg(
        F.min("start").cast("int").alias("start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "").alias("seq"),
    )


def cut_window(seq: Column, start: Column, first: Column, size: Column | int) -> Column:
    """``size`` bases from position ``first`` of a chunk that starts at ``start``; N outside."""
    size = F.lit(size) if isinstance(size, int) else size
    missing = F.least(F.greatest(start - first, F.lit(0)), size).cast("int")
    inside = F.substr(seq, F.greatest(first - start + 1, F.lit(1)).cast("int"), (size - missing).cast("int"))
    return F.rpad(F.concat(F.repeat(F.lit("N"), missing), F.coalesce(inside, F.lit(""))), size, F.lit("N"))


def with_window(
    df: DataFrame,
    chunks: DataFrame,
    left: int,
    right: int,
    out: str = "window",
    pos: str = "pos",
    chunk: int = CHUNK,
    flank: int = FLANK,
) -> DataFrame:
    """Add the reference from ``left`` bases before to ``right`` bases after each position."""
    if max(left, right) > flank:
        raise ValueError(f"windows beyond {flank} bases need chunks with a larger flank")
    # variants crowd on few positions: each position is looked up once, and a chunk has a bounded number of them
    sites = df.select("chrom", F.col(pos).alias("_at")).distinct().withColumn("_chunk", F.floor(F.col("_at") / chunk))
    ref = chunks.select("chrom", F.col("chunk").alias("_chunk"), F.col("start").alias("_start"), F.col("seq").alias("_seq"))
    size = left + right + 1
    window = F.upper(cut_window(F.col("_seq"), F.col("_start"), F.col("_at") - left, size))
    found = sites.join(ref, ["chrom", "_chunk"]).select(F.col("chrom").alias("_contig"), "_at", window.alias(out))
    joined = df.join(found, (F.col("chrom") == F.col("_contig")) & (F.col(pos) == F.col("_at")), "left").drop("_contig", "_at")
    return joined.withColumn(out, F.coalesce(out, F.lit("N" * size)))


def with_span(df: DataFrame, chunks: DataFrame, start: str, end: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Add the reference from position ``start`` to ``end``, both included, however long; N outside.

    Each distinct span is put together from its pieces of the chunks it crosses.
    """
    on = ["chrom", start, end]
    wanted = df.select(*on).distinct()
    pieces = wanted.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col(start) / chunk), F.floor(F.col(end) / chunk))))
    ref = chunks.select("chrom", F.col("chunk").alias("_chunk"), F.col("start").alias("_start"), F.col("seq").alias("_seq"))
    first = F.greatest(F.col(start), F.col("_chunk") * chunk)
    size = (F.least(F.col(end), F.col("_chunk") * chunk + chunk - 1) - first + 1).cast("int")
    part = F.when(F.col("_seq").isNull(), F.repeat(F.lit("N"), size)).otherwise(cut_window(F.col("_seq"), F.col("_start"), first, size))
    joined = pieces.join(ref, ["chrom", "_chunk"], "left").select(*on, F.struct("_chunk", F.upper(part).alias("text")).alias("_p"))
    spans = joined.groupBy(*on).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["text"]), "").alias(out))
    return df.join(spans, on)


def check_reference(df: DataFrame, window: str, left: int, ref: str = "ref", right: int | None = None) -> DataFrame:
    """Stop when the reference base of a variant differs from the sequence.

    The check sits in the window, not in the key: a key takes part in inferred join filters, which
    may run before the filters of the caller.  Where the window ends ``right`` bases after the variant's first, a longer
    allele is checked as far as the window goes.
    """
    allele = F.upper(ref) if right is None else F.substr(F.upper(ref), F.lit(1), F.lit(right + 1))
    here = F.substr(F.col(window), F.lit(left + 1), F.length(allele))
    bad = F.raise_error(F.concat(F.lit("reference mismatch at "), F.col("pos").cast("string"))).cast("string")
    return df.withColumn(window, F.when(here == allele, F.col(window)).otherwise(bad))


def splice_dinucleotide_flags(tbv: DataFrame, chunks: DataFrame, sdv: str, suffix: str = "") -> DataFrame:
    """Reference AG/GT at the variant, and whether the change could make one.

    Only dinucleotides between the first and last position of a contig in the table count.  For each of
    them the first rule of AG, GT, A?, ?G, G?, ?T decides.
    """
    wide = with_window(tbv, chunks, 1, 1, "_w")
    bounds = tbv.groupBy("chrom").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    wide = wide.join(bounds, "chrom")
    before = F.when(F.col("pos") > F.col("_lo"), F.substr("_w", F.lit(1), F.lit(2)))
    after = F.when(F.col("pos") < F.col("_hi"), F.substr("_w", F.lit(2), F.lit(2)))
    alt = F.col("alt")

    def known(d: Column) -> Column:
        return d.isin("AG", "GT")

    # each side may be absent at the edge of the table: a missing comparison is false on its own
    def either(test) -> Column:
        return is_true(test(before)) | is_true(test(after))

    acc = is_true(~known(before) & before.startswith("A") & (alt == "G")) | is_true(
        ~known(after) & ~after.startswith("A") & after.endswith("G") & (alt == "A")
    )
    don = is_true(~known(before) & before.startswith("G") & ~before.endswith("G") & (alt == "T")) | is_true(
        ~known(after) & ~after.rlike("^[AG]") & after.endswith("T") & (alt == "G")
    )
    return wide.withColumns(
        {
            "wt_acc": either(lambda d: d == "AG"),
            "wt_don": either(lambda d: d == "GT"),
            "psbl_snv_acc": acc,
            "psbl_snv_don": don,
            f"snv_acc{suffix}": is_true(F.col(sdv)) & acc,
            f"snv_don{suffix}": is_true(F.col(sdv)) & don,
        }
    ).drop("_w", "_lo", "_hi")


def created_site_flags(tbv: DataFrame, chunks: DataFrame, rev: bool = False, out=("acceptor_created", "donor_created")) -> DataFrame:
    """Would the alternate base make AG or GT with a neighbour on its strand?"""
    wide = check_reference(with_window(tbv, chunks, 1, FLANK // 4, "_w"), "_w", 1, right=FLANK // 4)
    alt = reverse_complement("alt") if rev else F.col("alt")
    left, right = F.substr("_w", F.lit(1), F.lit(1)), F.substr("_w", F.lit(3), F.lit(1))
    if rev:
        left, right = reverse_complement(right), reverse_complement(left)
    acc = ((alt == "A") & (right == "G")) | ((alt == "G") & (left == "A"))
    don = ((alt == "T") & (left == "G")) | ((alt == "G") & (right == "T"))
    return wide.withColumns({out[0]: acc, out[1]: don}).drop("_w")


def frameshift_flag(tbv: DataFrame, flag: str, exon_bound: int, acceptor: bool) -> DataFrame:
    """Is the distance from a new site to the exon boundary not a multiple of three?"""
    offsets = {"A": 2, "G": 1} if acceptor else {"G": 1, "T": 0}
    base = F.upper("alt")
    shift = F.lit(None).cast("int")
    for b, o in offsets.items():
        shift = F.when(base == b, F.lit(o)).otherwise(shift)
    gap = F.pmod(F.lit(exon_bound) - F.col("pos") - shift, F.lit(3))
    return tbv.withColumn("frameshift_acc" if acceptor else "frameshift_don", is_true(F.col(flag)) & is_true(gap != 0))


OUT_OF_FRAME = "Exonic - out of frame"


def _codon_parts(exon: tuple[int, int], frame: int) -> tuple[Column, Column, Column]:
    """Place of the base in its codon (0-2), the codon, and whether it lies whole in the exon."""
    rel = F.col("pos") - exon[0] - frame
    place = F.pmod(rel, F.lit(3))
    codon = F.substr(F.col("_w"), 3 - place, F.lit(3))
    whole = (rel >= 0) & (F.col("pos") - place + 2 <= exon[1])
    return place, codon, whole


def reference_codon(tbv: DataFrame, chunks: DataFrame, exon: tuple[int, int], frame: int = 0) -> DataFrame:
    """Reference amino acid under each variant; null outside whole codons of the exon."""
    wide = with_window(tbv, chunks, 2, 2, "_w")
    _, codon, whole = _codon_parts(exon, frame)
    return wide.withColumn("ref_aa", F.when(whole, amino_acid(codon))).drop("_w")


def alternate_codon(tbv: DataFrame, chunks: DataFrame, exon: tuple[int, int], frame: int = 0) -> DataFrame:
    """Amino acid after the change.

    Bases before the frame and of a codon that runs on into the next exon are out of frame.
    The last base of the exon has no value, and neither has a change to the same base.
    """
    wide = with_window(tbv, chunks, 2, 2, "_w")
    place, codon, whole = _codon_parts(exon, frame)
    pos = F.col("pos")
    changed = F.concat(F.substr(codon, F.lit(1), place), F.col("alt"), F.substr(codon, place + 2))
    real = F.col("alt").isin("A", "C", "G", "T") & (F.col("alt") != F.substr("_w", F.lit(3), F.lit(1)))
    value = F.when(pos.between(exon[0], exon[0] + frame - 1), OUT_OF_FRAME).when(
        pos.between(exon[0] + frame, exon[1] - 1), F.when(whole, amino_acid(changed)).otherwise(OUT_OF_FRAME)
    )
    return wide.withColumn("alt_aa", F.when(real, value)).drop("_w")


def variant_consequence(tbv: DataFrame, chunks: DataFrame, exon: tuple[int, int], frame: int = 0) -> DataFrame:
    """Intronic, out of frame, Synonymous, Nonsense or Missense; the first that holds."""
    both = alternate_codon(reference_codon(tbv, chunks, exon, frame), chunks, exon, frame)
    ref, alt = F.col("ref_aa"), F.col("alt_aa")
    kind = (
        F.when(alt.isNull(), "Intronic")
        .when(alt == OUT_OF_FRAME, OUT_OF_FRAME)
        .when(ref == alt, "Synonymous")
        .when(alt == "X", "Nonsense")
        .otherwise("Missense")
    )
    return both.withColumn("var_type", kind)


def sdv_by_region(tbv: DataFrame) -> DataFrame:
    intronic = F.col("var_type") == "Intronic"
    return tbv.withColumns({"sdv_exon": F.col("sdv") & ~intronic, "sdv_intron": F.col("sdv") & intronic})


def identify_variants(tbv: DataFrame, wanted: DataFrame, out: str, keys: tuple[str, ...] = ("pos", "alt")) -> DataFrame:
    """Flag the rows whose key is in a list."""
    listed = wanted.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return tbv.join(listed, list(keys), "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def segment_edit_distance(reads: DataFrame, exons: DataFrame, chunks: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """Edit distance per exon between the reference and the next stretch of the read.

    ``reads`` (key, seq), ``exons`` (key, chrom, exon_num, start_pos, end_pos): the exons of a
    read are few, so the running length is a narrow window.  Exons may be of any length.
    """
    from pyspark.sql import Window

    size = F.col("end_pos") - F.col("start_pos") + 1
    order = Window.partitionBy(key).orderBy("exon_num").rowsBetween(Window.unboundedPreceding, -1)
    placed = exons.withColumn("_used", F.coalesce(F.sum(size).over(order), F.lit(0)))
    ref = with_span(placed, chunks, "start_pos", "end_pos", "_w", chunk)
    both = ref.join(reads.select(key, F.col("seq").alias("_read")), key)
    part = F.substr("_read", (F.col("_used") + 1).cast("int"), size.cast("int"))
    return both.withColumn("distance", F.levenshtein(F.col("_w"), part)).drop("_used", "_w", "_read")
