"""Aligned reads to isoforms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juncture.functions.columns import as_col, is_true
from juncture.functions.sequence import reverse_complement
from juncture.operators.reference import with_span

BLOCKS = "array<struct<start:int,end:int>>"


def cigar_ops(cigar: Column | str) -> Column:
    """CIGAR text as an array of (op, n)."""
    parts = F.filter(F.split(as_col(cigar), "(?<=[MIDNSHP=X])"), lambda t: F.length(t) > 1)
    return F.transform(parts, lambda t: F.struct(F.right(t, F.lit(1)).alias("op"), F.substr(t, F.lit(1), F.length(t) - 1).cast("int").alias("n")))


def per_shape(df: DataFrame, shape: dict[str, Column], results: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add what ``results`` makes of the shape columns, worked out once for each distinct shape.

    Reads have far fewer shapes than rows, and the shapes are made distinct before any shuffle. The dictionary comes back by a join:
    broadcast if Catalyst finds it small, else by shape, where adaptive skew handling splits the rows of the commonest one.
    """
    keys = [f"_shape_{c}" for c in shape]
    dictionary = results(df.select(*[v.alias(c) for c, v in shape.items()]).distinct())
    made = [c for c in dictionary.columns if c not in shape]
    dictionary = dictionary.withColumnsRenamed(dict(zip(shape, keys)))
    same = reduce(lambda a, b: a & b, [v.eqNullSafe(F.col(k)) for v, k in zip(shape.values(), keys)])
    return df.join(dictionary, same).select(*[df[f"`{c}`"] for c in df.columns], *made)


def with_blocks(reads: DataFrame, out: str = "blocks") -> DataFrame:
    """Reads (pos, cigar, ...) with their blocks."""
    return per_shape(reads, {c: F.col(c) for c in ("pos", "cigar")}, lambda d: d.withColumn(out, cigar_to_blocks("pos", "cigar")))


def first_block_start(pos: Column, cigar: Column) -> Column:
    """0-based start of a record's first block; null without one. Only deletions and skips before it move it."""
    lead = F.regexp_extract(cigar, r"^((?:\d+[INDSHP])*)\d+[M=X]", 1)
    moved = F.aggregate(cigar_ops(lead), F.lit(0), lambda a, o: a + F.when(o["op"].isin("D", "N"), o["n"]).otherwise(0))
    start = pos - 1 + F.when(lead.rlike("[DN]"), moved).otherwise(0)
    return F.when(cigar.rlike("[M=X]"), start)


def cigar_to_blocks(pos: Column | str, cigar: Column | str) -> Column:
    """Aligned blocks, 0-based and half-open, of a read that starts at a 1-based position."""
    return ops_to_blocks(pos, cigar_ops(cigar))


def ops_to_blocks(pos: Column | str, ops: Column) -> Column:
    start = F.struct((as_col(pos) - 1).cast("int").alias("at"), F.array().cast(BLOCKS).alias("blocks"))

    def step(acc: Column, o: Column) -> Column:
        end = acc["at"] + o["n"]
        block = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        match = o["op"].isin("M", "=", "X")
        moved = F.when(match | o["op"].isin("D", "N"), end).otherwise(acc["at"])
        return F.struct(moved.alias("at"), F.when(match, F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"))

    return F.aggregate(ops, start, step, lambda acc: acc["blocks"])


QC_WORDS = ["unpaired", "secondary", "unmapped", "bad_starts", "bad_ends", "soft_clipped"]


def flag(bit: int, col: Column | str = "flag") -> Column:
    return as_col(col).bitwiseAND(bit) != 0


def read_status(record: Column | str = "flag", counting: bool = False) -> Column:
    """Class of one record; null when it is mapped.

    Discovery tests for secondary records first and also looks at the mate; counting per barcode
    tests for unpaired records first.
    """
    f = as_col(record)
    tests = {"secondary": flag(0x100, f), "unpaired": ~flag(0x1, f), "unmapped": flag(0x4, f) | flag(0x8, f)}
    order = ["unpaired", "secondary", "unmapped"] if counting else ["secondary", "unpaired", "unmapped"]
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(tests[name], F.lit(name)).otherwise(out)
    return out


def pair_reads(reads: DataFrame, keys: tuple[str, ...] = ("sample", "barcode", "qname")) -> DataFrame:
    """One row per query name with both mates, the leftmost one first.

    One aggregation instead of a self-join.  A name has two records, so aggregating before the
    shuffle would only sort the input once more: rows are partitioned by name first.
    """
    record = F.struct("flag", "pos", "cigar", first_block_start(F.col("pos"), F.col("cigar")).alias("at"))
    second = flag(0x80)
    one, two = F.min(F.when(~second, record)), F.min(F.when(second, record))
    both = reads.select(*keys, "flag", "pos", "cigar").repartition(*keys).groupBy(*keys).agg(one.alias("_1"), two.alias("_2"))
    both = both.filter(F.col("_1").isNotNull() & F.col("_2").isNotNull())
    swap = is_true(F.col("_1.at") > F.col("_2.at"))

    def mate(m: str) -> Column:
        return F.struct(*[F.col(f"_{m}.{c}").alias(c) for c in ("flag", "pos", "cigar")])

    return both.select(
        *keys,
        F.col("_1.flag").alias("flag1"),
        F.col("_2.flag").alias("flag2"),
        F.when(swap, mate("2")).otherwise(mate("1")).alias("left"),
        F.when(swap, mate("1")).otherwise(mate("2")).alias("right"),
    )


def _aligned(blocks: Column) -> Column:
    # counted with one extra base per block, as the thresholds expect
    return F.aggregate(blocks, F.lit(0), lambda a, b: a + b["end"] - b["start"] + 1)


def _block(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _but_last(blocks: Column) -> Column:
    return F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))


def _last(blocks: Column) -> Column:
    return F.try_element_at(blocks, F.lit(-1))


def join_touching(blocks: Column, gap: int) -> Column:
    """Join a block to the one before it when it starts ``gap`` after that one's end.

    The comparison and the joined start use the preceding input block, so a run of three keeps
    the last two only.
    """
    none = F.lit(None).cast("struct<start:int,end:int>")
    start = F.struct(F.array().cast(BLOCKS).alias("out"), none.alias("prev"))

    def step(acc: Column, b: Column) -> Column:
        touch = F.coalesce(b["start"] == acc["prev"]["end"] + gap, F.lit(False))
        joined = F.concat(_but_last(acc["out"]), F.array(_block(acc["prev"]["start"], b["end"])))
        return F.struct(F.when(touch, joined).otherwise(F.concat(acc["out"], F.array(b))).alias("out"), b.alias("prev"))

    return F.aggregate(blocks, start, step, lambda acc: acc["out"])


def normalize_junctions_se(
    blocks: Column | str, cnst: tuple[tuple[int, int], tuple[int, int]], tol: int = 3, min_matches: int = 120
) -> Column:
    """Single-end blocks to a struct (status, isoform): 1-based blocks between the constant exons."""
    b = as_col(blocks)
    (_, donor), (acceptor, _) = cnst
    reaches = (F.size(b) == 0) | (_last(b)["end"] < acceptor) | F.exists(b, lambda x: x["start"].between(acceptor - tol, acceptor + tol))
    shifted = F.transform(b, lambda x: _block(x["start"] + 1, x["end"]))
    inside = F.filter(shifted, lambda x: (x["start"] >= donor) & (x["end"] < acceptor + 1))
    joined = join_touching(inside, 1)
    short_end = F.coalesce(_last(joined)["end"] - _last(joined)["start"] <= tol, F.lit(False))
    iso = F.when(short_end, _but_last(joined)).otherwise(joined)
    status = F.when(~reaches, "bad_ends").when(_aligned(b) < min_matches, "soft_clipped")
    return F.struct(status.alias("status"), F.when(status.isNull(), iso).alias("isoform"))


def collapse_indels(blocks: Column, ops: Column, spl_tol: int, indel_tol: int) -> Column:
    """Blocks of one mate with small indels closed.

    The element after a closed indel is skipped.  A match run shorter than ``spl_tol`` is skipped
    without moving on to the next block.
    """
    start = F.struct(F.array().cast(BLOCKS).alias("out"), F.lit(0).alias("j"), F.lit(False).alias("skip"))

    def step(acc: Column, o: Column) -> Column:
        here = F.get(blocks, acc["j"])
        match = ~acc["skip"] & (o["op"] == "M") & (o["n"] >= spl_tol)
        indel = ~acc["skip"] & ~match & (F.size(acc["out"]) > 0) & o["op"].isin("I", "D") & (o["n"] <= indel_tol)
        last = _last(acc["out"])
        closed = F.concat(_but_last(acc["out"]), F.array(_block(last["start"], F.coalesce(here["end"], last["end"]))))
        out = F.when(match & here.isNotNull(), F.concat(acc["out"], F.array(here))).when(indel, closed).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(match | indel, acc["j"] + 1).otherwise(acc["j"]).alias("j"), indel.alias("skip"))

    collapsed = F.aggregate(ops, start, step, lambda acc: acc["out"])
    return F.when(F.exists(ops, lambda o: o["op"].isin("I", "D")), collapsed).otherwise(blocks)


def normalize_junctions_pe(
    pairs: DataFrame,
    cnst: tuple[tuple[int, int], tuple[int, int]],
    spl_tol: int = 3,
    indel_tol: int = 20,
    min_left: int = 70,
    min_right: int = 50,
) -> DataFrame:
    """Add (status, isoform) to pairs from :func:`pair_reads`; the first failing check names the status.

    Both follow from the mates' positions and CIGARs, so each distinct pair of those is normalised once.
    """
    shape = {f"{m}_{c}": F.col(f"{m}.{c}") for m in ("left", "right") for c in ("pos", "cigar")}
    return per_shape(pairs, shape, lambda d: _normalized_shapes(d, cnst, spl_tol, indel_tol, min_left, min_right))


def _normalized_shapes(shapes: DataFrame, cnst: tuple[tuple[int, int], tuple[int, int]], spl_tol: int, indel_tol: int, min_left: int, min_right: int) -> DataFrame:
    (_, donor), (acceptor, _) = cnst
    # one-row generators keep what they yield from being worked out again in every later expression
    df = shapes.select("*", F.inline(F.array(F.struct(cigar_ops("left_cigar").alias("_lo"), cigar_ops("right_cigar").alias("_ro")))))
    df = df.select("*", F.inline(F.array(F.struct(ops_to_blocks("left_pos", F.col("_lo")).alias("_lb"), ops_to_blocks("right_pos", F.col("_ro")).alias("_rb")))))
    a, b = F.col("_lb"), F.col("_rb")
    df = df.withColumns({"_a": collapse_indels(a, F.col("_lo"), spl_tol, indel_tol), "_b": collapse_indels(b, F.col("_ro"), spl_tol, indel_tol)})
    ca, cb = F.col("_a"), F.col("_b")
    first = F.get(cb, F.lit(0))
    apart = F.coalesce(_last(ca)["end"] <= first["start"], F.lit(False))
    bridged = F.concat(
        _but_last(ca), F.array(_block(_last(ca)["start"], first["end"])), F.slice(cb, F.lit(2), F.greatest(F.size(cb) - 1, F.lit(0)))
    )
    df = df.withColumn("_all", F.array_sort(F.when(apart, bridged).otherwise(F.concat(ca, cb))))
    start = F.struct(F.array().cast(BLOCKS).alias("out"), F.lit(False).alias("us"), F.lit(False).alias("ds"))

    def step(acc: Column, x: Column) -> Column:
        us = x["end"].between(donor - spl_tol, donor + spl_tol)
        ds = ~us & x["start"].between(acceptor - spl_tol, acceptor + spl_tol)
        s, e = x["start"] + 1, x["end"]
        keep = ~us & ~ds & (s >= donor) & (e < acceptor + 1)
        last = _last(acc["out"])
        fresh = (F.size(acc["out"]) == 0) | F.coalesce(s > last["end"], F.lit(False))
        added = F.when(fresh, F.concat(acc["out"], F.array(_block(s, e)))).otherwise(
            F.concat(_but_last(acc["out"]), F.array(_block(last["start"], e)))
        )
        return F.struct(F.when(keep, added).otherwise(acc["out"]).alias("out"), (acc["us"] | us).alias("us"), (acc["ds"] | ds).alias("ds"))

    df = df.withColumn("_n", F.aggregate("_all", start, step))
    status = (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "unmapped")
        .when((_aligned(a) < min_left) | (_aligned(b) < min_right), "soft_clipped")
        .when(~F.col("_n.ds"), "bad_ends")
        .when(~F.col("_n.us"), "bad_starts")
    )
    df = df.withColumn("_s", status)
    result = F.struct(F.col("_s").alias("status"), F.when(F.col("_s").isNull(), F.col("_n.out")).alias("isoform"))
    return df.select(*shapes.columns, F.inline(F.array(result)))


def single_end_outcomes(reads: DataFrame, cnst: tuple[tuple[int, int], tuple[int, int]], tol: int = 3, min_matches: int = 120) -> DataFrame:
    """Single-end reads with (status, isoform): one pass whose rows serve as counts, soft-clipped table and rejected reads.

    The first failing check names the status: ``unmapped``, then ``bad_starts`` (no block ends within ``tol`` of the upstream donor), then
    those of :func:`normalize_junctions_se`.
    """
    donor = cnst[0][1]

    def outcome(shapes: DataFrame) -> DataFrame:
        df = shapes.select("*", F.inline(F.array(F.struct(cigar_to_blocks("pos", "cigar").alias("_b")))))
        starts = F.exists("_b", lambda x: x["end"].between(donor - tol, donor + tol))
        return df.select(*shapes.columns, starts.alias("_starts"), normalize_junctions_se("_b", cnst, tol, min_matches).alias("_n"))

    df = per_shape(reads, {c: F.col(c) for c in ("pos", "cigar")}, outcome)
    status = F.when(flag(0x4), "unmapped").when(~F.col("_starts"), "bad_starts").otherwise(F.col("_n.status"))
    return df.select(*reads.columns, status.alias("status"), F.when(status.isNull(), F.col("_n.isoform")).alias("isoform"))


def rejected_reads(outcomes: DataFrame) -> DataFrame:
    """The reads that no isoform count holds, with the reason."""
    return outcomes.filter(F.col("status").isNotNull())


def repair_constant_junctions(reads: DataFrame, chunks: DataFrame, cnst: tuple[tuple[int, int], tuple[int, int]], chrom: str) -> DataFrame:
    """Move block ends to the constant-exon boundary where the borrowed bases read the same.

    ``chunks`` holds the construct ``chrom`` (see :func:`juncture.operators.reference.reference_chunks`). Each distinct list of blocks is judged
    once, and only the bases at its two borders are looked up.
    """
    (_, donor), (acceptor, _) = cnst
    b = F.col("blocks")
    inside = (F.size(b) > 1) & ~F.forall(b, lambda x: x["end"] < donor) & ~F.forall(b, lambda x: x["start"] > acceptor)
    short = F.exists(b, lambda x: x["end"] < donor) & ~F.exists(b, lambda x: x["end"] == donor)
    late = ~short & F.exists(b, lambda x: x["start"] > acceptor) & ~F.exists(b, lambda x: x["start"] == acceptor)

    i = F.size(F.filter(b, lambda x: x["end"] < donor)) - 1
    bad, nxt = F.get(b, i), F.get(b, i + 1)
    d = F.lit(donor) - bad["end"]
    moved_up = F.transform(
        b, lambda x, k: F.when(k == i, _block(x["start"], F.lit(donor))).when(k == i + 1, _block(x["start"] + d, x["end"])).otherwise(x)
    )
    j = F.size(F.filter(b, lambda x: x["start"] <= acceptor))
    bad2, prev = F.get(b, j), F.get(b, j - 1)
    d2 = bad2["start"] - acceptor
    moved_down = F.transform(
        b, lambda x, k: F.when(k == j, _block(F.lit(acceptor), x["end"])).when(k == j - 1, _block(x["start"], x["end"] - d2)).otherwise(x)
    )

    def borrowed(own: Column, other: Column, size: Column, moved: Column) -> Column:
        # spans of equal length, 1-based and with both ends
        return F.struct((own + 1).alias("_s1"), (own + size).alias("_e1"), (other + 1).alias("_s2"), (other + size).alias("_e2"), moved.alias("_moved"))

    up = F.when(short & (nxt["end"] - nxt["start"] >= d), borrowed(bad["end"], nxt["start"], d, moved_up))
    down = F.when(late & (prev["end"] - prev["start"] >= d2), borrowed(F.lit(acceptor), prev["end"] - d2, d2, moved_down))
    shapes = reads.select("blocks").distinct().filter(inside)
    cases = shapes.select("blocks", F.explode(F.array_compact(F.array(up, down))).alias("_c")).select("blocks", "_c.*", F.lit(chrom).alias("chrom"))
    cases = with_span(with_span(cases, chunks, "_s1", "_e1", "_x1"), chunks, "_s2", "_e2", "_x2").filter("_x1 = _x2")
    fixed = cases.select(F.col("blocks").alias("_old"), "_moved")
    out = reads.join(fixed, F.col("blocks").eqNullSafe(F.col("_old")), "left")
    mapped = ~is_true(flag(0x4))
    return out.withColumn("blocks", F.when(mapped & F.col("_moved").isNotNull(), F.col("_moved")).otherwise(b)).drop("_old", "_moved")


def primary_alignments(reads: DataFrame) -> DataFrame:
    """Records without a hit index, or with the first one."""
    return reads.filter(F.col("hi").isNull() | (F.col("hi") == 1))


def barcode_sequences(reads: DataFrame, mapping: str = "mapped", barcode: str | None = None) -> DataFrame:
    """Distinct sequences in read direction with their counts."""
    rows = reads if barcode is None else reads.filter(F.col("barcode") == barcode)
    unmapped = flag(0x4)
    rows = {"mapped": rows.filter(~unmapped), "unmapped": rows.filter(unmapped), "both": rows}[mapping]
    forward = F.when(flag(0x10), reverse_complement("seq")).otherwise(F.col("seq"))
    return rows.groupBy("barcode", forward.alias("seq")).agg(F.count(F.lit(1)).alias("n"))


def compare_aligners(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Primary and other CIGAR per read name from two aligners, and whether the primaries agree.

    The first marks other hits by the secondary flag, the second by the hit index.
    """
    text = F.when(flag(0x4), "*").otherwise(F.col("cigar"))

    def side(df: DataFrame, primary: Column, name: str) -> DataFrame:
        first = flag(0x4) | F.coalesce(primary, F.lit(False))
        return df.groupBy("barcode", "qname").agg(
            F.max(F.when(first, text)).alias(f"{name}_prim_cigar"), F.max(F.when(~first, text)).alias(f"{name}_alt_cigar")
        )

    out = side(a, ~flag(0x100), names[0]).join(side(b, F.col("hi") == 1, names[1]), ["barcode", "qname"], "left")
    same = F.col(f"{names[0]}_prim_cigar") == F.col(f"{names[1]}_prim_cigar")
    return out.withColumn("same_primary", F.coalesce(same, F.lit(False)))


def read_layout_mode(reads: DataFrame, top: int = 3, enough: float = 80.0) -> DataFrame:
    """Most common starts and read lengths of the mapped reads, with their share."""
    mapped = reads.filter(~flag(0x4)).select(F.col("pos").alias("start"), F.length("seq").alias("length"))
    values = mapped.select(F.explode(F.map_from_arrays(F.array(F.lit("start"), F.lit("length")), F.array("start", "length"))).alias("kind", "value"))
    counts = values.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("_total"))
    best = [
        counts.filter(F.col("kind") == k).orderBy(F.desc("n"), "value").limit(top) for k in ("start", "length")
    ]
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "value")
    ranked = best[0].union(best[1]).withColumn("rank", F.row_number().over(order)).join(totals, "kind")
    share = F.col("n") * 100.0 / F.col("_total")
    lead = F.max(F.when(F.col("rank") == 1, share)).over(Window.partitionBy("kind"))
    return ranked.withColumns({"percent": share, "low_share": lead < enough}).drop("_total")
