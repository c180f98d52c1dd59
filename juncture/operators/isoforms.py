"""Isoform catalogues, named groups, exon paths and isoform statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juncture.functions.columns import is_true, ratio
from juncture.functions.coordinates import isoform_text
from juncture.operators.barcodes import (
    add_unmapped_barcodes,
    barcode_isoform_counts,
    barcode_length_filter,
    join_subassembly_rna,
    psi,
    variant_summary_pe,
)
from juncture.operators.ordering import number_rows
from juncture.operators.paths import enumerate_paths, gene_models
from juncture.operators.reads import BLOCKS, QC_WORDS, _but_last, flag, join_touching

Block = tuple[int, int]


def block_array(blocks: list[Block]) -> Column:
    items = [F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in blocks]
    return F.array(*items).cast(BLOCKS)


def isoform_read_counts(pairs: DataFrame, keep_qc: bool = True) -> DataFrame:
    """Reads per sample and isoform; quality classes are rows of the same column.

    The single-end form (``keep_qc=False``) leaves out bad ends and soft-clipped reads.
    """
    rows = pairs if keep_qc else pairs.filter(~is_true(F.col("status").isin("bad_ends", "soft_clipped")))
    return rows.groupBy("sample", F.coalesce("status", "isoform").alias("isoform")).agg(F.count(F.lit(1)).alias("read_count"))


def soft_clipped_reads(pairs: DataFrame) -> DataFrame:
    """The reads behind the soft-clipped count, of pairs or of single ends."""
    return pairs.filter(F.col("status") == "soft_clipped")


def append_unmapped_total(counts: DataFrame, mate1: DataFrame, mate2: DataFrame | None = None) -> DataFrame:
    """Set the row ``unmapped`` of each sample to the larger of the two mates' totals."""
    parts = [mate1.select("sample", F.lit(1).alias("mate"))]
    if mate2 is not None:
        parts.append(mate2.select("sample", F.lit(2).alias("mate")))
    per_mate = reduce(DataFrame.union, parts).groupBy("sample", "mate").agg(F.count(F.lit(1)).alias("n"))
    total = per_mate.groupBy("sample").agg(F.max("n").alias("n"))
    samples = counts.select("sample").distinct().join(total, "sample", "full_outer")
    row = samples.select("sample", F.lit("unmapped").alias("isoform"), F.coalesce("n", F.lit(0)).alias("read_count"))
    return counts.filter(F.col("isoform") != "unmapped").unionByName(row)


def isoform_catalog(counts: DataFrame, samples: list[str]) -> DataFrame:
    """Distinct isoforms with a zero-filled count per sample and an id.

    Ids run by total reads, largest first, then by isoform text.
    """
    wide = counts.groupBy("isoform").pivot("sample", samples).sum("read_count").fillna(0)
    total = reduce(lambda a, b: a + b, [F.col(f"`{s}`") for s in samples])
    numbered = number_rows(wide.withColumn("_total", total), [-F.col("_total"), F.col("isoform")], "_n")
    width = wide.agg(F.length(F.count(F.lit(1)).cast("string")).alias("w"))
    isonum = F.concat(F.lit("iso"), F.lpad((F.col("_n") - 1).cast("string"), width.scalar(), F.lit("0")))
    return numbered.select(isonum.alias("isonum"), "isoform", *[F.col(f"`{s}`").alias(f"{s}_read_count") for s in samples])


def barcode_isoform_counts_by_start(reads: DataFrame, isoforms: dict[str, list[int]], start: int, tol: int = 4) -> DataFrame:
    """Older counting form: a read matches the isoform whose junctions are exactly those it touches.

    ``reads`` has the barcode, ``flag`` and 0-based ``blocks``.
    """
    every = sorted({j for js in isoforms.values() for j in js})
    touched = F.filter(
        F.array(*[F.lit(j) for j in every]),
        lambda j: F.exists("blocks", lambda b: (b["start"] <= j + tol) & (b["end"] - 1 >= j - tol)),
    )
    unmapped = flag(0x4)
    bad = ~unmapped & (F.abs(F.get("blocks", F.lit(0))["start"] - start) > tol)
    one = reads.select("barcode", unmapped.alias("u"), is_true(bad).alias("s"), touched.alias("j"))

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    good = ~F.col("u") & ~F.col("s")
    match = {n: total(good & (F.col("j") == F.array(*[F.lit(x) for x in js]))) for n, js in isoforms.items()}
    out = one.groupBy("barcode").agg(
        F.count(F.lit(1)).alias("num_reads"),
        total(F.col("u")).alias("unmapped_reads"),
        total(F.col("s")).alias("bad_starts"),
        *[v.alias(n) for n, v in match.items()],
    )
    out = out.withColumn("usable_reads", F.col("num_reads") - F.col("unmapped_reads") - F.col("bad_starts"))
    return psi(out, list(isoforms))


def named_isoform_groups(
    catalog: DataFrame, names: dict[str, list[Block]], excluded: list[Block], upstream_len: int, read_len: int, tol: int = 0
) -> DataFrame:
    """Name each isoform of the catalogue; the first matching name wins, else ``OTHER``.

    The names are a short list given by the caller, so they become one CASE and no join.
    """

    def outside(b: Column) -> Column:
        hit = [b["start"].between(s, e - 1) | b["end"].between(s, e - 1) for s, e in excluded]
        return ~reduce(lambda x, y: x | y, hit, F.lit(False))

    df = catalog.withColumn("_c", F.filter("isoform", outside))
    used = F.aggregate("_c", F.lit(upstream_len), lambda a, b: a + b["end"] - b["start"] + 1)
    df = df.withColumn("_near", F.lit(tol > 0) & (used >= read_len - tol) & (used < read_len + tol))
    c = F.col("_c")
    name = F.lit("OTHER")
    for n, blocks in reversed(list(names.items())):
        want = block_array(blocks)
        test = c == want
        if blocks:
            last = F.try_element_at(c, F.lit(-1))
            s, e = blocks[-1]
            close = (F.size(c) == len(blocks)) & F.col("_near") & (_but_last(c) == block_array(blocks[:-1]))
            test = test | is_true(close & (last["start"] == s) & (last["end"] >= e - tol) & (last["end"] < e + tol))
        name = F.when(test, F.lit(n)).otherwise(name)
    return df.withColumn("group", name).drop("_c", "_near")


def collapse_isoforms(stats: DataFrame, cryptic: list[Block], sum_cols: list[str], max_cols: list[str], total: str) -> DataFrame:
    """Merge isoforms that agree once the cryptic exons are dropped.

    A merged row carries its members, so it is as long as its part of the catalogue.
    """

    def outside(b: Column) -> Column:
        hit = [b["start"].between(s, e - 1) | b["end"].between(s, e - 1) for s, e in cryptic]
        return ~reduce(lambda x, y: x | y, hit, F.lit(False))

    df = stats.withColumn("comb_isoform", join_touching(F.filter("isoform", outside), 0))
    members = F.array_sort(F.collect_list(F.struct("isonum", isoform_text("isoform").alias("text"))))
    out = df.groupBy("comb_isoform").agg(
        *[F.sum(c).alias(c) for c in sum_cols],
        *[F.max(c).alias(c) for c in max_cols],
        F.count(F.lit(1)).alias("isoform_counts"),
        members.alias("_m"),
    )
    out = out.withColumn("_text", isoform_text("comb_isoform"))
    numbered = number_rows(out, [-F.col(total), F.col("_text")], "_n")
    width = out.agg(F.length(F.count(F.lit(1)).cast("string")).alias("w"))
    return numbered.withColumns(
        {
            "isogrp": F.concat(F.lit("isogrp"), F.lpad((F.col("_n") - 1).cast("string"), width.scalar(), F.lit("0"))),
            "comb_iso_nums": F.array_join(F.col("_m.isonum"), ","),
            "isoforms": F.array_join(F.col("_m.text"), ";"),
        }
    ).drop("_m", "_n", "_text")


def exon_path_enumeration(exons: DataFrame, gene: str = "gene", ranks: DataFrame | None = None) -> DataFrame:
    """All chains of exons from the first to the last exon of each gene, named in path order.

    A chain steps from an exon to any exon that starts after its end. ``ranks`` (gene, first, number) lists some of them.
    """
    models = gene_models(exons, gene).withColumn("read_start", F.lit(None).cast("int"))
    i = F.col("rank")
    name = F.concat(F.lit("iso"), F.when(i < 10, F.lpad(i.cast("string"), 2, "0")).otherwise(i.cast("string")))
    return enumerate_paths(models, True, ranks).select("gene", "path", name.alias("iso"))


def junction_path_enumeration(exons: DataFrame, starts: DataFrame, gene: str = "gene") -> DataFrame:
    """Older form: node paths from a read start inside an exon to the last exon end.

    ``starts`` (gene, read_start), one row per gene.  The read enters the last exon that starts at or before the
    read start; from then on acceptor and donor belong to the same exon.  Paths of two nodes are
    not paths.
    """
    if "exon_num" not in exons.columns:
        exons = exons.withColumn("exon_num", F.lit(0))
    starts = starts.select(F.col(gene).cast("string").alias("gene"), F.col("read_start").cast("int"))
    paths = enumerate_paths(gene_models(exons, gene).join(starts, "gene"), False)
    return paths.select("gene", F.flatten(F.transform("path", lambda b: F.array(b["start"], b["end"]))).alias("path"))


def visible_path(path: Column, read_start: Column, read_len: int) -> Column:
    """The part of an exon path that a read of fixed start and length covers; null if the start is absent."""
    start = F.struct(F.lit(read_len).alias("left"), F.lit(False).alias("seen"), F.array().cast(BLOCKS).alias("out"))

    def step(acc: Column, b: Column) -> Column:
        enters = ~acc["seen"] & read_start.between(b["start"], b["end"])
        live = (acc["seen"] | enters) & (acc["left"] > 0)
        s = F.when(enters, read_start).otherwise(b["start"])
        e = F.least(b["end"], s + acc["left"] - 1)
        out = F.concat(acc["out"], F.array(F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))))
        return F.struct(
            F.when(live, acc["left"] - (e - s + 1)).otherwise(acc["left"]).alias("left"),
            (acc["seen"] | enters).alias("seen"),
            F.when(live, out).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(path, start, step, lambda a: F.when(a["seen"], a["out"]))


def visible_isoforms(paths: DataFrame, read_start: Column, read_len: int, gene: str = "gene") -> DataFrame:
    """Group the paths a read cannot tell apart; members are the indistinguishable isoforms."""
    seen = paths.withColumn("visible", visible_path(F.col("path"), read_start, read_len))
    groups = seen.groupBy(gene, "visible").agg(F.array_join(F.array_sort(F.collect_list("iso")), ",").alias("members"))
    i = F.row_number().over(Window.partitionBy(gene).orderBy(F.col("visible").asc_nulls_last())) - 1
    return groups.withColumn("isogrp", F.concat(F.lit("isogrp"), F.when(i < 10, F.lpad(i.cast("string"), 2, "0")).otherwise(i.cast("string"))))


def isoform_variant_counts(bc_iso: DataFrame, sa: DataFrame) -> DataFrame:
    """Per (sample, isoform, variant list): barcodes, the largest read count of one, and all reads.

    ``bc_iso`` (sample, isoform, barcode, n) holds one row per barcode.
    """
    known = sa.filter(F.col("variant_list").isNotNull()).select("barcode", "variant_list")
    return (
        bc_iso.join(known, "barcode")
        .groupBy("sample", "isoform", "variant_list")
        .agg(F.count(F.lit(1)).alias("n_bc"), F.max("n").alias("max_n"), F.sum("n").alias("sum_n"))
    )


def isoform_variant_stats(per_variant: DataFrame) -> DataFrame:
    """Roll the variant counts up to (sample, isoform); no distinct count is needed."""
    return per_variant.groupBy("sample", "isoform").agg(
        F.sum("n_bc").alias("num_bcs"),
        F.count(F.lit(1)).alias("num_vars"),
        F.max("max_n").alias("max_reads_per_bc"),
        F.sum("sum_n").alias("sum_sa_reads"),
        F.max("n_bc").alias("max_bc_per_var"),
    )


def isoform_totals(stats: DataFrame, code: str = "filter") -> DataFrame:
    """Totals over samples, and in how many the isoform passes."""
    cols = [c for c in ("read_count", "num_bcs", "num_vars", "sum_sa_reads") if c in stats.columns]
    return stats.groupBy("isoform").agg(
        *[F.sum(c).alias(f"total_{c}") for c in cols], F.sum(F.when(F.col(code) != 0, 1).otherwise(0)).alias("total_passfilt")
    )


def variant_position_cluster(per_variant: DataFrame, min_size: int = 3, tol: int = 10, mean_bc: float = 3) -> DataFrame:
    """Isoforms with a cluster of variants, found greedily by barcode count.

    A variant joins the first cluster whose first member lies within ``tol``, so variants of one
    position share a cluster and only the ``min_size`` best of a position can matter: the test is
    made when a cluster reaches that size.  Members come by falling count, so a cluster can only
    reach the mean if its first member has it, and variants away from such members do not matter.
    Positions more than ``tol`` apart never interact, which cuts an isoform into independent
    stretches; a Python task reads the sorted stretches as a stream and keeps only the first
    members of one, by cells of ``tol + 1`` positions, which hold at most one each.
    """
    on = ["sample", "isoform"]
    one = per_variant.select(*on, "variant_list", "n_bc", F.posexplode(F.split("variant_list", ",")).alias("k", "v"))
    one = one.withColumn("pos", F.split("v", ":")[1].cast("int")).dropna(subset=[*on, "pos"])
    best = Window.partitionBy(*on, "pos").orderBy(F.desc("n_bc"), "variant_list", "k")
    top = one.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= min_size)
    top = top.select(*on, "variant_list", "k", "pos", "n_bc", F.floor(F.col("pos") / F.lit(tol + 1)).alias("cell"))
    strong = top.filter(F.col("n_bc") >= mean_bc).select(*on, F.explode(F.array(*[F.col("cell") + i for i in (-1, 0, 1)])).alias("cell"))
    # two runs of occupied cells with a free one between them never interact
    cells = strong.distinct()
    along = Window.partitionBy(*on).orderBy("cell")
    cells = cells.withColumn("_gap", is_true(F.col("cell") - F.lag("cell").over(along) > 1).cast("int"))
    cells = cells.withColumn("stretch", F.sum("_gap").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_gap")
    rows = top.join(cells, [*on, "cell"])
    group = [*on, "stretch"]
    # by hash of the whole key, so a stretch is in one task; its rows come in the order in which they join
    dealt = rows.repartition(*group).sortWithinPartitions(*group, F.desc("n_bc"), "variant_list", "k")
    dealt = dealt.select(*group, "pos", "cell", "n_bc")

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, found = None, False
        heads: dict[int, list] = {}  # cell: first position, members, barcodes, place in the order of making
        for pdf in frames:
            done = []
            for sample, isoform, stretch, pos, cell, n_bc in zip(*[pdf[c] for c in ("sample", "isoform", "stretch", "pos", "cell", "n_bc")]):
                if (sample, isoform, stretch) != here:
                    here, found, heads = (sample, isoform, stretch), False, {}
                if found:
                    continue
                home = None
                for c in (cell - 1, cell, cell + 1):
                    head = heads.get(c)
                    if head is not None and abs(head[0] - pos) <= tol and (home is None or head[3] < home[3]):
                        home = head
                if home is None:
                    heads[cell] = [pos, 1, n_bc, len(heads)]
                    continue
                home[1] += 1
                home[2] += n_bc
                if home[1] == min_size and home[2] / min_size >= mean_bc:
                    found = True
                    done.append((sample, isoform))
            yield pd.DataFrame(done, columns=["sample", "isoform"]).astype(object)

    hits = dealt.mapInPandas(greedy, "sample string, isoform string").distinct().withColumn("_hit", F.lit(True))
    marked = top.select(*on).distinct().join(hits, on, "left")
    return marked.select(*on, is_true(F.col("_hit")).alias("clustered"))


def isoform_filter_code(
    per_variant: DataFrame,
    catalog: DataFrame,
    expected_junctions: list[int],
    canonical: list[str],
    min_top: int = 100,
    low: tuple[int, int] = (2, 2),
    tol: int = 10,
    min_size: int = 3,
    mean_bc: float = 3,
    first_only: bool = False,
) -> DataFrame:
    """Why an isoform is kept in a sample; the first rule that holds decides.

    0 quality class or weak, 1 canonical, 2 many barcodes for one variant, 3 the top variant lies at
    an unexpected junction, 4 clustered variants, 5 a variant listed twice.  ``catalog`` maps the
    isoform text to its ``blocks``.  Equal barcode counts are settled by variant text.
    """
    stats = isoform_variant_stats(per_variant)
    top = per_variant.groupBy("sample", "isoform").agg(F.min(F.struct((-F.col("n_bc")).alias("n"), "variant_list"))["variant_list"].alias("top_var"))
    single = per_variant.select("sample", "isoform", F.explode(F.split("variant_list", ",")).alias("v"))
    twice = (
        single.groupBy("sample", "isoform", "v")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("sample", "isoform")
        .agg((F.max("c") > 1).alias("twice"))
    )
    clustered = variant_position_cluster(per_variant, min_size, tol, mean_bc)
    on = ["sample", "isoform"]
    df = stats.join(top, on).join(twice, on).join(clustered, on, "left").join(catalog.select("isoform", "blocks"), "isoform", "left")
    ends = F.flatten(F.transform("blocks", lambda b: F.array(b["start"], b["end"])))
    odd = F.array_except(ends, F.array(*[F.lit(j) for j in expected_junctions]).cast("array<int>"))
    if first_only:
        odd = F.slice(F.array_sort(odd), F.lit(1), F.lit(1))
    places = F.transform(F.split("top_var", ","), lambda v: F.split(v, ":")[1].cast("int"))
    near = F.exists(places, lambda p: F.exists(odd, lambda j: F.abs(p - j) <= tol))
    code = (
        F.when(F.col("isoform").isin(*QC_WORDS), 0)
        .when(F.col("isoform").isin(*canonical), 1)
        .when(F.col("max_bc_per_var") >= min_top, 2)
        .when((F.col("max_bc_per_var") <= low[0]) & (F.col("max_reads_per_bc") <= low[1]), 0)
        .when(is_true(near), 3)
        .when(is_true(F.col("clustered")), 4)
        .when(F.col("twice"), 5)
        .otherwise(0)
    )
    return df.withColumn("filter", code).drop("blocks", "clustered", "twice")


def wt_isoform_stats(bc_iso: DataFrame, wt: DataFrame, canonical: list[str], min_top: int = 100, low: tuple[int, int] = (2, 2)) -> DataFrame:
    """The same over wild-type barcodes: 1 canonical, 2 many barcodes, 6 enough of both, else 0."""
    out = (
        bc_iso.join(wt.select("barcode").distinct(), "barcode", "left_semi")
        .groupBy("sample", "isoform")
        .agg(F.count(F.lit(1)).alias("num_bcs"), F.max("n").alias("max_reads_per_bc"))
    )
    code = (
        F.when(F.col("isoform").isin(*canonical), 1)
        .when(F.col("num_bcs") >= min_top, 2)
        .when((F.col("num_bcs") > low[0]) & (F.col("max_reads_per_bc") > low[1]), 6)
        .otherwise(0)
    )
    return out.withColumn("filter", code)


def isoform_qc_summary(stats: DataFrame) -> DataFrame:
    """Per sample: all reads, subassembly reads, reads per quality class, and their shares."""
    counts = {"total_reads": F.sum("read_count"), "sa_reads": F.coalesce(F.sum("sum_sa_reads"), F.lit(0))}
    for w in QC_WORDS:
        counts[f"total_{w}"] = F.coalesce(F.sum(F.when(F.col("isoform") == w, F.col("read_count"))), F.lit(0))
    out = stats.groupBy("sample").agg(*[v.alias(k) for k, v in counts.items()])
    return out.withColumns({f"per_{k}": ratio(k, "total_reads") for k in counts if k != "total_reads"})


def inspect_barcode_isoforms(reads: DataFrame, barcodes: DataFrame, suspicious: list[str]) -> tuple[DataFrame, DataFrame]:
    """Read counts of isoform by barcode for chosen barcodes, and the reads of suspicious isoforms."""
    chosen = reads.join(barcodes.select("barcode").distinct(), "barcode", "left_semi")
    counts = chosen.groupBy("isoform", "barcode").agg(F.count(F.lit(1)).alias("n"))
    return counts, chosen.filter(F.col("isoform").isin(*suspicious))


def read_barcodes_to_variants(
    pairs: DataFrame,
    catalog: DataFrame,
    names: list[str],
    sa: DataFrame,
    unmapped_names: DataFrame | None = None,
    max_len: int = 30,
    cutoff: float = 95,
    summary: tuple[str, ...] = ("usable_reads", "unmapped_reads", "bad_starts", "bad_ends", "soft_clipped", "other_isoform"),
) -> dict[str, DataFrame]:
    """From read pairs to variant effects, all samples in one plan.

    Counts per barcode, length filter, unmapped reads, usage, subassembly join, read cutoff by
    cumulative share and the variant summary above the cutoff of each sample.
    """
    from juncture.operators.statistics import rank_cutoff

    bc = barcode_isoform_counts(pairs, catalog, names, ["sample", "barcode"])
    bc = barcode_length_filter(bc, max_len)
    if unmapped_names is not None:
        bc = add_unmapped_barcodes(bc, unmapped_names)
    usage = psi(bc, names)
    cuts = rank_cutoff(bc, "usable_reads", [cutoff], ["sample"])
    marked = bc.join(cuts.select("sample", F.col("y").alias("_cut")), "sample")
    return {
        "barcodes": usage,
        "joined": join_subassembly_rna(sa, bc),
        "cutoffs": cuts,
        "variants": variant_summary_pe(sa, marked, F.col("_cut"), list(summary), names, ["sample"]),
    }
