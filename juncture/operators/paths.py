"""Paths through exons: counted by a dynamic program, then drawn up by rank.

An exon leads to every exon that starts after its end. For each exon the number of paths from it to a last exon is the sum over
the exons it leads to, and these numbers find the path of any rank without the ones before it. So ranks are
dealt out in blocks, the paths of one gene are drawn up by many tasks, and neither depth nor number has a limit set by a
recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths drawn up from one row; rows made from one row in each of two steps.
BLOCK, FAN = 4096, 4096

Exon = tuple[int, int, int]


class PathGraph:
    """Exons (number, start, end) in order, where paths may begin and end, and how many lead on from each."""

    def __init__(self, exons: list[Exon], first: set[int], last: set[int]):
        self.exons, self.last = exons, last
        self.first = sorted(first)
        self.follow = [[j for j, f in enumerate(exons) if f[1] > e[2]] for e in exons]
        self.counts = [0] * len(exons)
        # an exon starts before all that follow it
        for i in sorted(range(len(exons)), key=lambda i: exons[i][1], reverse=True):
            self.counts[i] = (i in last) + sum(self.counts[j] for j in self.follow[i])

    @property
    def total(self) -> int:
        return sum(self.counts[i] for i in self.first)

    def paths(self, rank: int, number: int) -> Iterator[list[Exon]]:
        """Up to ``number`` paths from ``rank`` on, in the order of their exons; whole branches before the rank are stepped over."""
        stack, path = [iter(self.first)], []
        while stack and number:
            i = next(stack[-1], None)
            if i is None:
                stack.pop()
                del path[-1:]
            elif rank >= self.counts[i]:
                rank -= self.counts[i]
            else:
                path.append(self.exons[i])
                stack.append(iter(self.follow[i]))
                if i in self.last and rank:
                    rank -= 1
                elif i in self.last:
                    number -= 1
                    yield list(path)


def whole_paths(exons: list[Exon], _: int | None) -> PathGraph:
    """From the start of the exon of lowest number to the end of the one of highest number."""
    exons = sorted(exons)
    start, end = exons[0][1], exons[-1][2]
    return PathGraph(exons, {i for i, e in enumerate(exons) if e[1] == start}, {i for i, e in enumerate(exons) if e[2] == end})


def read_paths(exons: list[Exon], read_start: int | None) -> PathGraph:
    """From a read start inside the last exon that begins at or before it, to the last exon end; two nodes are no path."""
    exons = sorted({(0, s, e) for _, s, e in exons})
    end = max(e for _, _, e in exons)
    before = [e for e in exons if read_start is not None and e[1] <= read_start]
    entry = max(before, key=lambda e: (e[1], e[2]))[2] if before else None
    own = [e for e in exons if e[1] > entry] if entry is not None and entry > read_start else []
    # a path of one exon would have two nodes, so the entry is no last exon
    nodes = [(0, read_start, entry), *own] if own else []
    return PathGraph(nodes, {0} if own else set(), {i for i, e in enumerate(nodes) if i and e[2] == end})


def enumerate_paths(models: DataFrame, whole: bool, ranks: DataFrame | None = None) -> DataFrame:
    """(gene, rank, path) of ``models`` (gene, exons, read_start), one row per gene; ``path`` is an array of (start, end).

    ``ranks`` (gene, first, number) asks for some of the paths; without it all are listed, which stops for a gene whose
    number of paths passes a long.
    """
    # functions for tasks carry what they need
    build, block = whole_paths if whole else read_paths, BLOCK

    def exons_of(row) -> list[Exon]:
        return [(e["exon_num"] or 0, e["start_pos"], e["end_pos"]) for e in row["exons"]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [build(exons_of(r), r["read_start"]).total for r in batch.to_pylist()]
            for gene, n in zip(batch.column("gene").to_pylist(), totals):
                if n >= 1 << 63:
                    raise ValueError(f"gene {gene} has {n} paths; ask for ranks")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals, pa.int64())], [*batch.schema.names, "total"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = list(build(exons_of(r), r["read_start"]).paths(r["first"], r["number"]))
                path = pa.array([[{"start": e[1], "end": e[2]} for e in p] for p in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array([r["gene"]] * len(found), pa.string()), pa.array(range(r["first"], r["first"] + len(found)), pa.int64()), path], ["gene", "rank", "path"])

    own = "gene string, exons array<struct<exon_num:int,start_pos:int,end_pos:int>>, read_start int"
    if ranks is None:
        counted = models.mapInArrow(count, f"{own}, total long").filter(F.col("total") > 0)
        far = F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(block * FAN).cast("long"))
        blocks = counted.withColumn("_far", F.explode(far))
        end = F.least(F.col("_far") + block * FAN, F.col("total"))
        blocks = blocks.withColumn("first", F.explode(F.sequence(F.col("_far"), end - 1, F.lit(block).cast("long"))))
        blocks = blocks.withColumn("number", F.least(F.lit(block).cast("long"), F.col("total") - F.col("first")))
    else:
        blocks = models.join(ranks.select("gene", F.col("first").cast("long"), F.col("number").cast("long")), "gene")
    blocks = blocks.select("gene", "exons", "read_start", "first", "number")
    # a fixed number of tasks: the rows are small, what is made of them is not
    spread = blocks.repartition(4 * models.sparkSession.sparkContext.defaultParallelism, "gene", "first")
    return spread.mapInArrow(draw, "gene string, rank long, path array<struct<start:int,end:int>>")


def gene_models(exons: DataFrame, gene: str) -> DataFrame:
    """Exons of each gene in one row; as many as the gene model has."""
    exon = F.struct(F.col("exon_num").cast("int").alias("exon_num"), F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"))
    return exons.groupBy(F.col(gene).cast("string").alias("gene")).agg(F.collect_list(exon).alias("exons"))
