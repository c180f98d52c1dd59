"""Connected components of a graph given as links between integers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import scratch_table

#: Links that one task thins to a forest.
LINKS_PER_TASK = 200_000


def thinned(links: DataFrame, parts: int) -> DataFrame:
    """Links (node, other) of the same components: in each part, every node to the smallest one it reaches there.

    A task holds the nodes of its part, at most two per link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "other"])

    return links.repartition(parts).mapInArrow(run, "node long, other long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: root is the smallest node that can be reached.

    Links are thinned in parts of bounded size. Then each round gives a node the smallest label among its neighbours' and the
    label of that label, until no label changes. Both steps join against one row per node and reduce with a
    partial aggregate, so a hub's links may be split over tasks; labels are written to the shared folder after each round.
    """
    pairs = scratch_table(links.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("other")), "links")
    few = thinned(pairs, 1 + pairs.count() // LINKS_PER_TASK)
    both = scratch_table(few.union(few.select("other", "node")).distinct(), "forest")
    labels = scratch_table(both.groupBy("node").agg(F.min("other").alias("root")), "labels")
    while True:
        # a node is among its own neighbours, or has a smaller one
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("_near"))
        jump = labels.select(F.col("node").alias("_near"), F.col("root").alias("_next"))
        found = labels.withColumnRenamed("root", "_old").join(near, "node").join(jump, "_near", "left")
        found = scratch_table(found.select("node", "_old", F.least("_old", "_near", F.coalesce("_next", "_near")).alias("root")), "labels")
        labels = found.select("node", "root")
        if found.filter("root <> _old").isEmpty():
            return labels
