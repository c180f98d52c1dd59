"""Exact top-k search by block-at-a-time pruning.

Vectors become integers and are cut, in order of their numbers, into document-range blocks. A block keeps the least and largest
value of each term (component) and its vectors as a forward index. The sum over terms of the larger of ``q * least`` and
``q * largest`` bounds every score of the block, so each query has an order of blocks.

Queries travel in blocks too. In each round a query reads the next blocks of its own order, twice as many as in the round before, and
only while their bounds reach its k-th score, which every round renews. What still reaches it after ``ROUNDS`` rounds is read in
a last one. Bounds of ``GROUP`` neighbouring blocks together come first, so most blocks are not even bounded. A pruned block is
neither moved nor read, and no table of all queries and blocks is written. Results are exact whatever is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juncture.llm.common import scratch_table

#: Vectors of a block, queries of a query block, blocks of a group, groups of a part of the index, and blocks a task cuts at least.
BLOCK, QUERY_BLOCK, GROUP, PART, TASK = 1024, 512, 64, 64, 16
#: Blocks that each query reads in the first round, and rounds that double them.
FIRST, ROUNDS = 2, 5
SCALE = 256
#: More than the rows of a block; a task cuts fewer than 2**24 blocks, so numbers of rows fit a long.
ROW_BASE = 1 << 20
FOUND = "query_block long, place long, query_id long, vec_id long, row long, score long"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vector) of the rows with a number and a vector of finite components only."""
    component = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.transform(vector_col, lambda x: x.cast("double"))
    found = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    return found.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", component)).select("id", F.size("vector").alias("dim"), "vector")


def cut_blocks(rows: DataFrame, size: int, tasks: int, once: bool = False) -> DataFrame:
    """Blocks (block, dim, n, low, high, ids, values) of at most ``size`` rows of one dimension, in order of their numbers.

    At most ``tasks`` tasks, so that most blocks are full, read their sorted parts of the numbers as a stream and hold one block, however often a number is repeated. With
    ``once`` rows equal in number and vector count once. Values are floor(256 x) as 64-bit floats, exact below 2**53.
    """
    # numbers of a part and the parts' order make the ranges
    ordered = rows.repartitionByRange("dim", "id").sortWithinPartitions("dim", "id", "vector").coalesce(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seq = TaskContext.get().partitionId() << 24, 0
        ids, values, dim, last = [], [], None, None

        def block():
            nonlocal seq
            seq += 1
            n = np.array(ids, np.int64)
            v = np.floor(np.array(values, np.float64).reshape(len(ids), dim) * SCALE)
            low, high = (v.min(0), v.max(0)) if dim else (np.zeros(0), np.zeros(0))
            cells = [first + seq, dim, len(ids), low.tobytes(), high.tobytes(), n.tobytes(), v.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, types)], names)

        for batch in batches:
            for i, d, v in zip(*(batch.column(c).to_pylist() for c in ("id", "dim", "vector"))):
                if once and (i, v) == last:
                    continue
                last = (i, v)
                if ids and (d != dim or len(ids) == size):
                    yield block()
                    ids, values = [], []
                dim = d
                ids.append(i)
                values.append(v)
        if ids:
            yield block()

    names = ["block", "dim", "n", "low", "high", "ids", "values"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return ordered.mapInArrow(run, "block long, dim int, n int, low binary, high binary, ids binary, values binary")


def floats(data: bytes, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; of vectors without components there are as many as the caller says."""
    return np.frombuffer(data, np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))


def bound_of(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, blocks): what no score of a block passes. The same numbers give the same bound, whatever stands beside them."""
    bound = np.einsum("qd,bd->qb", np.maximum(q, 0), high) + np.einsum("qd,bd->qb", np.minimum(q, 0), low)
    # room for the rounding of sums beyond 2**53
    return bound + np.abs(bound) * 1e-12


def cut_groups(index: DataFrame) -> DataFrame:
    """(group, dim, blocks, low, high): the terms of up to ``GROUP`` neighbouring blocks."""
    held = F.array_sort(F.collect_list(F.struct("block", "low", "high")))
    return index.groupBy("dim", F.floor(F.col("block") / GROUP).alias("group")).agg(held.alias("blocks"))


def reaching(pairs: DataFrame, most: int | None) -> DataFrame:
    """(query_block, block, places, bounds): the blocks that come next for queries of a block, the best ``most`` of those that a task sees.

    A row of ``pairs`` has a query block with the state of its queries and a group of blocks. A block counts for a query if it comes
    after the last one it has read, in falling order of bounds, and its bound reaches the query's k-th score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def best() -> tuple[np.ndarray, ...]:
            place, block, bound = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((block, -bound, place))
            place, block, bound = place[order], block[order], bound[order]
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            nth = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
            return place[nth < most], block[nth < most], bound[nth < most]

        def out(query_block: int, place: np.ndarray, block: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(block, kind="stable")
            place, block, bound = place[order], block[order], bound[order]
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = pa.array(np.append(first, len(block)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((place, pa.int32()), (bound, pa.float64()))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), query_block), pa.int64()), pa.array(block[first], pa.int64()), *lists], ["query_block", "block", "places", "bounds"])

        for batch in batches:
            cells = (batch.column(c).to_pylist() for c in ("query_block", "dim", "n", "values", "least", "after", "after_block", "blocks"))
            for query_block, dim, n, values, least, after, after_block, blocks in zip(*cells):
                if query_block != current:
                    if held:
                        yield out(current, *best())
                    current, held = query_block, []
                least, after, after_block = np.frombuffer(least, np.float64), np.frombuffer(after, np.float64), np.frombuffer(after_block, np.int64)
                numbers = np.array([x["block"] for x in blocks], np.int64)
                low, high = (np.array([np.frombuffer(x[c], np.float64) for x in blocks]).reshape(len(blocks), dim) for c in ("low", "high"))
                q = floats(values, dim) if dim else np.zeros((n, 0))
                some = np.flatnonzero(bound_of(q, low.min(0, keepdims=True), high.max(0, keepdims=True))[:, 0] >= least)
                bound = bound_of(q[some], low, high)
                last = after[some][:, None]
                row, col = np.nonzero((bound >= least[some][:, None]) & ((bound < last) | ((bound == last) & (numbers > after_block[some][:, None]))))
                if not len(row):
                    continue
                found = some[row], numbers[col], bound[row, col]
                if most is None:
                    yield out(query_block, *found)
                    continue
                held.append(found)
                held = [best()]
        if held:
            yield out(current, *best())

    return pairs.mapInArrow(run, "query_block long, block long, places array<int>, bounds array<double>")


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 2**53 in whole numbers of any size, held to the range of a long."""
    most = (np.abs(q).max(initial=0) * np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(v).T, -(2**63), 2**63 - 1).astype(np.int64)


def score_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(query_block, place, query_id, vec_id, row, score): up to ``k`` best of a block for each query that asks for it.

    A row of ``pairs`` has a query block (ids, values and k-th scores so far), a block (ids and values) and the places of the queries
    that ask. ``row`` numbers the rows of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (batch.column(c).to_pylist() for c in ("query_block", "block", "dim", "query_ids", "query_values", "ids", "values", "least", "places"))
            for query_block, block, dim, query_ids, query_values, ids, values, least, places in zip(*cells):
                query_ids, ids, floor = np.frombuffer(query_ids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(least, np.float64)
                asked = np.array(sorted(places), np.int64)
                if dim:
                    scores = inner_products(floats(query_values, dim)[asked], floats(values, dim))
                else:
                    scores = np.zeros((len(asked), len(ids)), np.int64)
                found = []
                for row, at in zip(scores, asked):
                    other = np.flatnonzero((ids != query_ids[at]) & (row >= floor[at]))
                    if len(other) > k:
                        # all that reach the k-th best score, then ties by number
                        kth = np.partition(row[other], len(other) - k)[len(other) - k]
                        other = other[row[other] >= kth]
                    best = other[np.lexsort((ids[other], -row[other]))[:k]]
                    here = np.full(len(best), 1)
                    found.append((here * query_block, here * at, here * query_ids[at], ids[best], block * ROW_BASE + best, row[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], ["query_block", "place", "query_id", "vec_id", "row", "score"])

    return pairs.mapInArrow(run, FOUND)


def with_state(asked: DataFrame, best: DataFrame | None, read: DataFrame | None, k: int) -> DataFrame:
    """``asked`` with, by the places of its queries, the k-th score so far and the bound and number of the last block that was read."""
    if best is None:
        known = asked.select("query_block", "n", F.lit(None).cast("array<struct<place:int,least:double,after:double,after_block:long>>").alias("_known"))
    else:
        none = F.lit(None).cast("double")
        kth = best.filter(F.col("_nth") == k).select("query_block", F.col("place").cast("int").alias("place"), F.col("score").cast("double").alias("least"), none.alias("after"), none.cast("long").alias("after_block"))
        last = read.groupBy("query_block", "place").agg(F.min(F.struct("bound", (-F.col("block")).alias("back"))).alias("_last"))
        last = last.select("query_block", "place", none.alias("least"), F.col("_last.bound").alias("after"), (-F.col("_last.back")).alias("after_block"))
        # at most two entries for each of QUERY_BLOCK queries
        lists = kth.union(last).groupBy("query_block").agg(F.collect_list(F.struct("place", "least", "after", "after_block")).alias("_known"))
        known = asked.select("query_block", "n").join(lists, "query_block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, entries in zip(batch.column("n").to_pylist(), batch.column("_known").to_pylist()):
                least, after, after_block = np.full(n, -np.inf), np.full(n, np.inf), np.full(n, -1, np.int64)
                for x in entries or []:
                    if x["least"] is not None:
                        least[x["place"]] = x["least"]
                    else:
                        after[x["place"]], after_block[x["place"]] = x["after"], x["after_block"]
                out.append((least.tobytes(), after.tobytes(), after_block.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("query_block"), *(pa.array([x[i] for x in out], pa.binary()) for i in range(3))], ["query_block", "least", "after", "after_block"])

    return asked.join(known.mapInArrow(run, "query_block long, least binary, after binary, after_block binary"), "query_block")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row whose number ``every`` divides.

    The score is the inner product of the vectors' floor(256 x); equal scores go to the smaller number. Rows whose number or
    vector is null, or whose vector holds a null or a number that isn't finite, take no part. A query's candidates are the rows of
    other numbers and of its dimension; repeated rows count each. A number that several vectors share asks as a query with each of
    them, and a candidate counts with the best of these scores. No rows give no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    tasks = lambda n, size: 1 + n // (size * TASK)
    n = vectors.count()
    index = scratch_table(cut_blocks(rows, block, tasks(n, block)), "blocks")
    asked = scratch_table(cut_blocks(rows.filter(F.pmod("id", F.lit(every)) == 0), query_block, tasks(n // every, query_block), once=True), "query-blocks")
    asked = asked.select(F.col("block").alias("query_block"), "dim", "n", F.col("ids").alias("query_ids"), "values")
    groups = cut_groups(index)
    blocks = index.count()
    parts = 1 + blocks // (GROUP * PART)
    groups = scratch_table(groups.withColumn("_part", F.pmod(F.xxhash64("group"), F.lit(parts))), "block-groups")
    dealt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))

    best, read = None, None
    for number in range(ROUNDS + 1):
        if FIRST * ((1 << number) - 1) >= blocks and number:
            # the rounds before have offered every block
            break
        most = FIRST << number if number < ROUNDS else None
        state = scratch_table(with_state(asked, best, read, k), "query-state")
        pairs = state.withColumn("_part", dealt).join(groups, ["dim", "_part"])
        # a query block meets the groups of a part in one task
        pairs = pairs.repartition("query_block", "_part").sortWithinPartitions("_part", "query_block")
        found = reaching(pairs, most)
        if most is not None:
            each = found.select("query_block", "block", F.explode(F.arrays_zip("places", "bounds")).alias("_x"))
            each = each.select("query_block", "block", F.col("_x.places").alias("place"), F.col("_x.bounds").alias("bound"))
            in_order = Window.partitionBy("query_block", "place").orderBy(F.desc("bound"), "block")
            wanted = scratch_table(each.withColumn("_nth", F.row_number().over(in_order)).filter(F.col("_nth") <= most).drop("_nth"), "next-blocks")
            if wanted.isEmpty():
                break
            # a query that is done has no row in later rounds, and its place in the order stays
            read = wanted if read is None else read.union(wanted)
            found = wanted.groupBy("query_block", "block").agg(F.collect_list("place").alias("places"))
        new = scored(found.select("query_block", "block", "places"), state, index, k)
        every_one = new if best is None else best.drop("_nth").union(new)
        nth = Window.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id")
        best = scratch_table(every_one.withColumn("_nth", F.row_number().over(nth)).filter(F.col("_nth") <= k), "best-scores")

    if best is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a number that several vectors share has a candidate once
    once = best.groupBy("query_id", "row").agg(F.max("score").alias("score"), F.first("vec_id").alias("vec_id"))
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scored(wanted: DataFrame, state: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``score_pairs`` of the blocks that queries ask for: each block's vectors are moved once for each query block that wants them."""
    queries = state.select("query_block", "query_ids", F.col("values").alias("query_values"), "least")
    return score_pairs(wanted.join(queries, "query_block").join(index.select("block", "dim", "ids", "values"), "block"), k)
