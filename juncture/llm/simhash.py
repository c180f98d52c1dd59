"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its sixteen 4-bit segments. The Manhattan distance of two embeddings is at most
their Hamming distance, and every differing bit lies in one segment; so fingerprints that differ in two bits agree in
all but two segments. The segments are cut into ``parts``; for each choice of two parts the counts of all other
segments are the coordinates of a grid cell. Two linked fingerprints meet in a cell of at least one of these grids; there they are
compared by Manhattan distance and then bit by bit. The more fingerprints there are, the more parts a grid has.

A cell that holds more than ``CROWDED`` fingerprints isn't compared pairwise. Its fingerprints meet on the values one bit
away instead: two fingerprints differ in at most two bits exactly if some value is within one bit of both, and
no more than 65 fingerprints can share such a value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juncture.llm.common import scratch_table
from juncture.llm.components import components

SEED, WIDTH, DISTANCE = 42, 3, 2
SEGMENTS, SEGMENT_BITS = 16, 4
CROWDED = 64
#: Bytes of a text whose words are held at a time.
BLOCK = 1 << 20
#: Information in one segment's count of random bits.
BITS_A_SEGMENT = -sum(math.comb(4, i) / 16 * math.log2(math.comb(4, i) / 16) for i in range(5))


def word_runs(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """Words of about ``size`` bytes at a time, A-Z lower-cased; cuts fall on white space only."""
    space = re.compile(rb"[\x20\x09-\x0d]")
    start = 0
    while start < len(data):
        cut = space.search(data, start + size) if start + size < len(data) else None
        end = cut.start() if cut else len(data)
        # split() and lower() of bytes know just the six white-space bytes and A-Z
        yield data[start:end].lower().split()
        start = end


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; zero without words."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    hash_of = xxhash.xxh64_intdigest
    for words in word_runs((text or "").encode()):
        words = carried + words
        carried = words[-(width - 1) :]
        if len(words) < width:
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [hash_of(joined[s:e], SEED) for s, e in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]
        for i in range(0, len(hashes), 1 << 14):
            part = np.array(hashes[i : i + (1 << 14)], np.uint64)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    if not total and carried:
        total, value = 1, hash_of(b" ".join(carried), SEED)
        ones = np.unpackbits(np.array([value], np.uint64).view(np.uint8), bitorder="little").astype(np.int64)
    return int(np.packbits((2 * ones > total), bitorder="little").view(np.uint64)[0]) if total else 0


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """All rows and columns plus the fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())

    return docs.withColumn(out_col, of(F.col(text_col)))


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """(n, 16) bit counts of the 4-bit segments."""
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(SEGMENT_BITS)
    return np.bitwise_count((fps[:, None] >> shifts) & np.uint64(15))


def grids(n: int) -> list[list[int]]:
    """Segments whose counts make each grid's cells, so fine that few random fingerprints share one."""
    for parts in (4, 5, 6, 8, 16):
        if (1 - 2 / parts) * SEGMENTS * BITS_A_SEGMENT >= math.log2(max(2, n)) + 0.5:
            break
    part = [s * parts // SEGMENTS for s in range(SEGMENTS)]
    return [[s for s in range(SEGMENTS) if part[s] not in gone] for gone in combinations(range(parts), DISTANCE)]


def cell_rows(fps: DataFrame, chosen: list[list[int]]) -> DataFrame:
    """(cell, fp): one row per fingerprint and grid. Cells are numbers, base 5 below the grid's place, and so exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            counts = segment_counts(values.view(np.uint64)).astype(np.int64)
            for g, segments in enumerate(chosen):
                cell = counts[:, segments] @ (5 ** np.arange(len(segments), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cell * len(chosen) + g), pa.array(values)], ["cell", "fp"])

    return fps.mapInArrow(run, "cell long, fp long")


def compare_cells(rows: DataFrame) -> DataFrame:
    """Links (a, b) inside cells; rows of crowded cells come back as (fp, null)."""
    ordered = rows.repartition("cell").sortWithinPartitions("cell", "fp")

    def links(cells: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours one, two, ... places apart in the same cell, until no two are."""
        counts = segment_counts(fps).astype(np.int8)
        at, step, a, b = np.arange(len(fps)), 0, [], []
        while len(at):
            step += 1
            at = at[at + step < len(fps)]
            at = at[cells[at] == cells[at + step]]
            near = at[np.abs(counts[at] - counts[at + step]).sum(1) <= DISTANCE]
            near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= DISTANCE]
            a.append(fps[near])
            b.append(fps[near + step])
        return np.concatenate([*a, np.zeros(0, np.uint64)]), np.concatenate([*b, np.zeros(0, np.uint64)])

    def made(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        right = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), right], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            cells = np.concatenate([cells, batch.column("cell").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(cells):
                continue
            # the last cell may go on in the next batch
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            sizes = np.diff(np.append(starts, len(cells)))
            full = np.repeat((sizes > CROWDED) | (cells[starts] == crowded if crowded is not None else False), sizes)
            last = int(starts[-1])
            if full.any():
                yield made(fps[full], None)
            ready = ~full
            ready[last:] = False
            if ready.any():
                yield made(*links(cells[ready], fps[ready]))
            crowded = int(cells[-1]) if full[-1] else None
            keep = slice(len(cells), None) if full[-1] else slice(last, None)
            cells, fps = cells[keep], fps[keep]
        if len(cells):
            yield made(*links(cells, fps))

    return ordered.mapInArrow(run, "a long, b long")


def one_bit_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints that share a value within one bit of each, through the smallest that shares it."""
    near = F.explode(F.array(F.col("a"), *[F.col("a").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)]))
    shared = fps.select("a", near.alias("_value"))
    return shared.withColumn("b", F.min("a").over(Window.partitionBy("_value"))).filter("a <> b").select("a", "b")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``.

    component_id is the smallest identifier among the documents whose fingerprints are reached by steps of at most two
    differing bits. Texts without words have fingerprint zero and are linked like any other; so are null texts. Null identifiers
    are never the smallest. Rows repeated with one identifier each get a row. An empty table gives no rows.
    """
    rows, placed = rooted(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    answer = placed.join(least, "root").select("fp", "component_id")
    return rows.join(answer, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (_id, _text and others) with fp in place of the text, and (fp, _least, root): least identifier and component of each fingerprint."""
    rows = scratch_table(with_fingerprints(docs, "_text").drop("_text"), "fingerprints")
    per_fp = scratch_table(rows.groupBy("fp").agg(F.min("_id").alias("_least")), "distinct-fingerprints")
    found = scratch_table(compare_cells(cell_rows(per_fp.select("fp"), grids(per_fp.count()))), "cell-links")
    crowded = found.filter(F.col("b").isNull()).select("a").distinct()
    roots = components(found.filter(F.col("b").isNotNull()).union(one_bit_links(crowded)))
    return rows, per_fp.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest identifier, a null one if there is no other (of rows repeated with it, the first by text).

    Rows find their component by identifier and SHA-256 of the text, so neither null nor repeated identifiers mix components.
    """
    digest = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    rows, placed = rooted(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), digest.alias("_digest")))
    least = placed.groupBy("root").agg(F.min("_least").alias("_keep"))
    keepers = rows.join(placed.join(least, "root").select("fp", "root", "_keep"), "fp").filter(F.col("_id").eqNullSafe(F.col("_keep")))
    keepers = keepers.select(F.col("_id").alias("_keep_id"), F.col("_digest").alias("_keep_digest"), F.col("root").alias("_keep_root")).distinct()
    found = docs.join(keepers, F.col(id_col).eqNullSafe(F.col("_keep_id")) & digest.eqNullSafe(F.col("_keep_digest")))
    # in a struct a null text counts, as the first
    first = F.min_by(F.struct(*docs.columns), F.struct(text_col))
    return found.groupBy("_keep_root").agg(first.alias("_row")).select("_row.*")
