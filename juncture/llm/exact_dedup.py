"""Exact dedup by content sort.

Sampled splitters cut the sort order of the normalised texts into ranges, a digest cuts each range into
blocks of about ``BLOCK_ROWS`` rows, Spark's external sort puts equal texts of a block next to each
other, and each row is compared in full with its neighbour.

A text so common that it fills whole ranges of the sample is dealt over several blocks by its identifier; the
few runs of such texts (one per text and block) are then joined up by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juncture.llm.common import ascii_lower

#: Ranges of the sort order; sampled rows for each splitter; characters of the text in a splitter.
RANGES, SAMPLE_PER_RANGE, HEAD = 64, 64, 32
#: Rows of a block: far below what a window buffers before it spills, and so few that tasks get many blocks each.
BLOCK_ROWS = 128


def _range_of(key: Column, splitters: list[str], low: int, high: int) -> Column:
    """Binary search over literals: the number of splitters at or below the key."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < F.lit(splitters[mid]), _range_of(key, splitters, low, mid)).otherwise(_range_of(key, splitters, mid + 1, high))


def find_splitters(keys: DataFrame, rows: int) -> tuple[list[str], list[str]]:
    """Sampled quantiles of the sort key, and the keys of texts that would fill several blocks or ranges.

    ``keys`` has ``_key`` (first characters and digest) and ``_row`` (a hash that picks the sample). At most about
    ``RANGES * SAMPLE_PER_RANGE`` short keys come to the driver, whatever the input is. The sample only
    decides where rows go, never what is equal.
    """
    share = min(1.0, RANGES * SAMPLE_PER_RANGE / max(1, rows))
    picked = keys.filter(F.pmod("_row", F.lit(1 << 30)) < int(share * (1 << 30))).select("_key").limit(4 * RANGES * SAMPLE_PER_RANGE)
    found = sorted(r[0] for r in picked.collect())
    cuts = [found[i * len(found) // RANGES] for i in range(1, RANGES)] if found else []
    counts: dict[str, int] = {}
    for key in found:
        counts[key] = counts.get(key, 0) + 1
    common = [k for k, n in counts.items() if n >= 8 and (n * RANGES >= len(found) or n * rows > 4 * BLOCK_ROWS * len(found))]
    return sorted(set(cuts)), sorted(common)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """All rows and columns of ``docs`` plus text_sha256, keep_id, group_size and kept.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. Of equal texts the
    row with the largest (``keep="smallest"``: smallest) identifier stays; null identifiers lose to all others, and
    of rows repeated with one identifier one stays. An empty table gives no rows. Columns of the input with
    the names of the results are replaced.
    """
    made = ["text_sha256", "keep_id", "group_size", "kept"]
    docs = docs.drop(*[c for c in made if c not in (id_col, text_col)])
    own = docs.columns
    norm = ascii_lower(F.col(text_col))
    key = F.concat(F.substring(F.col("_norm"), 1, HEAD), F.lit("\u0000"), F.col("text_sha256"))
    keyed = docs.select("*", norm.alias("_norm")).withColumn("text_sha256", F.sha2("_norm", 256)).withColumn("_key", key)
    keyed = keyed.withColumn("_row", F.xxhash64(F.col(id_col), F.lit(7)))
    rows = docs.count()
    splitters, common = find_splitters(keyed.select("_key", "_row"), rows)
    subs = max(1, rows // (BLOCK_ROWS * (len(splitters) + 1)))
    salts = max(1, rows // BLOCK_ROWS)
    hot = F.col("_key").isin(common)
    placed = keyed.select(
        *own,
        "text_sha256",
        _range_of(F.col("_key"), splitters, 0, len(splitters)).alias("_range"),
        F.pmod(F.xxhash64("text_sha256"), F.lit(subs)).alias("_sub"),
        *([F.when(hot, 1 + F.pmod(F.col("_row"), F.lit(salts))).otherwise(0).alias("_salt")] if common else []),
    )
    # a constant salt would make the windows ask for another partitioning than this one
    block = ["_range", "_sub", *(["_salt"] if common else [])]
    ident = F.col(id_col)
    first = ident.desc_nulls_last() if keep == "largest" else ident.asc_nulls_last()
    best = F.max(ident) if keep == "largest" else F.min(ident)
    # the external sort of each block, and full comparison with the row before
    # (the text is normalised again here rather than carried through the shuffle a second time)
    in_order = Window.partitionBy(*block).orderBy("_norm", first)
    seen = placed.repartition(*block).withColumn("_norm", norm).withColumn("_new", (F.lag("_norm").over(in_order) != F.col("_norm")) | F.lag("_norm").over(in_order).isNull())
    runs = seen.withColumn("_run", F.sum(F.col("_new").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("_norm")
    run = Window.partitionBy(*block, "_run")
    local = runs.withColumn("keep_id", best.over(run)).withColumn("group_size", F.count(F.lit(1)).over(run))
    local = local.withColumn("kept", F.col("_new"))
    out = [*own, "text_sha256", "keep_id", "group_size", "kept"]
    if not common:
        return local.select(*out)
    # runs of a common text, one for each block that it was dealt to, joined up
    digests = [k.rsplit("\u0000", 1)[1] for k in common]
    parts = keyed.filter(F.col("_key").isin(common)).groupBy("text_sha256", F.pmod(F.col("_row"), F.lit(salts)).alias("_part"))
    whole = parts.agg(best.alias("_best"), F.count(F.lit(1)).alias("_n")).groupBy("text_sha256").agg((F.max("_best") if keep == "largest" else F.min("_best")).alias("_best"), F.sum("_n").alias("_n"))
    # at most one row for each literal in `common`, so this broadcast has a bound
    joined = local.join(F.broadcast(whole.filter(F.col("text_sha256").isin(digests))), "text_sha256", "left")
    split = F.col("_n").isNotNull()
    return joined.select(
        *own,
        "text_sha256",
        F.when(split, F.col("_best")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(split, F.col("_n")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("kept") & (~split | F.col("keep_id").eqNullSafe(F.col("_best")))).alias("kept"),
    )
