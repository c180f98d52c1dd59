"""Mixing sources to target weights by systematic sampling.

Within a source each document expects ``target / source_size`` copies. Documents lie in a fixed order, the expected
copies are summed along it, one random offset per source is added, and a document is emitted once for each
integer its stretch of the sum crosses. The order runs from large to small texts, so that neighbours weigh about
the same and the words taken stay near the target.

The prefix sum has two levels: rows are ranked inside small blocks (source, size class, part of a hash),
and the blocks' row counts, a table of about a thousandth of the rows, are summed over each source. A hot source
therefore spreads over all its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juncture.llm.common import WORD, at_least_pow2, materialise

#: Weights of the sources in code-point order, repeating; the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Rows of the whole input for each part of the hash, and the fewest parts.
ROWS_PER_PART, LEAST_PARTS = 1 << 20, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eighths of an octave: the bit length and the three bits after the first."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 8 + F.expr("shiftright(_size, length(bin(_size)) - 4)") - 8).cast("int")


def hash_part(key: Column, modulus: Column | int) -> Column:
    """Eight hexadecimal digits of the key's MD5 as a number, modulo ``modulus``."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % modulus


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source from ``(_source, source_size)``, one row a source.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes; none gets more than
    ``most`` times its own size. Sharing the excess by weight until nobody is above is filling water to one level:
    the sources with the least ``size / weight`` are full, all others get ``level * weight``.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    fullest = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("_i"))
    before, everything = fullest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_i", F.row_number().over(by_name) - 1).withColumn("_weight", weight.cast("long"))
    left_size = F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    left_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    stepped = ranked.withColumn("_rank", F.row_number().over(fullest)).withColumn("_level", left_size / left_weight)
    # the first source that is not full sets the level of itself and of all after it
    not_full = F.when(F.col("_level") * F.col("_weight") < most * F.col("source_size"), F.struct("_rank", "_level"))
    stepped = stepped.withColumn("_first", F.min(not_full).over(everything))
    full = F.col("_first").isNull() | (F.col("_rank") < F.col("_first")["_rank"])
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.col("_first")["_level"] * F.col("_weight"))
    return stepped.select("_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` plus size, source_size, target, copies and taken (``copies * size``).

    A null or blank text has size 0, a null source is a source of its own. Rows repeated with one identifier are
    documents of their own; where they also agree in size they are interchangeable. Reruns agree, as all
    draws come from hashes of the identifier and the source. An empty table gives no rows. Columns of the
    input with the names of the results are replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*[c for c in made if c not in (id_col, text_col, source_col)])
    own = docs.columns
    parts = max(LEAST_PARTS, at_least_pow2(-(-docs.count() // ROWS_PER_PART)))
    rows = docs.withColumn("_size", word_count(F.col(text_col))).withColumn("_class", size_class(F.col("_size")))
    rows = rows.withColumn("_part", hash_part(F.col(id_col), parts)).withColumn("_named", F.col(source_col).isNotNull())
    rows = rows.withColumn("_name", F.coalesce(F.col(source_col), F.lit("")))
    block = ["_named", "_name", "_class", "_part"]
    blocks = materialise(rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_words")))

    per_source = blocks.groupBy("_named", "_name").agg(F.sum("_words").alias("source_size"))
    aimed = targets(per_source.withColumn("_source", F.when(F.col("_named"), F.col("_name"))).drop("_named", "_name"), weights, most)
    aimed = aimed.select(F.col("_source").isNotNull().alias("_named"), F.coalesce("_source", F.lit("")).alias("_name"), "source_size", "target")
    along = Window.partitionBy("_named", "_name").orderBy(F.desc("_class"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(along), F.lit(0))).drop("_rows", "_words").join(aimed, ["_named", "_name"])

    # blocks and rows meet on the key by which the rows are then ranked: one shuffle
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*block).orderBy(F.desc("_size"), id_col))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hash_part(F.concat(F.lit(seed), F.col("_named").cast("string"), F.col("_name")), 1 << 16) / F.lit(float(1 << 16))
    ranked = rows.join(placed, block).withColumn("_at", at).withColumn("_rate", rate).withColumn("_u", offset)
    copies = F.floor(F.col("_at") * F.col("_rate") + F.col("_u")) - F.floor((F.col("_at") - 1) * F.col("_rate") + F.col("_u"))
    out = ranked.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("_size"))
    return out.select(*own, F.col("_size").alias("size"), "source_size", "target", "copies", "taken")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it was taken."""
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.filter(F.col("copies") > 0).select("*", times.alias("_copy")).drop("_copy")
