"""Expressions over variant text ``chrom:pos:ref:alt``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import as_col


def variant_fields(text: Column | str) -> dict[str, Column]:
    """The four fields of one variant as columns."""
    parts = F.split(as_col(text), ":")
    return {
        "chrom": F.get(parts, F.lit(0)),
        "pos": F.get(parts, F.lit(1)).cast("int"),
        "ref": F.get(parts, F.lit(2)),
        "alt": F.get(parts, F.lit(3)),
    }


def parse_variant(df: DataFrame, col: str = "variant_list") -> DataFrame:
    """One row per variant of a comma-joined list, with its four fields."""
    one = df.withColumn("_v", F.explode(F.split(F.col(col), ",")))
    return one.withColumns(variant_fields("_v")).drop("_v")


def is_snv(ref: Column | str = "ref", alt: Column | str = "alt") -> Column:
    return (F.length(as_col(ref)) == 1) & (F.length(as_col(alt)) == 1)
