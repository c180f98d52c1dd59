"""Packed annotation fields of variant files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import ratio

SITE_FIELDS = ["accept_GAIN", "accept_LOSS", "donor_GAIN", "donor_LOSS"]


def first_largest(names: list[str], label=lambda n: n) -> Column:
    """Name of the first column that attains the largest value."""
    top = F.greatest(*names)
    return reduce(lambda rest, n: F.when(F.col(n) == top, F.lit(label(n))).otherwise(rest), reversed(names), F.lit(None))


def parse_spliceai_info(vcf: DataFrame, info: str = "info") -> DataFrame:
    """Four delta scores and their positions, with the largest, its type and its position."""
    f = F.split(F.col(info), r"\|")
    score = {f"DS_{n}": F.get(f, F.lit(i + 2)).cast("double") for i, n in enumerate(SITE_FIELDS)}
    place = {f"POS_{n}": F.get(f, F.lit(i + 6)).cast("int") for i, n in enumerate(SITE_FIELDS)}
    df = vcf.withColumns({**score, **place})
    names = list(score)
    kind = first_largest(names)
    pos = reduce(lambda rest, n: F.when(F.col("DS_max_type") == f"DS_{n}", F.col(f"POS_{n}")).otherwise(rest), SITE_FIELDS, F.lit(None))
    return df.withColumns({"DS_max": F.greatest(*names), "DS_max_type": kind}).withColumn("POS_max", pos)


def parse_gnomad_info(vcf: DataFrame, info: str = "info") -> DataFrame:
    m = F.str_to_map(F.col(info), F.lit(";"), F.lit("="))
    df = vcf.withColumns({n: F.try_element_at(m, F.lit(k)).cast("long") for n, k in (("n_alt", "AC"), ("n_allele", "AN"), ("n_homo", "nhomalt"))})
    return df.withColumn("af", ratio("n_alt", "n_allele"))


CLASS_FIELDS = ["scap_raw", "scap_sens", "scap_raw_dom", "scap_sens_dom", "scap_raw_rec", "scap_sens_rec"]


def parse_scap_info(vcf: DataFrame, info: str = "info", replace_common: float | None = None) -> DataFrame:
    """One row per alternate allele with its class and scores; a dot is missing."""
    alts = F.split("alt", ",")
    rows = vcf.withColumn("_infos", F.split(F.col(info), ",")).select(
        *[c for c in vcf.columns if c not in ("alt", info)], "_infos", F.posexplode(alts).alias("_i", "alt")
    )
    f = F.split(F.get("_infos", F.col("_i")), ":")

    def number(i: int) -> Column:
        text = F.get(f, F.lit(i))
        return F.when(text == "COMMON", F.lit(replace_common).cast("double")).otherwise(text.try_cast("double"))

    df = rows.withColumns({"scap_type": F.get(f, F.lit(1)), **{n: number(i + 2) for i, n in enumerate(CLASS_FIELDS)}})
    raw, sens = [n for n in CLASS_FIELDS if "raw" in n], [n for n in CLASS_FIELDS if "sens" in n]
    return df.withColumns({"scap_raw_max": F.greatest(*raw), "scap_sens_min": F.least(*sens)}).drop("_infos", "_i")


def parse_pangolin_info(vcf: DataFrame, info: str = "info") -> DataFrame:
    """Largest change by size with its sign; an increase wins a tie; unscored rows are dropped."""
    f = F.split(F.col(info), r"\|")
    df = vcf.filter(F.col(info).isNotNull())
    for i, n in ((1, "incr"), (2, "decr")):
        part = F.split(F.get(f, F.lit(i)), ":")
        df = df.withColumns({f"pang_{n}": F.get(part, F.lit(1)).cast("double"), f"pang_{n}_pos": F.get(part, F.lit(0)).cast("int")})
    up = F.abs("pang_incr") >= F.abs("pang_decr")
    top = F.when(up, F.col("pang_incr")).otherwise(F.col("pang_decr"))
    kind = F.when(F.col("pang_incr") == top, "pang_incr").otherwise("pang_decr")
    df = df.withColumns({"pang_max": top, "pang_max_type": kind})
    return df.withColumn("pang_max_pos", F.when(F.col("pang_max_type") == "pang_incr", F.col("pang_incr_pos")).otherwise(F.col("pang_decr_pos")))


def parse_consplice_info(vcf: DataFrame, lift: DataFrame, info: str = "info", keys=("ConSplice", "ConSpliceML")) -> DataFrame:
    """Last field of two INFO entries, with the position in the other genome build."""
    m = F.str_to_map(F.col(info), F.lit(";"), F.lit("="))
    df = vcf.withColumns(
        {
            out: F.element_at(F.split(F.try_element_at(m, F.lit(k)), r"\|"), -1).cast("double")
            for out, k in zip(("consplice", "conspliceml"), keys)
        }
    )
    return df.withColumnRenamed("pos", "hg38_pos").join(lift.select("chrom", "hg38_pos", "hg19_pos"), ["chrom", "hg38_pos"])
