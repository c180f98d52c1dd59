"""Readers for the text formats of the field; each one is a single lazy scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from juncture.operators.barcodes import subassembly_columns

PAIRED, UNMAPPED, MATE_UNMAPPED, READ2, SECONDARY = 0x1, 0x4, 0x8, 0x80, 0x100

SUBASSEMBLY = (
    "readgroupid string, n_variants_passing int, variant_list string, status string, "
    "ref_target_length int, minbq int, nbp_ge_1 int"
)


def read_subassembly(spark: SparkSession, path: str, schema: str = SUBASSEMBLY) -> DataFrame:
    """Tab file with a header; the barcode comes from ``readgroupid``."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return subassembly_columns(raw).withColumnRenamed("readgroupid", "barcode")


def flag_set(bit: int, col: str = "flag") -> Column:
    return F.col(col).bitwiseAND(bit) != 0


def read_alignments(spark: SparkSession, path: str, barcode_tags: tuple[str, ...] = ("RX", "BC")) -> DataFrame:
    """SAM text: fixed fields, the barcode tag and the hit index, with the flag bits named."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    f = F.split("value", "\t")

    def tag(name: str, kind: str) -> Column:
        found = F.regexp_extract("value", rf"\t{name}:{kind}:([^\t]*)", 1)
        return F.when(found != "", found)

    fields = lines.select(
        f[0].alias("qname"),
        f[1].cast("int").alias("flag"),
        f[2].alias("chrom"),
        f[3].cast("int").alias("pos"),
        f[5].alias("cigar"),
        f[9].alias("seq"),
        F.coalesce(*[tag(t, "Z") for t in barcode_tags]).alias("barcode"),
        tag("HI", "i").cast("int").alias("hi"),
    )
    return fields.withColumns(
        {
            "is_paired": flag_set(PAIRED),
            "is_unmapped": flag_set(UNMAPPED),
            "mate_unmapped": flag_set(MATE_UNMAPPED),
            "is_read2": flag_set(READ2),
            "is_secondary": flag_set(SECONDARY),
        }
    )


def read_vcf(spark: SparkSession, path: str, explode_alt: bool = False) -> DataFrame:
    """VCF body: key and raw INFO; optionally one row per alternate allele with its index."""
    schema = "chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string"
    df = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="").select("chrom", "pos", "ref", "alt", "info")
    if explode_alt:
        df = df.select("chrom", "pos", "ref", F.posexplode(F.split("alt", ",")).alias("alt_index", "alt"), "info")
    return df


def gtf_attribute(name: str, col: str = "attribute") -> Column:
    found = F.regexp_extract(F.col(col), rf'(?:^|; ?){name} "?([^";]*)"?', 1)
    return F.when(found != "", found)


def with_gtf_ids(gtf: DataFrame) -> DataFrame:
    """Pull the gene and transcript out of the attribute text; gene rows have no transcript."""
    transcript = F.when(F.col("feature") != "gene", gtf_attribute("transcript_id"))
    return gtf.withColumns({"gene_id": gtf_attribute("gene_id"), "transcript_id": transcript})


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    schema = "chrom string, source string, feature string, start_pos int, end_pos int, score string, strand string, frame string, attribute string"
    return with_gtf_ids(spark.read.csv(path, sep="\t", comment="#", schema=schema, quote=""))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start_pos int, end_pos int, gene string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (name, seq); records split on the header mark, lines joined."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.substr("value", F.length(head) + 2)
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))


def read_score_tsv(spark: SparkSession, path: str, schema: str | StructType, chrom: str = "chrom") -> DataFrame:
    """Score table with a header; the chromosome is text whatever it looks like."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return df.withColumn(chrom, F.col(chrom).cast("string")) if chrom in df.columns else df


def region_scan(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of a region, 0-based half-open, whether contigs are spelled with or without ``chr``.

    Both spellings are listed instead of rewriting the column, so the filter reaches the scan
    and prunes partitions and row groups.
    """
    bare = chrom.removeprefix("chr")
    return df.filter(F.col("chrom").isin(bare, f"chr{bare}") & (F.col("pos") > start) & (F.col("pos") <= end))
