"""Text sinks, and where intermediate tables may live."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: contig lengths of GRCh37
GRCH37_CONTIGS = {
    "1": 249250621, "2": 243199373, "3": 198022430, "4": 191154276, "5": 180915260, "6": 171115067,
    "7": 159138663, "8": 146364022, "9": 141213431, "10": 135534747, "11": 135006516, "12": 133851895,
    "13": 115169878, "14": 107349540, "15": 102531392, "16": 90354753, "17": 81195210, "18": 78077248,
    "19": 59128983, "20": 63025520, "21": 48129895, "22": 51304566, "X": 155270560, "Y": 59373566,
}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; where none is named, as in tests, one in the warehouse, which tasks share too."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return (root or context.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write a table that a plan reads several times to the shared folder, as Parquet, and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tsv(df: DataFrame, path: str) -> str:
    df.write.csv(path, sep="\t", header=True)
    return path


def vcf_lines(df: DataFrame, file_date: str, chr_prefix: bool = False) -> DataFrame:
    """Header and body lines with the columns that order them."""
    name = "chr" if chr_prefix else ""
    head = ["##fileformat=VCFv4.2", f"##fileDate={file_date}", "##reference=GRCh37/hg19"]
    head += [f"##contig=<ID={name}{c},length={n}>" for c, n in GRCH37_CONTIGS.items()]
    head.append("#" + "\t".join("CHROM POS ID REF ALT QUAL FILTER INFO".split()))
    spark = df.sparkSession
    header = spark.createDataFrame([(i, "", 0, line) for i, line in enumerate(head)], "ord int, chrom string, pos int, line string")
    dot = F.lit(".")
    body = df.select(
        F.lit(len(head)).alias("ord"),
        F.concat(F.lit(name), F.regexp_replace("chrom", "^chr", "")).alias("chrom"),
        F.col("pos").cast("int").alias("pos"),
        "ref",
        "alt",
    ).select("ord", "chrom", "pos", F.concat_ws("\t", "chrom", "pos", dot, "ref", "alt", dot, dot, dot).alias("line"))
    return header.union(body)


def write_vcf(df: DataFrame, path: str, file_date: str, chr_prefix: bool = False) -> str:
    """Range-sorted part files: the header lines come first, then the body by position."""
    vcf_lines(df, file_date, chr_prefix).orderBy("ord", "chrom", "pos", "line").select("line").write.text(path)
    return path


def partition_by_chrom(df: DataFrame, path: str, name: str = "name") -> str:
    """One directory per chromosome, taken from the part of the name before the first ``_``.

    Each task writes its own file per chromosome, so one large chromosome is no bottleneck.
    """
    df.withColumn("chrom", F.split(F.col(name), "_")[0]).write.partitionBy("chrom").parquet(path)
    return path


def explode_range(df: DataFrame, start: str, end: str, out: str, block: int = 8192) -> DataFrame:
    """One row per integer in ``[start, end]``; in two steps, so no row holds a long array."""
    blocks = df.withColumn("_b", F.explode(F.sequence(F.col(start), F.col(end), F.lit(block).cast("int"))))
    last = F.least(F.col("_b") + (block - 1), F.col(end))
    return blocks.withColumn(out, F.explode(F.sequence(F.col("_b"), last))).drop("_b")


def liftover_positions(intervals: DataFrame) -> DataFrame:
    """BED rows (chrom, pos, pos + 1) for every base of each interval, ends included."""
    rows = explode_range(intervals.filter(F.col("start_pos") <= F.col("end_pos")), "start_pos", "end_pos", "pos")
    return rows.withColumn("end", F.col("pos") + 1).select("chrom", "pos", "end")
