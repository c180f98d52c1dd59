"""Shared helpers: shared folders, folds, words and views of Arrow text as byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five control characters TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; in tests, where none is named, one below the warehouse."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return (root or context.getCheckpointDir()).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder as Parquet and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key's decimal text modulo ``parts``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(-1))


def at_least_pow2(n: int) -> int:
    """The smallest power of two that is at least ``n``."""
    return 1 << max(0, int(n) - 1).bit_length()


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the UTF-8 bytes of a string column without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def row_blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``size`` bytes; a longer row is a run of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end
