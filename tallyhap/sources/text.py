"""Line readers: every text format starts from ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no. line_no grows along the file but has gaps: it is made
    of the split's offset and the place in the split, without a shuffle (splits
    are of 1 MB at least). Gzip and BGZF files are read whole by one task."""
    raw = spark.read.text(path)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return raw.select("value", (F.shiftleft(F.col("_metadata.file_block_start"), 20) + place).alias("line_no"))


def fields_of(value: Column, sep: str = "\t") -> Column:
    return F.split(value, sep)


def head_lines(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """A file's header: its lines of a prefix, in order, on the driver."""
    return [r["value"] for r in lines(spark, path).where(F.col("value").startswith(prefix)).orderBy("line_no").collect()]


def id_list(text_or_path: str, spark: SparkSession | None = None) -> list[str]:
    """A comma-separated list, or one entry per line of a file."""
    if spark is None:
        return [x.strip() for x in text_or_path.split(",") if x.strip()]
    return [r["value"].strip() for r in lines(spark, text_or_path).orderBy("line_no").collect() if r["value"].strip()]
