"""Interval joins by binning.

An equality on chromosome alone leaves every probe to scan a whole chromosome.
Both sides are dealt into bins of a fixed width and joined on (chromosome, bin)
with the exact condition besides, so Catalyst plans a hash or sort-merge join
whose skewed bins it can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chrom import chrom_key

BIN = 10_000


def bins(start: Column, end_excl: Column, width: int = BIN) -> Column:
    """Bins that a half-open range touches; none for an empty range."""
    first, last = F.floor(start / width), F.floor((end_excl - 1) / width)
    return F.when(end_excl > start, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def point_join(intervals: DataFrame, points: DataFrame, width: int = BIN, how: str = "inner") -> DataFrame:
    """intervals (key, start, end_excl, ...) with points (p_key, p_pos, ...) in
    them. A point has one bin, so no pair occurs twice."""
    left = intervals.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end_excl"), width)))
    right = points.withColumn("_p_bin", F.floor(F.col("p_pos") / width))
    on = (F.col("key") == F.col("p_key")) & (F.col("_bin") == F.col("_p_bin")) & (F.col("p_pos") >= F.col("start")) & (F.col("p_pos") < F.col("end_excl"))
    return left.join(right, on, how).drop("_bin", "_p_bin")


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """left (key, start, end_excl) and right (o_key, o_start, o_end) that
    overlap; a pair is emitted in the first bin that both touch."""
    a = left.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end_excl"), width)))
    b = right.withColumn("_o_bin", F.explode(bins(F.col("o_start"), F.col("o_end"), width)))
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("o_start") / width))
    on = (F.col("key") == F.col("o_key")) & (F.col("_bin") == F.col("_o_bin")) & (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end_excl")) & (F.col("_bin") == first)
    return a.join(b, on).drop("_bin", "_o_bin")


def extents(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ranges (extent, key, start, end_excl) of regions, and the extent
    of each region_idx, so that what a range gives is computed once."""
    feature = regions.select("region_idx", chrom_key(F.col("chrom")).alias("key"), "start", "end_excl")
    extent = feature.groupBy("key", "start", "end_excl").agg(F.min("region_idx").alias("extent"))
    return extent, feature.join(extent, ["key", "start", "end_excl"]).select("region_idx", "extent")


def overlapping_ids(left: DataFrame, right: DataFrame, name: str, width: int = BIN) -> DataFrame:
    """right with the column `name` of the left rows that overlap it, a row a
    pair. Left rows of one extent meet right's once, at most 256 together, and
    right is dealt anew, as the pairs are many more than the rows read."""
    extent = ["key", "start", "end_excl"]
    place = F.row_number().over(Window.partitionBy(*extent).orderBy(name)) - 1
    few = left.withColumn("_part", F.floor(place / 256)).groupBy(*extent, "_part").agg(F.collect_list(name).alias("_ids"))
    spark = left.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return overlap_join(few, right.repartition(n), width).withColumn(name, F.explode("_ids")).drop("_ids", "_part")
