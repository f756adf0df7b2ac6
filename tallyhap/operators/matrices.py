"""Dense indices and coordinate matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a column that numbers its rows from 1 by a numeric column. Rows
    are dealt into ranges of its quantiles; each range is numbered apart, behind
    the sizes of those before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(order, [k / n for k in range(1, n)], 0.5 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(order).cast("double") > c)) if cuts else F.lit(0)
    dealt, before, offsets = df.withColumn("_part", part), 0, []
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():  # one row a range
        offsets += [F.lit(r[0]), F.lit(before)]
        before += r[1]
    at = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + at
    return dealt.withColumn(name, place.cast("long")).drop("_part")


def row_index(regions: DataFrame) -> DataFrame:
    """region_idx and its 1-based row, in input order."""
    return numbered(regions.select("region_idx"), "region_idx", "row")


def column_index(cells: DataFrame) -> DataFrame:
    """cell and its 1-based column, in order of name."""
    return cells.select("cell", F.row_number().over(Window.orderBy("cell")).cast("long").alias("col"))


def coordinates(counts: DataFrame, value: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """row, col, value of the non-zero entries."""
    return counts.where(F.col(value) > 0).join(rows, "region_idx").join(columns, "cell").select("row", "col", F.col(value).cast("long").alias("value"))
