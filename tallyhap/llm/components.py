"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable ids -> (node, component): the smallest id
    reachable, for every node of an edge but the components' smallest ones.

    Each round hangs larger neighbours on a node's smallest one, then smaller
    ones; minima are pre-aggregated, and the edges of a hot node are split by
    Spark's skew handling. Rounds are checkpointed, so a lost executor repeats
    one round at most. Minima are checkpointed apart from the edges that they
    are joined with, so that Spark can split a node's edges there. Null ends and loops are dropped; no edge gives no row.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct().checkpoint()
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).checkpoint()
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct().checkpoint()
        down = large.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        then = small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct().checkpoint()
        new = _mark(then)
        now = then
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
