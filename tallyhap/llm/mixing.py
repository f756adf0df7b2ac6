"""Mixing sources to target weights: Sainte-Lague apportionment.

Targets come from the weights by filling up to each source's limit. Blocks of
equal tokens are then given to sources by the highest quotients target / (2 s +
1), and within a source to its shards in the same way, which gives each shard
an integer quota of blocks. A shard's documents stand in seeded hash order, end
to end; its quota is whole passes over that line plus a seeded, evenly spaced
selection of its blocks. A document's share is what the chosen blocks take of
it, so it is at most its size times the passes, rounded up; `blocks` says which
words these are.

The highest quotients are those above a cut that is found by narrowing an
interval, then the best of the few that lie in it. For sources this is done by
aggregates over the table of sources, however many there are; the shards of one
source are at most `shards` + 1 rows and are done by one task.

Only (id, source, size) is shuffled, by (source, shard), unless the rows
themselves are asked for; a hot source has as many shards as its size asks for.

Nulls: a null text has size 0; the null source is a source, after all others.
Sources of size 0 get a target of 0. Repeated rows are counted and placed one
by one. The empty table gives an empty mix. Extra columns are ignored, or kept
by `mixed_rows`, where those of the mix win over columns of the same name.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, written

#: Relative doubt about a quotient's place beside a cut, in doubles.
_DOUBT = 1e-12
#: Cuts that are tried at once, and quotients that need no narrower interval.
_GRID, _FEW = 256, 10_000


@dataclass(frozen=True)
class MixParams:
    """weights repeat over the sources in order; total and limit are shares of
    all sizes and of a source's own; block is in tokens. A shard is of
    `shard` tokens, or of a `shards`th of all tokens where that is more."""

    weights: tuple[int, ...] = (5, 2, 1)
    total: float = 1.5
    limit: int = 2
    block: int = 8
    shard: int = 100_000
    shards: int = 20_000
    seed: int = 7


def targets(sizes: Sequence[int], weights: Sequence[int], total: float, limit: int) -> list[float]:
    """Shares of `total` by weight; what goes beyond limit * size is reshared
    among the others until none is above."""
    out, free = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    full = 0
    while free:
        rest, weight = total - full, sum(weights[i] for i in free)
        above = [i for i in free if rest * weights[i] / weight > limit * sizes[i]]
        if not above:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in above:
            out[i] = float(limit * sizes[i])
            full += limit * sizes[i]
        gone = set(above)
        free = [i for i in free if i not in gone]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 s + 1), as doubles, ties to the
    earlier one; none gets more than `most`."""
    v = np.array(votes, float)
    top = np.full(len(v), max(0, seats)) if most is None else np.minimum(np.array(most, np.int64), max(0, seats))
    top = np.where(v > 0, top, 0)
    if top.sum() <= seats:
        return [int(x) for x in top]

    def above(cut: float, doubt: float) -> np.ndarray:
        """How many of each one's quotients are at least the cut, or one more
        where that is in doubt (or one less)."""
        return np.clip(np.floor((v / cut * (1 + doubt) + 1) / 2 + doubt), 0, top).astype(np.int64)

    low, high = v[v > 0].min() / (2 * seats + 1) / 2, v.max() * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        if not low < mid < high:
            break
        low, high = (low, mid) if above(mid, _DOUBT).sum() <= seats else (mid, high)
    won = above(high, -_DOUBT)  # all of these are among the highest
    heap = [(-v[i] / (2 * won[i] + 1), i) for i in np.flatnonzero(won < top)]
    heapq.heapify(heap)
    for _ in range(seats - int(won.sum())):
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < top[i]:
            heapq.heappush(heap, (-v[i] / (2 * won[i] + 1), i))
    return [int(x) for x in won]


def source_targets(sources: DataFrame, p: MixParams) -> DataFrame:
    """sources: source, size (one row each) -> with rank (by code point, null
    last) and target, the same as `targets` gives. Each round is an aggregate."""
    ranked = numbered(sources, [F.col("source").isNull(), F.col("source")], "rank", "mix-ranks")
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (F.col("rank") % len(p.weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "size", "rank", weight.cast("double").alias("weight")), "mix-weights")
    limit = F.col("size") * p.limit
    total = p.total * (ranked.agg(F.sum("size")).first()[0] or 0)
    rest, free, level = total, None, 0.0
    while True:
        # those above any earlier level stay full, as the level only rises
        full = F.col("weight") * level > limit if free is not None else F.lit(False)
        taken, weights = ranked.where("size > 0").agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        rest, new = total - (taken or 0), weights or 0.0
        if new == free or not new:
            break
        free, level = new, rest / new
    target = F.when(F.col("size") <= 0, 0.0).when(F.col("weight") * level > limit, limit.cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / (free or 1.0))
    return written(ranked.select("source", "size", "rank", target.cast("double").alias("target")), "mix-targets")


def source_quotas(sources: DataFrame, p: MixParams) -> DataFrame:
    """sources with target and rank -> with quota, in blocks: sainte_lague over
    a table of any length."""
    v, block = F.col("target"), p.block
    top = F.when(v > 0, F.ceil(F.col("size") * p.limit / block)).otherwise(0).cast("long")
    all_, least, most, room = sources.agg(F.sum("size"), F.min(F.when(v > 0, v)), F.max("target"), F.sum(top)).first()
    seats = round(min(p.total, p.limit) * (all_ or 0) / block)
    if not seats or room <= seats:
        return sources.withColumn("quota", top if seats else F.lit(0).cast("long"))

    def above(cut, doubt: float):
        return F.least(top, F.greatest(F.lit(0), F.floor((v / cut * (1 + doubt) + 1) / 2 + doubt))).cast("long")

    low, high, few = least / (2 * seats + 1) / 2, most * 2, False
    while not few:
        grid = F.explode(F.array(*(F.lit(float(x)) for x in np.geomspace(low, high, _GRID))))
        held = sorted((r["cut"], r["n"]) for r in sources.select("target", "size", grid.alias("cut")).groupBy("cut").agg(F.sum(above(F.col("cut"), _DOUBT)).alias("n")).collect())
        over, under = [x for x in held if x[1] > seats] or [(low, room)], [x for x in held if x[1] <= seats] or [(high, 0)]
        few = over[-1][1] - under[0][1] <= _FEW or (low, high) == (over[-1][0], under[0][0]) or under[0][0] / over[-1][0] < 1 + 4 * _DOUBT
        low, high = over[-1][0], under[0][0]
    sure = written(sources.withColumn("sure", above(F.lit(high), -_DOUBT)).withColumn("may", above(F.lit(low), _DOUBT)), "mix-sure")
    left = seats - sure.agg(F.sum("sure")).first()[0]
    # the few quotients of the interval, highest first
    rest = sure.where("may > sure").select("rank", "target", F.explode(F.sequence("sure", F.col("may") - 1)).alias("s"))
    best = rest.orderBy(F.desc(v / (2 * F.col("s") + 1)), "rank", "s").limit(left).groupBy("rank").agg(F.count("*").alias("more"))
    return sure.join(best, "rank", "left").select("source", "size", "rank", "target", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))


def token_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


_COLUMNS = ("size", "source_size", "target", "quota", "taken", "blocks")


def mix_sources(df: DataFrame, params: MixParams = MixParams(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, size, source_size, target, quota (blocks of the row's
    shard), taken and blocks of each row. blocks: what the mix takes besides
    `passes` whole readings, as words [start, end) of the document."""
    few = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), token_count(F.col(f"`{text}`").cast("string")).alias("size"))
    # a few bytes a row; read twice
    return _mixed(written(few, "mix-sizes"), params).select(F.col("key").alias(key), F.col("source").alias(source), *_COLUMNS, "passes")


def mixed_rows(df: DataFrame, params: MixParams = MixParams(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of df themselves with the columns of the mix, so that the corpus
    can be read off; df is read twice and shuffled once."""
    few = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), token_count(F.col(f"`{text}`").cast("string")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    )
    mine = {*_COLUMNS, "passes"}
    return _mixed(few, params).select(*(F.col("row")[c].alias(c) for c in df.columns if c.lower() not in mine), *_COLUMNS, "passes")


def mixing_targets(df: DataFrame, params: MixParams = MixParams(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, size, source_size and target of each row."""
    sized = written(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), token_count(F.col(f"`{text}`").cast("string")).alias("size")), "mix-sizes")
    goals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("size")), params)
    right = goals.select(F.col("source").alias("own"), F.col("size").alias("source_size"), "target")
    return sized.join(right, F.col("source").eqNullSafe(F.col("own"))).select(F.col("key").alias(key), "size", "source_size", "target")


def _mixed(rows: DataFrame, p: MixParams) -> DataFrame:
    """rows (key, source, size, ...) with the mix's columns."""
    spot = F.xxhash64(F.lit(p.seed), F.col("key").cast("string"))
    sources = written(source_quotas(source_targets(rows.groupBy("source").agg(F.sum("size").alias("size")), p), p), "mix-sources")
    length = max(p.shard, -(-(sources.agg(F.sum("size")).first()[0] or 0) // p.shards))
    per_source = sources.select(F.col("source").alias("own"), F.floor(F.col("size") / length).alias("more"))
    # a hot source is split by Spark where its partition is large: an inner join with one row on the right
    dealt = rows.join(per_source, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    dealt = dealt.withColumn("spot", spot).withColumn("shard", F.pmod(F.shiftright("spot", 17), F.col("more") + 1)).drop("more")
    sums = dealt.groupBy("source", "shard").agg(F.sum("size").alias("line"))
    goals = sources.select(F.col("source").alias("own"), F.col("size").alias("source_size"), "target", F.col("quota").alias("all"))
    sums = sums.join(goals, F.col("source").eqNullSafe(F.col("own"))).drop("own")

    def shared(g: pd.DataFrame) -> pd.DataFrame:  # at most p.shards + 1 rows
        g = g.sort_values("shard")
        sizes = [int(x) for x in g["line"]]
        return g.assign(quota=sainte_lague(sizes, int(g["all"].iloc[0]), [-(-p.limit * x // p.block) for x in sizes])).drop(columns="all")

    kept = written(sums.groupBy("source").applyInPandas(shared, "source string, shard long, line long, source_size long, target double, quota long"), "mix-quotas")
    right = kept.withColumnRenamed("source", "s2").withColumnRenamed("shard", "h2")
    both = dealt.join(right, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("h2")))
    upto = Window.partitionBy("source", "shard").orderBy("spot", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("till", F.sum("size").over(upto)).withColumn("from", F.col("till") - F.col("size"))
    block, quota = p.block, F.col("quota")
    n = F.ceil(F.col("line") / block)
    passes = F.when(n > 0, F.floor(quota / n)).otherwise(0).cast("long")
    placed = placed.withColumn("n", n).withColumn("passes", passes).withColumn("rest", quota - F.col("passes") * F.col("n"))
    placed = placed.withColumn("phase", F.when(F.col("n") > 0, F.pmod(F.xxhash64(F.lit(p.seed), F.col("source"), F.col("shard")), F.col("n"))).otherwise(0))

    def chosen(k):  # of the line's first k blocks; all `rest` of n, evenly spaced
        return F.floor(F.try_divide(k * F.col("rest") + F.col("phase"), F.col("n")))

    first, last = F.floor(F.col("from") / block), F.floor((F.col("till") - 1) / block)
    own = F.filter(F.sequence(first, last), lambda k: chosen(k + 1) > chosen(k))
    start, end = lambda k: F.greatest(k * block, F.col("from")) - F.col("from"), lambda k: F.least((k + 1) * block, F.col("till")) - F.col("from")
    cut = F.transform(own, lambda k: F.struct(start(k).cast("long").alias("start"), end(k).cast("long").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    placed = placed.withColumn("blocks", F.when((F.col("size") > 0) & (F.col("rest") > 0), cut).otherwise(none))
    taken = F.col("passes") * F.col("size") + F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b["end"] - b["start"])
    return placed.withColumn("taken", taken.cast("long"))
