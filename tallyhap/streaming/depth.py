"""Total depth over a stream of reads: the same plan, kept up to date.

Distinct molecules are deduplicated by (region, cell, UMI) in the state store,
so a molecule that comes again in a later batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.depth import region_reads
from ..operators.filters import counted_reads
from ..operators.intervals import BIN
from ..params import DepthParams


def stream_depth(reads: DataFrame, regions: DataFrame, cells: DataFrame, p: DepthParams = DepthParams(), width: int = BIN) -> DataFrame:
    """A streaming frame of region_idx, cell, n for outputMode("complete"). The
    state holds one row per molecule of a region; regions and cells are static."""
    kept = counted_reads(reads, p).join(cells.select("cell"), "cell")
    seen = region_reads(kept, regions, p, width).select("region_idx", "cell", "umi").dropDuplicates(["region_idx", "cell", "umi"])
    return seen.groupBy("region_idx", "cell").agg(F.count("*").alias("n"))
