"""Which reads count, as one predicate or with the reason of refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cigar import aligned_length
from ..params import PAIRED, PROPER_PAIR, ReadParams


def refusal(p: ReadParams, mapq: Column, flag: Column, cell: Column | None, umi: Column | None, blocks: Column) -> Column:
    """0 for a read that counts, else the code of the first rule that refuses
    it: -2 mapping quality, -3 excluded flag, -4 no included flag, -5 orphan,
    -11 no cell, -12 no UMI, -21 too short. Cheap rules stand first."""
    c = F.when(mapq < p.min_mapq, -2)
    if p.exclude:
        c = c.when(flag.bitwiseAND(p.exclude) != 0, -3)
    if p.incl_flag:
        c = c.when(flag.bitwiseAND(p.incl_flag) == 0, -4)
    if p.no_orphan:
        c = c.when((flag.bitwiseAND(PAIRED) != 0) & (flag.bitwiseAND(PROPER_PAIR) == 0), -5)
    if p.cell_tag and cell is not None:
        c = c.when(cell.isNull(), -11)
    if p.umi_tag and umi is not None:
        c = c.when(umi.isNull() | (umi == ""), -12)
    return c.when(aligned_length(blocks) < p.min_len, -21).otherwise(0)


def counts(p: ReadParams, mapq: Column, flag: Column, cell: Column | None, umi: Column | None, blocks: Column) -> Column:
    """The same rules as one conjunction, which Catalyst pushes to the scan."""
    c = mapq >= p.min_mapq
    if p.exclude:
        c &= flag.bitwiseAND(p.exclude) == 0
    if p.incl_flag:
        c &= flag.bitwiseAND(p.incl_flag) != 0
    if p.no_orphan:
        c &= (flag.bitwiseAND(PAIRED) == 0) | (flag.bitwiseAND(PROPER_PAIR) != 0)
    if p.cell_tag and cell is not None:
        c &= cell.isNotNull()
    if p.umi_tag and umi is not None:
        c &= umi.isNotNull() & (umi != "")
    return c & (aligned_length(blocks) >= p.min_len)


def counted_reads(reads: DataFrame, p: ReadParams) -> DataFrame:
    """reads (file_idx, rec_idx, cell, umi, chrom, pos, end_excl, blocks, ...) that count."""
    return reads.where(counts(p, F.col("mapq"), F.col("flag"), F.col("cell"), F.col("umi") if p.umi_tag else None, F.col("blocks")))
