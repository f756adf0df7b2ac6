"""Alleles, molecules and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def hap_of(base: Column, ref: Column, alt: Column, ref_hap: Column, alt_hap: Column) -> Column:
    """The haplotype that a base supports, -1 for any other base; null stays null.
    Where ref and alt are equal the alternative counts."""
    return F.when(base.isNull(), F.lit(None).cast("int")).when(base == alt, alt_hap).when(base == ref, ref_hap).otherwise(-1)


def base_bucket(base: Column) -> Column:
    """A, C, G, T, or N for the rest."""
    return F.when(base.isNotNull(), F.when(base.isin(*BASES), base).otherwise("N"))


def umi_key(umi: Column | None, qname: Column) -> Column:
    """What counts once: the molecule's tag, or the read's name without tags (so
    both mates of a pair count once)."""
    return qname if umi is None else umi


def baf(ad: Column, dp: Column) -> Column:
    return F.when(dp > 0, ad / dp)


def clamp(x: Column, epsilon: float) -> Column:
    """Values outside the open unit interval move to epsilon from its ends."""
    return F.when(x <= 0, F.lit(epsilon)).when(x >= 1, F.lit(1 - epsilon)).otherwise(x)


def pl_to_gq(pl: Column) -> Column:
    """Median less minimum of three Phred likelihoods, comma-separated."""
    v = F.array_sort(F.transform(F.split(pl, ","), lambda x: x.cast("double")))
    return F.when(F.size(v) == 3, F.get(v, F.lit(1)) - F.get(v, F.lit(0)))


def gl_to_gq(gl: Column) -> Column:
    """Ten times the maximum less the median of three log likelihoods."""
    v = F.array_sort(F.transform(F.split(gl, ","), lambda x: x.cast("double")))
    return F.when(F.size(v) == 3, 10 * (F.get(v, F.lit(2)) - F.get(v, F.lit(1))))
