"""Haplotype counts of regions: AD, DP and OTH of distinct molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import hap_of
from ..functions.chrom import chrom_key
from ..params import AlleleParams
from .intervals import BIN, extents, point_join


def region_snps(regions: DataFrame, snps: DataFrame, width: int = BIN) -> DataFrame:
    """region_idx, snp_idx, pos, ref, alt, ref_hap, alt_hap of SNPs in regions."""
    left = regions.select("region_idx", chrom_key(F.col("chrom")).alias("key"), "start", "end_excl")
    right = snps.select("snp_idx", chrom_key(F.col("chrom")).alias("p_key"), F.col("pos").alias("p_pos"), "ref", "alt", "ref_hap", "alt_hap")
    return point_join(left, right, width).select("region_idx", "snp_idx", F.col("p_pos").alias("pos"), "ref", "alt", "ref_hap", "alt_hap")


def molecules(first: DataFrame, inside: DataFrame) -> DataFrame:
    """region_idx, cell, umi and whether the molecule shows haplotype 0, 1, or
    another base anywhere in the region. A SNP is piled up once, however many
    regions hold it."""
    h = hap_of(F.col("allele"), F.col("ref"), F.col("alt"), F.col("ref_hap"), F.col("alt_hap"))
    seen = first.where("allele is not null").join(inside, "snp_idx").withColumn("h", h)
    return seen.groupBy("region_idx", "cell", "umi").agg(F.bool_or(F.col("h") == 0).alias("h0"), F.bool_or(F.col("h") == 1).alias("h1"), F.bool_or(F.col("h") == -1).alias("o"))


def extent_marks(first: DataFrame, snps: DataFrame, extent: DataFrame, width: int = BIN) -> DataFrame:
    """Distinct ranges of regions with a molecule and a haplotype h (-1: another
    base) that it shows there. Of a molecule's SNPs of one haplotype each meets
    only the ranges that start behind the SNP before it: no row occurs twice."""
    few = snps.select("snp_idx", chrom_key(F.col("chrom")).alias("p_key"), F.col("pos").alias("p_pos"), "ref", "alt", "ref_hap", "alt_hap")
    h = hap_of(F.col("allele"), F.col("ref"), F.col("alt"), F.col("ref_hap"), F.col("alt_hap"))
    marks = first.where("allele is not null").join(few, "snp_idx").select("p_key", "p_pos", "cell", "umi", h.alias("h"))
    marks = marks.withColumn("behind", F.lag("p_pos").over(Window.partitionBy("p_key", "cell", "umi", "h").orderBy("p_pos")))
    return point_join(extent, marks, width).where("behind is null or start > behind")


def extent_molecules(first: DataFrame, snps: DataFrame, extent: DataFrame, width: int = BIN) -> DataFrame:
    """As molecules(), of the distinct ranges of regions."""
    seen = extent_marks(first, snps, extent, width)
    return seen.groupBy("extent", "cell", "umi").agg(F.bool_or(F.col("h") == 0).alias("h0"), F.bool_or(F.col("h") == 1).alias("h1"), F.bool_or(F.col("h") == -1).alias("o"))


def haplotype_counts(seen: DataFrame, no_dup_hap: bool = True, by: str = "region_idx") -> DataFrame:
    """region_idx (or extent), cell, ad, dp, oth. Molecules on both haplotypes count for
    neither if no_dup_hap, else for both; they never count as other bases."""
    h0, h1, o = F.col("h0"), F.col("h1"), F.col("o")
    ad, ref = (h1 & ~h0, h0 & ~h1) if no_dup_hap else (h1, h0)
    out = seen.groupBy(by, "cell").agg(F.count_if(ad).alias("ad"), (F.count_if(ad) + F.count_if(ref)).alias("dp"), F.count_if(o & ~h0 & ~h1).alias("oth"))
    return out.where((F.col("dp") > 0) | (F.col("oth") > 0))


def count_haplotypes(first: DataFrame, passing: DataFrame | None, regions: DataFrame, snps: DataFrame, p: AlleleParams = AlleleParams(), width: int = BIN, flips: DataFrame | None = None) -> DataFrame:
    """first alleles of SNPs that pass (None: of all), over regions. flips (region_idx,
    snp_idx, flip): haplotypes swapped within a region; a SNP absent from the
    flips of a region that has some is left out of that region."""
    kept = first if passing is None else first.join(passing.select("snp_idx"), "snp_idx", "left_semi")
    if flips is None:
        extent, same = extents(regions)
        counts = haplotype_counts(extent_molecules(kept, snps, extent, width), p.no_dup_hap, "extent")
        return same.join(counts, "extent").select("region_idx", "cell", "ad", "dp", "oth")
    phased = flips.select("region_idx").distinct().withColumn("phased", F.lit(True))
    inside = region_snps(regions, snps, width).join(flips, ["region_idx", "snp_idx"], "left").join(phased, "region_idx", "left").where("phased is null or flip is not null")
    swap = F.coalesce(F.col("flip"), F.lit(0)) == 1
    inside = inside.select("region_idx", "snp_idx", "pos", "ref", "alt", F.when(swap, F.col("alt_hap")).otherwise(F.col("ref_hap")).alias("ref_hap"), F.when(swap, F.col("ref_hap")).otherwise(F.col("alt_hap")).alias("alt_hap"))
    return haplotype_counts(molecules(kept, inside), p.no_dup_hap)


def kept_regions(regions: DataFrame, counts: DataFrame, all_regions: bool) -> DataFrame:
    """regions with any entry, or all."""
    return regions if all_regions else regions.join(counts.select("region_idx"), "region_idx", "left_semi")
