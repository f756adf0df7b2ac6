"""SNP pileup: the first allele of each molecule, base counts and SNP filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import base_bucket
from ..functions.chrom import chrom_key
from ..functions.cigar import base_at
from ..params import AlleleParams
from .filters import counted_reads
from .intervals import BIN, point_join


def snp_reads(reads: DataFrame, snps: DataFrame, width: int = BIN) -> DataFrame:
    """Reads whose span covers a SNP, introns included."""
    return point_join(read_spans(reads), snp_points(snps), width)


def read_spans(reads: DataFrame) -> DataFrame:
    return reads.select("file_idx", "rec_idx", "cell", "umi", "blocks", *[c for c in ("seq",) if c in reads.columns], chrom_key(F.col("chrom")).alias("key"), F.col("pos").alias("start"), "end_excl")


def snp_points(snps: DataFrame) -> DataFrame:
    return snps.select("snp_idx", chrom_key(F.col("chrom")).alias("p_key"), F.col("pos").alias("p_pos"), "ref", "alt", "ref_hap", "alt_hap")


def first_spans(kept: DataFrame) -> DataFrame:
    """Where a read is the first of its molecule in its file. By start, that is
    what lies behind the ends of all reads before it, and nothing else; so a
    molecule meets a SNP once in each file, however many reads lie over it."""
    before = Window.partitionBy("key", "cell", "umi", "file_idx").orderBy("start", "rec_idx").rowsBetween(Window.unboundedPreceding, -1)
    return read_spans(kept).withColumn("start", F.greatest("start", F.coalesce(F.max("end_excl").over(before), "start"))).where("start < end_excl")


def first_alleles(reads: DataFrame, snps: DataFrame, cells: DataFrame, p: AlleleParams = AlleleParams(), width: int = BIN, base: Callable[[], Column] | None = None) -> DataFrame:
    """snp_idx, cell, umi, allele: of each molecule the base of its first read
    by file and coordinate; a null (the SNP lies in its intron) wins too.
    base: how a read's base is found, by default from seq."""
    kept = counted_reads(reads, p).join(cells.select("cell"), "cell")
    found = base() if base else base_at(F.col("blocks"), F.col("seq"), F.col("p_pos"))
    pairs = point_join(first_spans(kept), snp_points(snps), width).withColumn("base", found)
    return pairs.groupBy("snp_idx", "cell", "umi").agg(F.min_by("base", "file_idx").alias("allele"))


def base_counts(first: DataFrame) -> DataFrame:
    """snp_idx, cell, n_a, n_c, n_g, n_t, n_n."""
    b = base_bucket(F.col("allele"))
    return first.where("allele is not null").groupBy("snp_idx", "cell").agg(*[F.count_if(b == x).alias(f"n_{x.lower()}") for x in "ACGTN"])


def snp_totals(first: DataFrame, snps: DataFrame) -> DataFrame:
    """snp_idx, total, n_ref and n_alt over all cells; the total has other bases too."""
    few = first.where("allele is not null").join(snps.select("snp_idx", "ref", "alt"), "snp_idx")
    return few.groupBy("snp_idx").agg(F.count("*").alias("total"), F.count_if(F.col("allele") == F.col("ref")).alias("n_ref"), F.count_if(F.col("allele") == F.col("alt")).alias("n_alt"))


def snps_that_pass(first: DataFrame, snps: DataFrame, p: AlleleParams) -> DataFrame | None:
    """The SNPs that pass by their totals, or None where any SNP with an allele
    does, so that no totals need be taken."""
    return None if p.min_count <= 1 and p.min_maf <= 0 else passing_snps(snp_totals(first, snps), p)


def passing_snps(totals: DataFrame, p: AlleleParams) -> DataFrame:
    return totals.where((F.col("total") >= p.min_count) & (F.least("n_ref", "n_alt") >= F.col("total") * p.min_maf))


def pileup_counts(first: DataFrame, snps: DataFrame) -> DataFrame:
    """snp_idx, cell, ad (alternative), dp (reference and alternative), oth."""
    few = first.where("allele is not null").join(snps.select("snp_idx", "ref", "alt"), "snp_idx")
    ref, alt = F.col("allele") == F.col("ref"), F.col("allele") == F.col("alt")
    return few.groupBy("snp_idx", "cell").agg(F.count_if(alt).alias("ad"), F.count_if(ref | alt).alias("dp"), F.count_if(~(ref | alt)).alias("oth"))


def filter_pileup(sums: DataFrame, min_count: int = 11, min_maf: float = 0.1) -> DataFrame:
    """SNPs by summed AD and DP; other bases are left out of account."""
    baf = F.col("ad") / F.col("dp")
    return sums.where((F.col("dp") >= min_count) & (F.col("dp") > 0) & (baf >= min_maf) & (baf <= 1 - min_maf))
