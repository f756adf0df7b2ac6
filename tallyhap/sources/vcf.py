"""Variants: VCF tables, phased SNPs, and pileup directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chrom import chrom_key
from ..functions.fields import format_field, hap_pair, phased_pair
from ..operators.matrices import numbered
from .mtx import read_mtx
from .text import head_lines, lines

_BASE = "^[ACGTN]$"


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(variants with line_no and the columns that #CHROM names, header lines).
    CHROM is a string, POS a long; other columns stay strings."""
    header = head_lines(spark, path, "#")
    names = next((h for h in header if h.startswith("#CHROM")), None)
    if names is None:
        raise ValueError("the file has no #CHROM line")
    v = lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    columns = [F.get(f, F.lit(k)).alias(n.lstrip("#")) for k, n in enumerate(names.split("\t"))]
    return v.select("line_no", *columns).withColumn("POS", F.col("POS").try_cast("long")), header


def _snps(df: DataFrame) -> DataFrame:
    """SNPs of one-base alleles with a haplotype for either."""
    good = F.col("ref").rlike(_BASE) & F.col("alt").rlike(_BASE) & F.col("pos").isNotNull() & F.col("h").isNotNull()
    return df.where(good).select(F.col("line_no").alias("snp_idx"), chrom_key(F.col("chrom")).alias("chrom"), "pos", "ref", "alt", F.col("h")["ref_hap"].alias("ref_hap"), F.col("h")["alt_hap"].alias("alt_hap"))


def read_phased_vcf(spark: SparkSession, path: str) -> DataFrame:
    """snps of the first sample's heterozygous genotypes, phased or not. Rows
    of fewer than ten columns, or without GT, are left out."""
    v = lines(spark, path).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    return _snps(v.where(F.size(f) >= 10).select("line_no", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.upper(F.get(f, F.lit(3))).alias("ref"), F.upper(F.get(f, F.lit(4))).alias("alt"), hap_pair(format_field(F.get(f, F.lit(8)), F.get(f, F.lit(9)))).alias("h")))


def read_snp_tsv(spark: SparkSession, path: str) -> DataFrame:
    """snps of six tab-separated columns below a header line."""
    v = lines(spark, path)
    first = v.agg(F.min("line_no").alias("first"))
    f = F.split("value", "\t")
    a, b = F.trim(F.get(f, F.lit(4))), F.trim(F.get(f, F.lit(5)))
    h = F.when(((a == "0") & (b == "1")) | ((a == "1") & (b == "0")), F.struct(a.cast("int").alias("ref_hap"), b.cast("int").alias("alt_hap")))
    body = v.join(F.broadcast(first), F.col("line_no") > F.col("first")).where(F.size(f) >= 6)  # one row
    return _snps(body.select("line_no", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.upper(F.get(f, F.lit(2))).alias("ref"), F.upper(F.get(f, F.lit(3))).alias("alt"), h.alias("h")))


def read_phasing_snps(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, ref_hap, alt_hap from genotypes a|b of the first sample."""
    v, header = read_vcf(spark, path)
    sample = next(h for h in header if h.startswith("#CHROM")).split("\t")[9]
    h = phased_pair(F.col(f"`{sample}`"))
    return v.select(F.col("line_no").alias("snp_idx"), F.regexp_replace("CHROM", "^chr", "").alias("chrom"), F.col("POS").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), h["ref_hap"].alias("ref_hap"), h["alt_hap"].alias("alt_hap"))


def read_sites(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """Sites for reference repair (alleles, gts, phased), header and samples."""
    v, header = read_vcf(spark, path)
    samples = next(h for h in header if h.startswith("#CHROM")).split("\t")[9:]
    raw = F.array(*[format_field(F.col("FORMAT"), F.col(f"`{s}`")) for s in samples])
    alleles = F.filter(F.concat(F.array(F.upper("REF")), F.transform(F.split("ALT", ","), lambda a: F.upper(a))), lambda a: a != ".")
    out = v.withColumn("raw", raw).select(
        "line_no", F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), alleles.alias("alleles"),
        F.when(~F.exists("raw", lambda g: g.isNull()), F.transform("raw", lambda g: F.split(g, r"[|/]"))).alias("gts"), F.transform("raw", lambda g: F.coalesce(g.contains("|"), F.lit(False))).alias("phased"),
    )
    return out, header, samples


def read_pileup_dir(spark: SparkSession, path: str, genotypes: bool = False) -> dict[str, DataFrame]:
    """features (row, CHROM, POS, ...), cells (col, cell) and counts (row, col,
    ad, dp, oth) of a pileup directory; matrices stay sparse. With genotypes:
    genotypes (row, col, and the entries that FORMAT names, as a map), where the
    directory has them."""
    variants, _ = read_vcf(spark, f"{path}/cellSNP.base.vcf.gz")
    names = [r["value"] for r in lines(spark, f"{path}/cellSNP.samples.tsv").orderBy("line_no").collect()]
    cells = spark.createDataFrame(list(enumerate(names, 1)), "col long, cell string")
    parts = [read_mtx(spark, f"{path}/cellSNP.tag.{t.upper()}.mtx").select("row", "col", F.lit(t).alias("t"), "value") for t in ("ad", "dp", "oth")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = every.groupBy("row", "col").agg(*[F.coalesce(F.sum(F.when(F.col("t") == t, F.col("value"))), F.lit(0)).alias(t) for t in ("ad", "dp", "oth")])
    out = {"features": numbered(variants, "line_no", "row"), "cells": cells, "counts": counts}
    if genotypes:
        called, header = read_vcf(spark, f"{path}/cellSNP.cells.vcf.gz")
        names = next(h for h in header if h.startswith("#CHROM")).split("\t")[9:]
        each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("col"), F.col(f"`{s}`").alias("v")) for k, s in enumerate(names, 1)])).alias("x")
        long = numbered(called, "line_no", "row").select("row", "FORMAT", each)
        entries = F.map_from_arrays(F.split("FORMAT", ":"), F.transform(F.split("FORMAT", ":"), lambda _, i: F.get(F.split("x.v", ":"), i)))
        out["genotypes"] = long.select("row", "x.col", entries.alias("entries"))
    return out
