"""Variant tables: genotypes, uniqueness, merging, splitting, header contigs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chrom import add_chr, remove_chr
from ..functions.fields import info_ordinal

KEY = ("CHROM", "POS", "REF", "ALT")


def first_of_each(variants: DataFrame, order: str = "line_no", key: tuple[str, ...] = KEY) -> DataFrame:
    """Of equal variants the one that comes first."""
    w = Window.partitionBy(*key).orderBy(order)
    return variants.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def add_genotype(variants: DataFrame, genotype: str = "0/1", sample: str = "sample", chr_prefix: bool = True, unique: bool = True, order: str = "line_no") -> DataFrame:
    """FORMAT GT and one sample column of a fixed genotype."""
    out = variants.withColumn("CHROM", add_chr(F.col("CHROM")) if chr_prefix else F.col("CHROM")).withColumn("FORMAT", F.lit("GT")).withColumn(sample, F.lit(genotype))
    return first_of_each(out, order) if unique else out


def merge_variants(parts: list[DataFrame], sort: bool = False) -> DataFrame:
    """Bag union by column name, in key order if asked."""
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.orderBy(*KEY) if sort else out


def split_counts(variants: DataFrame, chroms: list[str]) -> DataFrame:
    """CHROM and n for each listed chromosome, empty ones too."""
    listed = variants.sparkSession.createDataFrame([(c,) for c in chroms], "CHROM string")
    return listed.join(variants.groupBy("CHROM").agg(F.count("*").alias("n")), "CHROM", "left").select("CHROM", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def info_sums(variants: DataFrame) -> DataFrame:
    """ad and dp from INFO entries AD=..;DP=.., by place."""
    return variants.withColumn("ad", info_ordinal(F.col("INFO"), 0)).withColumn("dp", info_ordinal(F.col("INFO"), 1))


def with_chr(variants: DataFrame) -> DataFrame:
    return variants.withColumn("CHROM", add_chr(F.col("CHROM")))


def without_chr(variants: DataFrame) -> DataFrame:
    return variants.withColumn("CHROM", remove_chr(F.col("CHROM")))


def rename_chroms(variants: DataFrame, names: DataFrame, column: str = "CHROM") -> DataFrame:
    """Chromosomes renamed by a table (old, new); others keep their name."""
    out = variants.join(names.select(F.col("old").alias(column), "new"), column, "left")
    return out.withColumn(column, F.coalesce("new", column)).drop("new")


def at_positions(variants: DataFrame, positions: DataFrame, chrom: str = "CHROM", pos: str = "POS") -> DataFrame:
    """Variants at the positions of another table."""
    return variants.join(positions.select(chrom, pos), [chrom, pos], "left_semi")


def to_bed(variants: DataFrame) -> DataFrame:
    return variants.select("CHROM", F.col("POS").alias("start"), (F.col("POS") + 1).alias("end"))


_CONTIG = re.compile(r"^##contig=<.*?ID=([^,>]+)")


def header_chr(header: list[str], add: bool) -> list[str]:
    """Contig lines with or without the chr prefix."""
    def one(line: str) -> str:  # noqa: E306
        m = _CONTIG.match(line)
        if not m:
            return line
        name = m[1] if add and m[1].startswith("chr") else f"chr{m[1]}" if add else re.sub("^chr", "", m[1])
        return line[: m.start(1)] + name + line[m.end(1) :]

    return [one(x) for x in header]


def missing_contigs(variants: DataFrame, header: list[str]) -> DataFrame:
    """Chromosomes of the body that no contig line names, exactly."""
    known = sorted({m[1] for m in map(_CONTIG.match, header) if m})
    body = variants.select("CHROM").distinct()
    return body.where(~F.col("CHROM").isin(known)) if known else body


def complete_header(header: list[str], chroms: list[str]) -> list[str]:
    """Contig lines for chroms added; all of them sorted where the first one
    stood, or else before #CHROM."""
    lines = [x for x in header if _CONTIG.match(x)]
    known = {_CONTIG.match(x)[1] for x in lines}
    lines = sorted(lines + [f"##contig=<ID={c}>" for c in chroms if c not in known])
    rest = [x for x in header if not _CONTIG.match(x)]
    at = next((i for i, x in enumerate(header) if _CONTIG.match(x)), None)
    if at is None:
        at = next((i for i, x in enumerate(rest) if x.startswith("#CHROM")), len(rest))
    return rest[:at] + lines + rest[at:]


def autosomes(variants: DataFrame) -> DataFrame:
    names = [str(k) for k in range(1, 23)]
    return variants.where(F.col("CHROM").isin(names + [f"chr{k}" for k in names]))
