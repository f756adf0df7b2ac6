"""Chromosome names and feature labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chrom_key(chrom: Column) -> Column:
    """The name without a leading chr in any case: the form that joins compare."""
    return F.regexp_replace(chrom, r"^(?i)chr", "")


def toggle_chr(chrom: Column) -> Column:
    """The other spelling of a name: without chr if it has it, else with."""
    return F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1 << 30)).otherwise(F.concat(F.lit("chr"), chrom))


def add_chr(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def remove_chr(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def region_id(name: Column, chrom: Column, start: Column, end: Column) -> Column:
    return F.coalesce(name, F.concat_ws("_", chrom, start.cast("string"), end.cast("string")))


def snp_id(chrom: Column, pos: Column) -> Column:
    return F.concat_ws("_", chrom, pos.cast("string"))


def region_label(chrom: Column, start: Column, end: Column) -> Column:
    """chrom:start-end with an inclusive end."""
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
