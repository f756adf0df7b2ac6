"""Fields of VCF and GTF lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_field(fmt: Column, sample: Column, name: str = "GT") -> Column:
    """The sample's value of a FORMAT key; null if absent, or if the sample has
    fewer fields than FORMAT."""
    keys, values = F.split(fmt, ":"), F.split(sample, ":")
    at = F.array_position(keys, name).cast("int")
    return F.when((at > 0) & (F.size(values) >= F.size(keys)), F.get(values, at - 1))


def gt_alleles(gt: Column) -> Column:
    """The first two allele numbers of a genotype, phased or not, as strings."""
    parts = F.split(gt, r"[|/]")
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, 2))


def hap_pair(gt: Column) -> Column:
    """struct(ref_hap, alt_hap) of a heterozygous 0/1 or 1/0 genotype, else null."""
    a = gt_alleles(gt)
    first, second = F.get(a, F.lit(0)), F.get(a, F.lit(1))
    het = ((first == "0") & (second == "1")) | ((first == "1") & (second == "0"))
    return F.when(het, F.struct(first.cast("int").alias("ref_hap"), second.cast("int").alias("alt_hap")))


def phased_pair(sample: Column) -> Column:
    """struct(ref_hap, alt_hap) of a sample column whose first field is a|b."""
    gt = F.split(F.get(F.split(sample, ":"), F.lit(0)), r"\|")
    return F.struct(F.get(gt, F.lit(0)).try_cast("int").alias("ref_hap"), F.get(gt, F.lit(1)).try_cast("int").alias("alt_hap"))


def info_ordinal(info: Column, place: int) -> Column:
    """The number behind = in the INFO entry at a place (from 0)."""
    return F.get(F.split(F.get(F.split(info, ";"), F.lit(place)), "="), F.lit(1)).try_cast("long")


def attributes(text: Column) -> Column:
    """GTF or GFF3 attributes as a map; of repeated keys the last one counts."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.struct(
        F.regexp_extract(x, r"^([^\s=]+)", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^\s=]+[\s=]*", "")), '"', "").alias("v")
    )
    pairs = F.transform(parts, pair)
    return last_entries(pairs)


def last_entries(pairs: Column) -> Column:
    """A map of structs (k, v) of strings; of equal keys the last one counts.
    The pairs are made once, however many there are."""
    none = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    return F.aggregate(pairs, none, lambda seen, p: F.map_concat(F.map_filter(seen, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def last_of(text: Column, tags: list[str], default: str = "*") -> Column:
    """The value of the last attribute whose key is one of tags."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: F.regexp_extract(x, r"^([^\s=]+)", 1).isin(*tags))
    value = F.regexp_replace(F.trim(F.regexp_replace(F.element_at(parts, -1), r"^[^\s=]+[\s=]*", "")), '"', "")
    return F.when(F.size(parts) > 0, value).otherwise(F.lit(default))
