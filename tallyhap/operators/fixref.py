"""Reference-allele repair: REF, ALT and GT held against the genome's bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGTN"


def lookup_base(sites: DataFrame, genome: DataFrame, chunk: int, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """sites with `fasta`, the genome's base there; genome: (chrom, chunk_no,
    seq) in chunks of fixed length, so the join is on equality."""
    at = F.col(pos) - 1
    chunks = genome.select(F.col("chrom").alias("_c"), F.col("chunk_no").alias("_k"), "seq")
    both = sites.join(chunks, (F.col(chrom) == F.col("_c")) & (F.floor(at / chunk) == F.col("_k")), "left")
    base = F.upper(F.substr("seq", (at % chunk + 1).cast("int"), F.lit(1)))
    return both.withColumn("fasta", F.when(base != "", base)).drop("_c", "_k", "seq")


def _valid(alleles: Column) -> Column:
    return (F.size(alleles) > 0) & F.forall(alleles, lambda a: a.rlike(f"^[{BASES}]$"))


def fix_reference(sites: DataFrame) -> DataFrame:
    """sites: alleles array<string> (REF first, upper case), gts
    array<array<string>> (allele numbers of each sample, `.` for missing),
    phased array<boolean>, fasta. Adds status (-1 skipped, 0 matching, 1 fixed),
    new_alleles, new_gts (strings), oal and ogts.

    Matching sites keep their alleles and genotypes. Others list the genome's
    base, then the alleles that genotypes use; unused ones vanish. At least two
    alleles are listed: the first of ACGTN that differs from REF fills up."""
    old, fasta, gts = F.col("alleles"), F.col("fasta"), F.col("gts")
    diploid = F.forall(gts, lambda g: F.size(g) == 2)
    ok = _valid(old) & fasta.isNotNull() & fasta.rlike(f"^[{BASES}]$") & gts.isNotNull() & diploid
    status = F.when(~F.coalesce(ok, F.lit(False)), -1).when(F.get(old, F.lit(0)) == fasta, 0).otherwise(1)
    numbers = F.transform(F.flatten(gts), lambda a: F.when(a != ".", a.cast("int")))
    used = F.filter(old, lambda a, i: F.exists(numbers, lambda n: n.isNotNull() & (n == i)))
    fixed = F.concat(F.array(fasta), F.filter(F.array_distinct(used), lambda a: a != fasta))
    listed = F.when(F.col("status") == 0, old).otherwise(fixed)
    spare = F.element_at(F.filter(F.array(*[F.lit(b) for b in BASES]), lambda b: b != F.get(listed, F.lit(0))), 1)
    padded = F.when(F.size(listed) < 2, F.concat(listed, F.array(spare))).otherwise(listed)
    out = sites.withColumn("status", status).withColumn("new_alleles", F.when(F.col("status") >= 0, padded))

    def renumber(a: Column) -> Column:
        allele = F.get(old, a.cast("int"))
        return F.when(a == ".", a).otherwise((F.array_position(F.col("new_alleles"), allele) - 1).cast("string"))

    joined = lambda arrays: F.zip_with(arrays, F.col("phased"), lambda g, p: F.when(p, F.array_join(g, "|")).otherwise(F.array_join(g, "/")))
    new = F.when(F.col("status") == 0, gts).when(F.col("status") == 1, F.transform(gts, lambda g: F.transform(g, renumber)))
    out = out.withColumn("new_gts", joined(new)).withColumn("ogts", F.when(F.col("status") >= 0, joined(gts)))
    return out.withColumn("oal", F.when(F.col("status") >= 0, F.array_join(old, ",")))


def status_counts(fixed: DataFrame) -> DataFrame:
    return fixed.groupBy("status").agg(F.count("*").alias("n"))
