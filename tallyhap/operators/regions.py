"""Region sets: fixed bins, conversion, lookup and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chrom import region_id, region_label

#: Chromosome lengths, 1 to 22, X and Y.
CHROMS = (*map(str, range(1, 23)), "X", "Y")
LENGTHS = {
    "hg19": (249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895,
             115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566),
    "hg38": (248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309,
             114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415),
}


def bins_of_lengths(spark: SparkSession, lengths: list[tuple[str, int]], width: int) -> DataFrame:
    """chrom, start, end (inclusive; the last bin isn't clipped), label."""
    if width <= 0:
        raise ValueError("the bin width must be positive")
    df = spark.createDataFrame([(k, c, n) for k, (c, n) in enumerate(lengths)], "chrom_no int, chrom string, length long")
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / width) - 1)).alias("i")
    out = df.where("length > 0").select("chrom_no", "chrom", i).select("chrom_no", "chrom", (F.col("i") * width + 1).alias("start"), ((F.col("i") + 1) * width).alias("end"))
    return out.withColumn("label", region_label(F.col("chrom"), F.col("start"), F.col("end")))


def fixed_bins(spark: SparkSession, build: str, width_kb: int) -> DataFrame:
    if build not in LENGTHS:
        raise ValueError(f"unknown genome build {build}")
    return bins_of_lengths(spark, list(zip(CHROMS, LENGTHS[build])), width_kb * 1000)


def header_bins(spark: SparkSession, names: list[str], sequences: dict[str, int], width: int) -> DataFrame:
    """Bins of named chromosomes by a SAM header's lengths, chr toggled if need be."""
    other = lambda c: c[3:] if c.startswith("chr") else f"chr{c}"
    found = [(c, sequences[c] if c in sequences else sequences[other(c)]) for c in names if c in sequences or other(c) in sequences]
    return bins_of_lengths(spark, found, width)


def query_region(regions: DataFrame, rid: str) -> DataFrame:
    return regions.where(region_id(F.col("name"), F.col("chrom"), F.col("start"), F.col("end_excl")) == rid)


def merge_regions(first: DataFrame, second: DataFrame, unique: bool = True) -> DataFrame:
    """Both sets; of equal ids the first set's region stays, then the lower index."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    if not unique:
        return both.drop("_s")
    rid = region_id(F.col("name"), F.col("chrom"), F.col("start"), F.col("end_excl"))
    w = Window.partitionBy("_rid").orderBy("_s", "region_idx")
    return both.withColumn("_rid", rid).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_s", "_k", "_rid")


def sort_regions(regions: DataFrame) -> DataFrame:
    return regions.orderBy("chrom", "start", "end_excl")

