"""Synthetic reads, SNPs, regions and cells over the sample tables, in SQL that
Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cigar import cigar_blocks, ref_end

#: Views in order of need; {events} and {part} are the tables they read.
VIEWS = {
    "reads": """
        SELECT event_id AS read_id, CAST(event_id % 2 AS INT) AS file_idx,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'C' || lpad(CAST(user_id % 8 AS STRING), 3, '0') END AS cell,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'U' || lpad(CAST((event_id * 37) % 211 % 5 AS STRING), 3, '0') END AS umi,
               'chr' || CAST((event_id % 5) + 1 AS STRING) AS chrom, (event_id * 7919) % 20000 + 1 AS b1_start, 25 + event_id % 37 AS b1_len,
               CASE WHEN event_id % 4 = 0 THEN 30 + event_id % 300 ELSE 0 END AS gap, CASE WHEN event_id % 4 = 0 THEN 20 + event_id % 23 ELSE 0 END AS b2_len,
               (event_id * 13) % 61 AS mapq,
               CASE WHEN event_id % 11 = 0 THEN 4 WHEN event_id % 11 = 1 THEN 256 WHEN event_id % 11 = 2 THEN 1024 WHEN event_id % 11 = 3 THEN 1
                    WHEN event_id % 11 = 4 THEN 3 WHEN event_id % 11 = 5 THEN 512 ELSE 16 * (event_id % 2) END AS flag
        FROM {events}""",
    "snps": """
        SELECT p_partkey AS snp_idx, chrom, pos, ref, alt, ref_hap, 1 - ref_hap AS alt_hap FROM (
            SELECT p_partkey, CAST(p_partkey % 5 + 1 AS STRING) AS chrom, (p_partkey * 53) % 20000 + 1 AS pos,
                   substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS ref, substr('CGTA', CAST(p_partkey % 4 + 1 AS INT), 1) AS alt,
                   CAST(p_partkey % 7 % 2 AS INT) AS ref_hap,
                   row_number() OVER (PARTITION BY p_partkey % 5, (p_partkey * 53) % 20000 ORDER BY p_partkey) AS k
            FROM {part}) x WHERE k = 1""",
    "regions": """
        SELECT p_partkey AS region_idx, CAST(p_partkey % 7 % 5 + 1 AS STRING) AS chrom, (p_partkey * 389) % 20000 + 1 AS start,
               (p_partkey * 389) % 20000 + p_size * 20 + 1 AS end_excl, 'G' || lpad(CAST(p_partkey AS STRING), 6, '0') AS name
        FROM {part} WHERE p_partkey % 4 = 0""",
}
CELLS = tuple(f"C{k:03d}" for k in range(7))
REFERENCE_CELLS = ("C000", "C001")
SAMPLES = ("Sample0", "Sample1")
#: The base that a read shows at a SNP inside one of its blocks.
BASE = "CASE WHEN (read_id * 3 + pos) % 10 < 4 THEN ref WHEN (read_id * 3 + pos) % 10 < 9 THEN alt ELSE substr('GTAC', CAST(instr('ACGT', ref) AS INT), 1) END"
BIN = 1000


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = "events" if name == "reads" else "part"
    return spark.sql(VIEWS[name].format(events="{events}", part="{part}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the engine takes them: with CIGAR, aligned blocks and span."""
    r = view(spark, sf_dir, "reads")
    tail = F.when(F.col("b2_len") > 0, F.concat(F.col("gap").cast("string"), F.lit("N"), F.col("b2_len").cast("string"), F.lit("M"))).otherwise("")
    r = r.withColumn("cigar", F.concat(F.col("b1_len").cast("string"), F.lit("M"), tail)).withColumn("pos", F.col("b1_start"))
    r = r.withColumn("blocks", cigar_blocks(F.col("cigar"), F.col("pos"))).withColumn("end_excl", ref_end(F.col("cigar"), F.col("pos")))
    return r.select("file_idx", F.col("read_id").alias("rec_idx"), F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("qname"), "cell", "umi", "chrom", "pos", "end_excl", "mapq", "flag", "cigar", "blocks")


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "snps")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "regions")


def cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in CELLS], "cell string")


def snp_base():
    """BASE inside a block, null in the intron; over columns of a pileup."""
    inside = F.exists("blocks", lambda b: (F.col("p_pos") >= b["s"]) & (F.col("p_pos") < b["e"]))
    k = (F.col("rec_idx") * 3 + F.col("p_pos")) % 10
    other = F.substr(F.lit("GTAC"), F.instr(F.lit("ACGT"), F.col("ref")), F.lit(1))
    return F.when(inside, F.when(k < 4, F.col("ref")).when(k < 9, F.col("alt")).otherwise(other))


def sql_prelude(*more: str) -> str:
    """WITH clause of the views, for the oracle."""
    parts = [f"{name} AS ({sql.format(events='events', part='part')})" for name, sql in VIEWS.items()]
    parts.append("cells AS (SELECT unnest(['" + "', '".join(CELLS) + "']) AS cell)")
    return "WITH " + ",\n".join([*parts, *more]) + "\n"
