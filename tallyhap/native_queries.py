"""Queries through the native formats: files are written from the sample tables
and read back by the real readers, and held against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters as A
from .functions import cigar, fields
from .operators import pileup, regions, variants
from .params import AlleleParams, DepthParams
from .plans import cli, counting
from .queries import FIRST, FRACTION, HAP, KEPT, MOLECULES, TOTALS, _lines, _pairs, query
from .session import shared_path, written_once
from .sinks import bam as bam_sink
from .sinks import tables
from .sources import bam, cells, mtx, sam, vcf
from .sources import regions as region_files

SEQUENCES = [(f"chr{k}", 30_000) for k in range(1, 6)]
#: Kind k of a read by its CIGAR: all of M, I, D, N, S, H, = and X occur.
_A, _K = "(25 + event_id % 37)", "CAST(event_id % 6 AS INT)"
_COLUMNS = f"""{_K} AS k, (event_id * 7919) % 20000 + 1 AS b1_start, CASE {_K} WHEN 4 THEN {_A} + 11 ELSE {_A} END AS b1_len,
    CASE {_K} WHEN 3 THEN 3 WHEN 5 THEN 50 ELSE 0 END AS gap, CASE {_K} WHEN 2 THEN 10 WHEN 3 THEN 10 WHEN 5 THEN 20 ELSE 0 END AS b2_len,
    CASE {_K} WHEN 1 THEN 5 ELSE 0 END AS q1, {_A} + CASE {_K} WHEN 2 THEN 2 ELSE 0 END AS q2,
    {_A} + CASE {_K} WHEN 1 THEN 5 WHEN 2 THEN 12 WHEN 3 THEN 10 WHEN 4 THEN 11 WHEN 5 THEN 26 ELSE 0 END AS n_query,
    CASE {_K} WHEN 0 THEN concat({_A}, 'M') WHEN 1 THEN concat('5S', {_A}, 'M') WHEN 2 THEN concat({_A}, 'M2I10M') WHEN 3 THEN concat({_A}, 'M3D10M')
        WHEN 4 THEN concat('4H', {_A}, '=1X10=') ELSE concat({_A}, 'M50N20M6S') END AS cigar"""
_VIEW = A.VIEWS["reads"].replace(A.VIEWS["reads"][A.VIEWS["reads"].index("(event_id * 7919)") : A.VIEWS["reads"].index("(event_id * 13)")], _COLUMNS + ",\n               ")
#: The base and the quality of query place q.
_BASE_AT, _QUAL_AT = "substr('ACGT', CAST((read_id * 7 + q * 3) % 4 + 1 AS INT), 1)", "(read_id + q) % 40"
_PLACE = "(CASE WHEN pos < b1_start + b1_len THEN q1 + pos - b1_start ELSE q2 + pos - (b1_start + b1_len + gap) END)"
_TEXT = f"""full_ AS (SELECT *, array_to_string(list_transform(range(0, n_query), lambda q: {_BASE_AT}), '') AS seq,
    array_to_string(list_transform(range(0, n_query), lambda q: chr(CAST(33 + {_QUAL_AT} AS INT))), '') AS qual FROM reads)"""


def _sql(*ctes: str) -> str:
    """The views' WITH clause, with these reads."""
    return A.sql_prelude(*ctes).replace(A.VIEWS["reads"].format(events="events"), _VIEW.format(events="events"))


def native(sql: str, *ctes: str):
    return query(_sql(*ctes) + sql, prelude=False)


# -- files ----------------------------------------------------------------------
_made: dict[tuple, str] = {}


def _file(spark: SparkSession, d: str, name: str, make) -> str:
    """A file of these tables, written once per session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _made:
        path = f"{shared_path(spark, 'native')}/{name}"
        make(path)
        _made[key] = path
    return _made[key]


def _reads(spark: SparkSession, d: str) -> DataFrame:
    r = spark.sql(_VIEW.format(events="{events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    each = F.sequence(F.lit(0).cast("long"), F.col("n_query") - 1)
    seq = F.array_join(F.transform(each, lambda q: F.substr(F.lit("ACGT"), ((F.col("read_id") * 7 + q * 3) % 4 + 1).cast("int"), F.lit(1))), "")
    qual = F.array_join(F.transform(each, lambda q: F.chr(33 + (F.col("read_id") + q) % 40)), "")
    tags = F.map_filter(F.create_map(F.lit("CB"), "cell", F.lit("UB"), "umi"), lambda k, v: v.isNotNull())
    return r.select("file_idx", F.col("read_id").alias("rec_idx"), F.concat(F.lit("r"), "read_id").alias("qname"), F.col("flag").cast("int").alias("flag"), "chrom", F.col("b1_start").alias("pos"), F.col("mapq").cast("int").alias("mapq"), "cigar", seq.alias("seq"), qual.alias("qual"), tags.alias("tags"))


def _bams(spark: SparkSession, d: str) -> list[str]:
    own = lambda k: _reads(spark, d).where(F.col("file_idx") == k)
    return [_file(spark, d, f"reads{k}.bam", lambda path, k=k: bam_sink.write_bam(own(k), path, SEQUENCES)) for k in (0, 1)]


def _cells(spark: SparkSession, d: str) -> str:
    return _file(spark, d, "cells.txt", lambda path: tables.write_lines(A.cells(spark), path))


def _regions(spark: SparkSession, d: str) -> str:
    r = A.regions(spark, d).orderBy("region_idx").select("chrom", "start", F.col("end_excl") - 1, "name")
    return _file(spark, d, "regions.tsv", lambda path: tables.write_lines(r, path))


_HEAD = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"]


def _vcf(spark: SparkSession, d: str) -> str:
    s = A.snps(spark, d)
    gt = F.concat(F.col("ref_hap").cast("string"), F.lit("|"), F.col("alt_hap").cast("string"))
    rows = s.select(F.col("snp_idx").alias("line_no"), F.concat(F.lit("chr"), "chrom").alias("CHROM"), F.col("pos").alias("POS"), F.lit(".").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), F.concat(F.lit("N="), "snp_idx").alias("INFO"), F.lit("DP:GT").alias("FORMAT"), F.concat(F.lit("7:"), gt).alias("s"))
    return _file(spark, d, "snps.vcf.gz", lambda path: tables.write_vcf(rows, _HEAD, path))


def _fasta(spark: SparkSession, d: str) -> str:
    def make(path: str) -> None:
        rows = [(c, k) for c in range(1, 6) for k in range(-1, 350)]  # so that a position's base goes by its last digit
        v = F.when(F.col("k") < 0, F.concat(F.lit(">"), "c", F.lit(" a contig"))).otherwise(F.lit(("ATTACACGTG" * 6)))
        tables.write_lines(spark.createDataFrame(rows, "c int, k int").orderBy("c", "k").select(v), path)

    return _file(spark, d, "genome.fa", make)


# -- alignments -------------------------------------------------------------------
_ROWS = "SELECT read_id, CAST(flag AS BIGINT) AS flag, chrom, CAST(b1_start AS BIGINT) AS pos, CAST(mapq AS BIGINT) AS mapq, cigar, seq, qual, cell, umi FROM full_"


def _columns(r: DataFrame) -> DataFrame:
    return r.select(F.substring("qname", 2, 20).cast("long").alias("read_id"), F.col("flag").cast("long").alias("flag"), "chrom", "pos", F.col("mapq").cast("long").alias("mapq"), "cigar", "seq", "qual", F.col("tags")["CB"].alias("cell"), F.col("tags")["UB"].alias("umi"))


@native(_ROWS, _TEXT)
def native_sam_reads(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, d, "reads.sam", lambda path: bam_sink.write_sam(_reads(spark, d), path, SEQUENCES))
    return _columns(sam.read_sam(spark, [path]))


@native(_ROWS, _TEXT)
def native_bam_reads(spark: SparkSession, d: str) -> DataFrame:
    """By pieces that begin at the index's records."""
    return _columns(bam.read_bam(spark, _bams(spark, d), split_bytes=20_000))


@native("SELECT read_id, file_idx FROM reads WHERE chrom = 'chr2' AND b1_start <= 9000 AND b1_start + b1_len + gap + b2_len > 5001")
def native_bam_region(spark: SparkSession, d: str) -> DataFrame:
    return bam.read_bam(spark, _bams(spark, d), region="chr2:5001-9000").select(F.substring("qname", 2, 20).cast("long").alias("read_id"), "file_idx")


@native("SELECT file_idx, count(*) AS n FROM reads WHERE mapq >= 20 AND (flag & 772) = 0 GROUP BY file_idx")
def native_bam_filters(spark: SparkSession, d: str) -> DataFrame:
    return bam.read_bam(spark, _bams(spark, d), 20, 772).groupBy("file_idx").agg(F.count("*").alias("n"))


@native("""SELECT read_id, CAST(b1_len + b2_len AS BIGINT) AS aligned, CAST(b1_start + b1_len + gap + b2_len AS BIGINT) AS end_excl, CASE WHEN b2_len > 0 AND k <> 4 THEN 2 WHEN k = 4 THEN 3 ELSE 1 END AS n_blocks,
    substr(seq, q1 + 1, b1_len) || substr(seq, q2 + 1, b2_len) AS bases,
    CAST(list_sum(list_transform(list_concat(range(q1, q1 + b1_len), range(q2, q2 + b2_len)), lambda q: (read_id + q) % 40)) AS BIGINT) AS quality FROM full_""", _TEXT)
def native_cigar_blocks(spark: SparkSession, d: str) -> DataFrame:
    r = sam.with_keys(bam.read_bam(spark, _bams(spark, d)), "CB", "UB")
    b = F.col("blocks")
    total = F.aggregate(cigar.query_qualities(b, F.col("qual")), F.lit(0).cast("long"), lambda s, x: s + x)
    return r.select(F.substring("qname", 2, 20).cast("long").alias("read_id"), cigar.aligned_length(b).alias("aligned"), "end_excl", F.size(b).alias("n_blocks"), F.array_join(cigar.query_bases(b, F.col("seq")), "").alias("bases"), total.alias("quality"))


_INSIDE = "((s.pos >= r.b1_start AND s.pos < r.b1_start + r.b1_len) OR (r.b2_len > 0 AND s.pos >= r.b1_start + r.b1_len + r.gap AND s.pos < r.b1_start + r.b1_len + r.gap + r.b2_len))"


@native(f"""SELECT snp_idx, read_id, CASE WHEN inside THEN substr('ACGT', CAST((read_id * 7 + q * 3) % 4 + 1 AS INT), 1) END AS base, CAST(CASE WHEN inside THEN (read_id + q) % 40 END AS BIGINT) AS quality FROM (
    SELECT s.snp_idx, r.read_id, {_INSIDE} AS inside, {_PLACE} AS q FROM reads r JOIN snps s ON replace(r.chrom, 'chr', '') = s.chrom AND s.pos >= r.b1_start AND s.pos < r.b1_start + r.b1_len + r.gap + r.b2_len)""")
def native_base_at_snp(spark: SparkSession, d: str) -> DataFrame:
    r = sam.with_keys(bam.read_bam(spark, _bams(spark, d)), "CB", "UB").withColumn("rec_idx", F.substring("qname", 2, 20).cast("long"))
    each = [
        pileup.snp_reads(x, A.snps(spark, d), A.BIN).select("snp_idx", F.col("rec_idx").alias("read_id"), f(F.col("blocks"), F.col("seq"), F.col("p_pos")).cast(kind).alias(name))
        for x, f, kind, name in ((r, cigar.base_at, "string", "base"), (r.withColumn("seq", F.col("qual")), cigar.quality_at, "long", "quality"))
    ]
    return each[0].join(each[1], ["snp_idx", "read_id"])


# -- plans ------------------------------------------------------------------------
_BY_NAME = "(SELECT region_idx, name FROM regions) g USING (region_idx)"


def _wide(out: dict[str, DataFrame]) -> DataFrame:
    return out["counts"].join(out["features"].select("row", "name"), "row").join(out["cells"], "col")


@native(f"SELECT name, cell, n FROM (SELECT region_idx, cell, count(DISTINCT umi) AS n FROM pairs JOIN cells USING (cell) GROUP BY region_idx, cell) JOIN {_BY_NAME}", KEPT, _pairs("kept", FRACTION))
def native_depth_directory(spark: SparkSession, d: str) -> DataFrame:
    """Files in, a result directory out, and that read back."""
    out = shared_path(spark, "depth").removeprefix("file://")
    counting.count_features(spark, _bams(spark, d), _regions(spark, d), out, _cells(spark, d))
    return _wide(mtx.read_depth_dir(spark, out)).select("name", "cell", F.col("value").alias("n"))


_WELLS = "kept AS (SELECT * FROM reads WHERE mapq >= 20 AND (flag & 1796) = 0 AND NOT ((flag & 1) <> 0 AND (flag & 2) = 0) AND (b1_len + b2_len) >= 30)"


@native(f"SELECT name, CASE file_idx WHEN 0 THEN 'one' ELSE 'two' END AS cell, n FROM (SELECT region_idx, file_idx, count(DISTINCT read_id) AS n FROM pairs GROUP BY ALL) JOIN {_BY_NAME}", _WELLS, _pairs("kept", FRACTION))
def native_depth_of_samples(spark: SparkSession, d: str) -> DataFrame:
    out = shared_path(spark, "wells").removeprefix("file://")
    counting.count_features(spark, _bams(spark, d), _regions(spark, d), out, None, ["one", "two"], DepthParams(umi_tag="AUTO"))
    return _wide(mtx.read_depth_dir(spark, out)).select("name", "cell", F.col("value").alias("n"))


_AT = _PLACE.replace("pos <", "s.pos <").replace("+ pos -", "+ s.pos -")
_FIRST = FIRST.replace(FIRST[FIRST.index("THEN CASE WHEN (r.read_id") : FIRST.index("END AS base")], f"THEN substr('ACGT', CAST((r.read_id * 7 + {_AT} * 3) % 4 + 1 AS INT), 1) ")
_NATIVE_HAP = (KEPT, _FIRST, TOTALS, MOLECULES, HAP)


@native(f"""SELECT name, cell, layer, CAST(value AS BIGINT) AS value FROM (UNPIVOT (SELECT region_idx, cell, ad AS AD, dp AS DP, oth AS OTH FROM hap WHERE dp > 0 OR oth > 0) ON AD, DP, OTH INTO NAME layer VALUE value)
    JOIN {_BY_NAME} WHERE value > 0""", *_NATIVE_HAP)
def native_allele_directory(spark: SparkSession, d: str) -> DataFrame:
    out = shared_path(spark, "alleles").removeprefix("file://")
    counting.count_alleles(spark, _bams(spark, d), _regions(spark, d), vcf.read_phased_vcf(spark, _vcf(spark, d)), out, _cells(spark, d))
    return _wide(mtx.read_allele_dir(spark, out)).select("name", "cell", "layer", "value")


_PLP = "plp AS (SELECT snp_idx, cell, count(*) FILTER (allele = alt) AS ad, count(*) FILTER (allele IN (ref, alt)) AS dp, count(*) FILTER (allele NOT IN (ref, alt)) AS oth FROM first WHERE allele IS NOT NULL GROUP BY snp_idx, cell)"
_GOOD = "good AS (SELECT snp_idx FROM plp GROUP BY snp_idx HAVING sum(dp) >= 2 AND sum(ad) * 1.0 / sum(dp) >= 0.1 AND sum(ad) * 1.0 / sum(dp) <= 0.9)"


@native("SELECT chrom, CAST(pos AS BIGINT) AS pos, cell, ad, dp, oth, CASE WHEN ad = 0 THEN '0/0' WHEN ad = dp THEN '1/1' ELSE '0/1' END AS gt FROM plp JOIN good USING (snp_idx) JOIN snps USING (snp_idx)", KEPT, _FIRST, _PLP, _GOOD)
def native_pileup_directory(spark: SparkSession, d: str) -> DataFrame:
    snps, counts = counting.pileup_snps(spark, _bams(spark, d), vcf.read_phased_vcf(spark, _vcf(spark, d)), _cells(spark, d), min_count=2, min_maf=0.1)
    from .operators.matrices import column_index, numbered

    columns = column_index(cells.read_barcodes(spark, _cells(spark, d)))
    found = numbered(snps, "snp_idx", "row")
    rows = found.select("row", F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), F.lit(".").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), F.lit(".").alias("INFO"))
    coo = counts.join(found.select("snp_idx", "row"), "snp_idx").join(columns, "cell")
    gt = F.when(F.col("ad") == 0, "0/0").when(F.col("ad") == F.col("dp"), "1/1").otherwise("0/1")
    out = shared_path(spark, "pileup").removeprefix("file://")
    tables.write_pileup_dir(out, rows, ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"], columns, coo.select("row", "col", "ad", "dp", "oth"), coo.select("row", "col", gt.alias("v")))
    back = vcf.read_pileup_dir(spark, out, genotypes=True)
    both = back["counts"].join(back["features"].select("row", F.col("CHROM").alias("chrom"), F.col("POS").alias("pos")), "row").join(back["cells"], "col").join(back["genotypes"], ["row", "col"])
    return both.select("chrom", "pos", "cell", "ad", "dp", "oth", F.col("entries")["GT"].alias("gt"))


# -- variants and genomes -----------------------------------------------------------
_SNPS = "SELECT chrom, CAST(pos AS BIGINT) AS pos, ref, alt, ref_hap, alt_hap FROM snps"


@native(_SNPS)
def native_phased_vcf(spark: SparkSession, d: str) -> DataFrame:
    return vcf.read_phased_vcf(spark, _vcf(spark, d)).drop("snp_idx")


@native(_SNPS)
def native_snp_tsv(spark: SparkSession, d: str) -> DataFrame:
    s = A.snps(spark, d).orderBy("snp_idx").select(F.concat(F.lit("chr"), "chrom"), "pos", F.lower("ref"), "alt", "ref_hap", "alt_hap")
    path = _file(spark, d, "snps.tsv", lambda path: tables.write_lines(s, path, ["chrom\tpos\tref\talt\tref_hap\talt_hap"]))
    return vcf.read_snp_tsv(spark, path).drop("snp_idx")


@native("SELECT 'chr' || chrom AS chrom, CAST(pos AS BIGINT) AS pos, ref, alt, CAST(snp_idx AS STRING) AS n, ref_hap || '|' || alt_hap AS gt FROM snps")
def native_vcf_columns(spark: SparkSession, d: str) -> DataFrame:
    v, _ = vcf.read_vcf(spark, _vcf(spark, d))
    return v.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), fields.last_of(F.col("INFO"), ["N"]).alias("n"), fields.format_field(F.col("FORMAT"), F.col("s")).alias("gt"))


@native("SELECT c AS chrom, CAST(count(snp_idx) AS BIGINT) AS n FROM (SELECT unnest(['1', '2', '3', '4', '5', '6']) AS c) LEFT JOIN snps ON chrom = c GROUP BY c")
def native_vcf_by_chrom(spark: SparkSession, d: str) -> DataFrame:
    v, header = vcf.read_vcf(spark, _vcf(spark, d))
    prefix, chroms = f"{shared_path(spark, 'chroms').removeprefix('file://')}/part", [str(k) for k in range(1, 7)]
    tables.write_chrom_vcfs(v, header, prefix, chroms)
    each = [vcf.read_vcf(spark, f"{prefix}.{c}.vcf.gz")[0].agg(F.lit(c).alias("chrom"), F.count("*").alias("n")) for c in chroms]
    return variants.merge_variants(each)


@native("""SELECT CAST(row_number() OVER (ORDER BY chrom, pos, ref, alt) AS BIGINT) AS place, chrom, CAST(pos AS BIGINT) AS pos, ref, alt FROM (
    SELECT CAST(p_partkey % 5 + 1 AS STRING) AS chrom, p_partkey * 53 % 20000 + 1 AS pos, substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS ref, substr('CGTA', CAST(p_partkey % 4 + 1 AS INT), 1) AS alt FROM part CROSS JOIN range(4))""")
def native_variants_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Two tables merged in order of their key, as written."""
    v = _lines(spark, d)
    merged = variants.merge_variants([v, v], sort=True).withColumn("line_no", F.monotonically_increasing_id())
    path = f"{shared_path(spark, 'merged').removeprefix('file://')}/merged.vcf.gz"
    tables.write_vcf(merged, ["#CHROM\tPOS\tREF\tALT\tINFO"], path)
    back, _ = vcf.read_vcf(spark, path)
    from .operators.matrices import numbered

    return numbered(back, "line_no", "place").select("place", F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"))


@native("SELECT CAST(c AS STRING) AS chrom, k AS chunk_no, substr(repeat('ATTACACGTG', 2100), CAST(k * 999 + 1 AS INT), CAST(least(999, 21000 - k * 999) AS INT)) AS seq FROM (SELECT unnest(range(1, 6)) AS c) CROSS JOIN (SELECT unnest(range(0, 22)) AS k)")
def native_fasta(spark: SparkSession, d: str) -> DataFrame:
    return region_files.read_fasta(spark, _fasta(spark, d), 999)


#: Sites with a genotype of their own; every eleventh has an allele of two bases and is skipped.
_FIX = """site AS (SELECT snp_idx, chrom, CAST(pos AS BIGINT) AS pos, ref, CASE WHEN snp_idx % 11 = 0 THEN 'AT' ELSE alt END AS alt, substr('GATTACACGT', CAST(pos % 10 + 1 AS INT), 1) AS fasta FROM snps)"""


@native("""SELECT chrom, pos, CASE WHEN ref = fasta THEN ref ELSE fasta END AS ref,
    CASE WHEN ref = fasta THEN alt WHEN alt = fasta THEN ref ELSE ref || ',' || alt END AS alt,
    CASE WHEN ref = fasta THEN '0|1' WHEN alt = fasta THEN '1|0' ELSE '1|2' END AS gt, ref || ',' || alt AS oal FROM site WHERE alt <> 'AT'""", _FIX)
def native_fixref_command(spark: SparkSession, d: str) -> DataFrame:
    s = A.snps(spark, d)
    alt = F.when(F.col("snp_idx") % 11 == 0, "AT").otherwise(F.col("alt"))
    dot = lambda name: F.lit(".").alias(name)
    rows = s.select(F.col("snp_idx").alias("line_no"), F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), dot("ID"), F.col("ref").alias("REF"), alt.alias("ALT"), dot("QUAL"), dot("FILTER"), dot("INFO"), F.lit("GT").alias("FORMAT"), F.lit("0|1").alias("s"))
    path = _file(spark, d, "sites.vcf", lambda path: tables.write_vcf(rows, _HEAD, path))
    out = f"{shared_path(spark, 'fixed').removeprefix('file://')}/fixed.vcf"
    cli.main(["fixref", "-i", path, "-r", _fasta(spark, d), "-o", out])
    v, _ = vcf.read_vcf(spark, out)
    return v.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), fields.format_field(F.col("FORMAT"), F.col("s")).alias("gt"), fields.last_of(F.col("INFO"), ["OAL"]).alias("oal"))


# -- regions and genes --------------------------------------------------------------
@native("SELECT chrom, CAST(start AS BIGINT) AS start, CAST(end_excl AS BIGINT) AS end_excl, name FROM regions")
def native_region_tsv(spark: SparkSession, d: str) -> DataFrame:
    return region_files.read_regions(spark, _regions(spark, d)).drop("region_idx")


@native("""SELECT chrom, CAST(start AS BIGINT) AS start, CAST(end_excl - 1 AS BIGINT) AS "end", chrom || ':' || start || '-' || (end_excl - 1) AS label FROM regions""")
def bed_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """TSV to BED by the command, and back by the reader."""
    out = f"{shared_path(spark, 'bed').removeprefix('file://')}/regions.bed"
    cli.main(["convert", "-i", _regions(spark, d), "-I", "tsv", "-o", out, "-O", "bed"])
    return region_files.read_intervals(spark, out, "bed").drop("region_idx")


@native("SELECT CAST(row_number() OVER (ORDER BY chrom, start, end_excl, name) AS BIGINT) AS place, chrom, CAST(start AS BIGINT) AS start, CAST(end_excl AS BIGINT) AS end_excl FROM regions")
def native_sorted_regions(spark: SparkSession, d: str) -> DataFrame:
    from .operators.matrices import numbered

    path = f"{shared_path(spark, 'sorted').removeprefix('file://')}/regions.tsv"
    r = regions.sort_regions(A.regions(spark, d))
    tables.write_lines(r.select("chrom", "start", F.col("end_excl") - 1, "name"), path)
    return numbered(region_files.read_regions(spark, path), "region_idx", "place").select("place", "chrom", "start", "end_excl")


#: A gene with two transcripts of p_size % 4 + 1 and one exon; every third lies on the minus strand.
_GENES = """SELECT 'G' || p_partkey AS gene_id, CASE WHEN p_partkey % 5 = 0 THEN '*' ELSE p_brand END AS name, CAST(p_partkey * 1000 AS BIGINT) AS start, CAST(p_partkey * 1000 + 900 AS BIGINT) AS "end",
    CAST(3 AS BIGINT) AS n_transcripts, CAST(p_size % 4 + 1 AS BIGINT) AS max_exons, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand,
    CASE WHEN p_partkey % 3 = 0 THEN list_reverse(list_transform(range(0, p_size % 4 + 1), lambda j: p_partkey * 1000 + 10 + j * 50)) ELSE list_transform(range(0, p_size % 4 + 1), lambda j: p_partkey * 1000 + 10 + j * 50) END::VARCHAR AS starts,
    list_sum(list_transform(range(0, p_size % 4 + 1), lambda j: 20)) + (p_size % 4) * 30 AS spliced FROM part"""


def _genes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    at, minus = F.col("p_partkey") * 1000, F.col("p_partkey") % 3 == 0
    exons = F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda j: F.struct((at + 10 + j * 50).cast("long").alias("start"), (at + 29 + j * 50).cast("long").alias("end")))
    exons = F.when(minus, F.reverse(exons)).otherwise(exons)
    one = F.array(F.struct((at + 400).cast("long").alias("start"), (at + 450).cast("long").alias("end")))
    tran = lambda k, a, b, x: F.struct(F.lit(k).cast("long").alias("line_no"), F.concat(F.lit(f"T{k}."), F.col("p_partkey").cast("string")).alias("tran_id"), a.cast("long").alias("start"), b.cast("long").alias("end"), x.alias("exons"))
    genes = p.select(
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_id"), F.when(F.col("p_partkey") % 5 == 0, "*").otherwise(F.col("p_brand")).alias("name"), F.lit("1").alias("chrom"), F.when(minus, "-").otherwise("+").alias("strand"),
        at.cast("long").alias("start"), (at + 900).cast("long").alias("end"), F.col("p_partkey").alias("line_no"), F.array(tran(1, at + 10, at + 210, exons), tran(2, at + 400, at + 450, one)).alias("transcripts"),
    )
    path = _file(spark, d, f"genes.{kind}", lambda path: tables.write_genes(genes, path, kind))
    back = written_once(region_files.read_genes(spark, path), "genes")  # both tables below come from it
    info = region_files.gene_info(region_files.with_premrna(back)).select("gene_id", "name", "start", "end", F.col("n_transcripts").cast("long").alias("n_transcripts"), F.col("max_exons").cast("long").alias("max_exons"), "strand")
    first = back.select("gene_id", F.filter("transcripts", lambda t: t["tran_id"].startswith("T1."))[0]["exons"].alias("x"))
    starts = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["start"].cast("string")), ", "), F.lit("]"))
    spliced = F.aggregate(region_files.exon_segments(F.col("x")), F.lit(0).cast("long"), lambda s, n: s + n)
    return info.join(first.select("gene_id", starts.alias("starts"), spliced.alias("spliced")), "gene_id")


@native(_GENES)
def native_genes_gtf(spark: SparkSession, d: str) -> DataFrame:
    return _genes(spark, d, "gtf")


@native(_GENES)
def native_genes_gff3(spark: SparkSession, d: str) -> DataFrame:
    return _genes(spark, d, "gff3")


@native("SELECT CAST(p_partkey AS BIGINT) AS row, CAST(p_partkey % 7 + 1 AS BIGINT) AS col, CAST(p_size AS BIGINT) AS value, CAST((SELECT max(p_partkey) FROM part) AS BIGINT) AS n_rows, CAST(7 AS BIGINT) AS n_cols, CAST((SELECT count(*) FROM part) AS BIGINT) AS n FROM part")
def native_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    coo = p.select(F.col("p_partkey").alias("row"), (F.col("p_partkey") % 7 + 1).alias("col"), F.col("p_size").cast("long").alias("value"))
    path = f"{shared_path(spark, 'matrix').removeprefix('file://')}/m.mtx"
    tables.write_mtx(coo, path, p.agg(F.max("p_partkey")).first()[0], 7)
    n_rows, n_cols, n = (F.lit(x).cast("long") for x in mtx.mtx_shape(spark, path))
    return mtx.read_mtx(spark, path).select("row", "col", "value", n_rows.alias("n_rows"), n_cols.alias("n_cols"), n.alias("n"))


@native("SELECT cell, CAST(row_number() OVER (ORDER BY cell) AS BIGINT) AS cell_idx, (SELECT count(DISTINCT umi) FROM reads r WHERE r.cell = cells.cell AND r.mapq >= 20) AS n FROM cells")
def native_barcodes(spark: SparkSession, d: str) -> DataFrame:
    listed = cells.read_barcodes(spark, _cells(spark, d))
    r = sam.with_keys(bam.read_bam(spark, _bams(spark, d), 20), "CB", "UB")
    return listed.join(r.groupBy("cell").agg(F.count_distinct("umi").alias("n")), "cell", "left").select("cell", "cell_idx", F.coalesce("n", F.lit(0)).alias("n"))
