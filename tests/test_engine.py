"""Micro fixtures, one per rule."""

import gzip
import math
import struct

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyhap import queries
from tallyhap.functions import alleles, chrom, cigar, fields
from tallyhap.operators import depth, fixref, haplotypes, intervals, kernels, phasing, pileup, regions, variants
from tallyhap.params import AlleleParams, CorrectionParams, DepthParams, PhaseParams, check_modes, resolve_umi_tag
from tallyhap.plans import cli, counting
from tallyhap.sinks import bam as bam_sink
from tallyhap.sinks import files, tables
from tallyhap.sources import bam, cells, mtx, sam, vcf
from tallyhap.sources import regions as region_files

READ = "file_idx int, rec_idx long, qname string, cell string, umi string, chrom string, pos long, mapq int, flag int, cigar string, seq string"


def reads(spark, rows):
    df = spark.createDataFrame(rows, READ)
    return df.withColumn("blocks", cigar.cigar_blocks(F.col("cigar"), F.col("pos"))).withColumn("end_excl", cigar.ref_end(F.col("cigar"), F.col("pos")))


def read(rec, pos, cig, umi="U1", cell="A", seq=None, flag=0, mapq=60, chrom_="chr1"):
    return (0, rec, f"r{rec}", cell, umi, chrom_, pos, mapq, flag, cig, seq)


def region_table(spark, rows):
    return spark.createDataFrame(rows, "region_idx long, chrom string, start long, end_excl long, name string")


def cell_table(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "cell string")


def snp_table(spark, rows):
    return spark.createDataFrame(rows, "snp_idx long, chrom string, pos long, ref string, alt string, ref_hap int, alt_hap int")


def test_cigar_blocks(spark):
    r = reads(spark, [read(1, 1000, "5S30M100N20M2D3I40M", seq="A" * 98)]).select("blocks", "end_excl").first()
    assert [(b.s, b.e, b.q) for b in r.blocks] == [(1000, 1030, 5), (1130, 1150, 35), (1152, 1192, 58)] and r.end_excl == 1192


def test_bases_and_qualities(spark):
    df = spark.createDataFrame([("2S3M1I2M", "nnACGtAA", "##!\"#$%&", 10)], "c string, s string, q string, p long")
    b = cigar.cigar_blocks(F.col("c"), F.col("p"))
    r = df.select(cigar.query_bases(b, F.col("s")), cigar.query_bases(b, F.col("s"), F.lit(8)), cigar.query_qualities(b, F.col("q")), cigar.base_at(b, F.col("s"), F.lit(13)), cigar.base_at(b, F.col("s"), F.lit(99))).first()
    assert r[0] == list("ACGAA") and r[1] == [None, None, "A", "C", "G", None, "A", "A"] and r[2] == [0, 1, 2, 4, 5] and r[3] == "A" and r[4] is None


def test_spliced_over_region_is_not_included(spark):
    r = reads(spark, [read(1, 601, "60M3140N40M")])
    g = region_table(spark, [(1, "1", 1000, 3001, "g")])
    assert depth.count_depth(r, g, cell_table(spark, "A")).count() == 0
    assert depth.count_depth(r, g, cell_table(spark, "A"), DepthParams(min_include=0)).count() == 1


@pytest.mark.parametrize("include,n", [(0.9, 1), (30, 2), (1.0, 3), (0, 3)])
def test_min_include_fraction_or_bases(spark, include, n):
    g = region_table(spark, [(1, "CHR1", 100, 200, "g")])
    r = reads(spark, [read(1, 110, "40M", "U1"), read(2, 165, "70M", "U2"), read(3, 195, "60M", "U3")])
    got = depth.count_depth(r, g, cell_table(spark, "A"), DepthParams(min_include=include)).collect()
    assert got[0].n == n


def test_flags_and_masks(spark):
    g = region_table(spark, [(1, "1", 100, 300, "g")])
    r = reads(spark, [read(k, 110, "40M", f"U{k}", flag=f) for k, f in enumerate((4, 256, 512, 1024, 1, 3))])
    assert depth.count_depth(r, g, cell_table(spark, "A")).first().n == 2  # 1024 and 3
    by_name = r.withColumn("umi", F.col("qname"))
    assert depth.count_depth(by_name, g, cell_table(spark, "A"), DepthParams(umi_tag=None)).first().n == 1
    assert depth.count_depth(r, g, cell_table(spark, "A"), DepthParams(excl_flag=0, no_orphan=False)).first().n == 6


def test_duplicate_names_and_long_regions(spark):
    g = region_table(spark, [(1, "1", 1, 100_000, "g"), (2, "1", 1, 100_000, "g"), (3, "2", 1, 5, "h")])
    r = reads(spark, [read(1, 9_990, "40M"), read(2, 50_000, "40M", "U2"), read(3, 10, "40M", "U3", cell="B")])
    got = {(x.region_idx, x.cell): x.n for x in depth.count_depth(r, g, cell_table(spark, "A")).collect()}
    assert got == {(1, "A"): 2, (2, "A"): 2}
    totals = {x.region_idx: x.total for x in depth.region_totals(depth.count_depth(r, g, cell_table(spark, "A")), g).collect()}
    assert totals == {1: 2, 2: 2, 3: 0}


def brute_depth(rows, regions_, p, by=lambda r: r.cell):
    """Distinct molecules of each region and cell, pair by pair."""
    out = {}
    for g in regions_:
        for r in rows:
            inside, n = (sum(max(0, min(b.e, e) - max(b.s, s)) for b in r.blocks) for s, e in ((g[2], g[3]), (0, 1 << 40)))
            enough = inside / n >= p.min_include if 0 < p.min_include < 1 else inside >= p.min_include
            if r.chrom == "chr" + g[1] and r.pos < g[3] and g[2] < r.end_excl and enough:
                out.setdefault((g[0], by(r)), set()).add(r.umi)
    return {k: len(v) for k, v in out.items()}


def random_reads(seed, n=400):
    r, forms = np.random.default_rng(seed), ("40M", "30M", "5S61M", "33M2I8M", "20M300N20M", "12M40N30M3D9M", "35M1200N25M")
    return [read(k, int(r.integers(1, 2500)), str(r.choice(forms)), f"U{r.integers(0, 60) if k % 2 else 100 + k}", str(r.choice(["A", "B"])), chrom_=str(r.choice(["chr1", "chr2"]))) for k in range(n)]


def random_regions(seed, n=60):
    r = np.random.default_rng(seed)
    some = [(k, str(r.choice(["1", "2"])), int(s := r.integers(1, 2800)), int(s + r.integers(1, (30, 80, 400, 2000)[k % 4])), "g") for k in range(n)]
    return some + [(n + k, *x[1:]) for k, x in enumerate(some[:20])]  # some extents twice


def held_against_pairs(spark, p, seed, edit=lambda r: r, cells_=None, by="cell"):
    r, g = edit(reads(spark, random_reads(seed))), random_regions(seed + 1)
    got = {(x.region_idx, x.cell): x.n for x in depth.count_depth(r, region_table(spark, g), cells_ or cell_table(spark, "A", "B"), p, 100, by=by).collect()}
    assert got and got == brute_depth(r.collect(), g, p, (lambda x: x.cell) if by == "cell" else (lambda x: f"S{x.file_idx}"))


@pytest.mark.parametrize("include", [0.9, 0.3])
def test_depth_with_all_regions_against_pairs(spark, include):
    held_against_pairs(spark, DepthParams(min_include=include), 11)


def test_molecule_meets_a_region_once(spark):
    """However many of its reads a region includes, and each extent once."""
    r = reads(spark, [read(k, 100 + k, "40M") for k in range(200)])
    for include in (0.9, 30, 0):
        p = DepthParams(min_include=include)
        g = region_table(spark, [(k, "1", 50, 400, "g") for k in range(30)])
        met = depth.molecule_regions(r, g.select("region_idx", F.col("chrom").alias("key"), "start", "end_excl").where("region_idx = 0"), p)
        assert met.count() == 1 and depth.count_depth(r, g, cell_table(spark, "A"), p).where("n = 1").count() == 30


def test_any_overlap_against_pairs(spark):
    held_against_pairs(spark, DepthParams(min_include=0), 12)


def test_wells_against_pairs(spark):
    """Reads of one name are one molecule of their file; most stand alone."""
    samples = spark.createDataFrame([(0, "S0"), (1, "S1")], "file_idx int, cell string")
    edit = lambda r: r.withColumn("file_idx", (F.col("rec_idx") % 2).cast("int")).withColumn("umi", F.concat(F.lit("q"), F.floor(F.col("rec_idx") / 3).cast("string"))).withColumn("cell", F.lit(None).cast("string"))
    held_against_pairs(spark, DepthParams(cell_tag=None, umi_tag=None), 13, edit, samples, "file_idx")


@pytest.mark.parametrize("include", [30, 1.0, 45])
def test_min_bases_against_pairs(spark, include):
    held_against_pairs(spark, DepthParams(min_include=include), 14)


def test_read_names_against_pairs(spark):
    held_against_pairs(spark, DepthParams(umi_tag=None), 15, lambda r: r.withColumn("umi", F.when(F.col("rec_idx") % 5 == 0, "mate").otherwise(F.col("qname"))))


def test_umis_of_many_reads_against_pairs(spark):
    held_against_pairs(spark, DepthParams(), 16, lambda r: r.withColumn("umi", F.concat(F.lit("U"), (F.col("rec_idx") % 3).cast("string"))))


def dense_pileup(spark, seed=31):
    """Reads of few molecules over many SNPs, in two files, and the SNPs."""
    r = np.random.default_rng(seed)
    rows = [(int(r.integers(0, 2)), k, f"r{k}", str(r.choice(["A", "B"])), f"U{r.integers(0, 3)}", str(r.choice(["chr1", "2"])), int(r.integers(1, 1500)), 60, 0, str(r.choice(["40M", "20M200N20M", "10M5D30M"])), "".join(r.choice(list("ACGT"), 40))) for k in range(300)]
    places = sorted({(str(r.choice(["1", "2"])), int(x)) for x in r.integers(1, 1700, 250)})
    return reads(spark, rows), [(k, c, x, "A", "C", k % 2, 1 - k % 2) for k, (c, x) in enumerate(places)]


def test_first_alleles_against_all_reads(spark):
    r, snps = dense_pileup(spark)
    all_reads = sorted(r.collect(), key=lambda x: (x.file_idx, x.pos, x.rec_idx))
    want = {}
    for k, c, at, *_ in snps:
        for x in all_reads:
            if x.chrom.removeprefix("chr") == c and x.pos <= at < x.end_excl:
                b = [x.seq[b.q + at - b.s] for b in x.blocks if b.s <= at < b.e]
                want.setdefault((k, x.cell, x.umi), b[0] if b else None)
    got = pileup.first_alleles(r, snp_table(spark, snps), cell_table(spark, "A", "B"), width=100)
    assert {(x.snp_idx, x.cell, x.umi): x.allele for x in got.collect()} == want and None in want.values()
    spans = pileup.first_spans(r)
    assert pileup.point_join(spans, pileup.snp_points(snp_table(spark, snps)), 100).count() <= 2 * len(want)  # once a file


@pytest.mark.parametrize("no_dup", [True, False])
def test_haplotypes_against_all_snps(spark, no_dup):
    r, snps = dense_pileup(spark, 32)
    g, s = region_table(spark, random_regions(33)), snp_table(spark, snps)
    first = pileup.first_alleles(r, s, cell_table(spark, "A", "B"))
    key = lambda df: sorted(map(tuple, df.select("region_idx", "cell", "ad", "dp", "oth").collect()))
    want = key(haplotypes.haplotype_counts(haplotypes.molecules(first, haplotypes.region_snps(g, s)), no_dup))
    assert want and key(haplotypes.count_haplotypes(first, None, g, s, AlleleParams(no_dup_hap=no_dup), 100)) == want


def test_range_meets_a_molecule_once_a_haplotype(spark):
    s = [(k, "1", 100 + k, "A", "C", 0, 1) for k in range(50)]
    first = spark.createDataFrame([(k, "A", "U", "AC"[k % 2]) for k in range(50)], "snp_idx long, cell string, umi string, allele string")
    extent, same = intervals.extents(region_table(spark, [(k, "chr1", 90, 200, "g") for k in range(20)]))
    assert extent.count() == 1 and same.count() == 20
    assert haplotypes.extent_marks(first, snp_table(spark, s), extent).count() == 2
    assert [tuple(x)[3:] for x in haplotypes.extent_molecules(first, snp_table(spark, s), extent).collect()] == [(True, True, False)]


def test_snp_shares_are_those_of_regions(spark):
    s = snp_table(spark, [(k, "1", 100 + k, "A", "C", k % 2, 1 - k % 2) for k in range(4)])
    counts = spark.createDataFrame([(k, c, k % 3, 3 if k else 0, 0) for k in range(4) for c in "AB"], "snp_idx long, cell string, ad long, dp long, oth long")
    phase = phasing.phase_input(haplotypes.region_snps(region_table(spark, [(9, "1", 100, 110, "g")]), s), counts)
    want = {x.snp_idx: x.z0 for x in phase.groupBy("snp_idx").agg((F.sum("ad") / F.sum("dp")).alias("z0")).collect()}
    assert {x.snp_idx: x.z0 for x in phasing.snp_shares(s, counts).collect()} == want and len(want) == 3


SNPS = [(1, "1", 130, "A", "C", 0, 1), (2, "1", 140, "A", "C", 0, 1)]


def test_regions_of_one_extent_meet_a_read_once(spark):
    r = np.random.default_rng(21)
    g = [(k, str(k % 2), int(a), int(a + 40 * (k % 5))) for k, a in enumerate(r.integers(1, 3000, 60))]
    g += [(100 + k, *g[7][1:]) for k in range(600)]
    x = [(k, str(k % 2), int(a), int(a + r.integers(1, 300))) for k, a in enumerate(r.integers(1, 3000, 200))]
    left, right = spark.createDataFrame(g, "id long, key string, start long, end_excl long"), spark.createDataFrame(x, "o long, o_key string, o_start long, o_end long")
    met = intervals.overlapping_ids(left, right, "id", 100)
    want = sorted((a[0], b[0]) for a in g for b in x if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3])
    assert sorted((p.id, p.o) for p in met.collect()) == want
    assert "_ids" in met._jdf.queryExecution().optimizedPlan().toString() and met.rdd.getNumPartitions() > 1


def test_first_read_wins_even_with_null(spark):
    r = reads(spark, [read(1, 100, "20M60N20M", seq="G" * 40), read(2, 110, "40M", seq="C" * 40), read(3, 111, "40M", "U2", seq="C" * 40)])
    first = pileup.first_alleles(r, snp_table(spark, SNPS[:1]), cell_table(spark, "A"))
    assert {(x.umi, x.allele) for x in first.collect()} == {("U1", None), ("U2", "C")}
    counts = pileup.base_counts(first).collect()
    assert len(counts) == 1 and counts[0].n_c == 1


def hap(spark, rows, p=AlleleParams(), flips=None):
    first = spark.createDataFrame(rows, "snp_idx long, cell string, umi string, allele string")
    snps = snp_table(spark, SNPS)
    g = region_table(spark, [(1, "1", 100, 200, "g")])
    passing = pileup.passing_snps(pileup.snp_totals(first, snps), p)
    return [(x.ad, x.dp, x.oth) for x in haplotypes.count_haplotypes(first, passing, g, snps, p, flips=flips).collect()]


def test_molecules_on_both_haplotypes(spark):
    rows = [(1, "A", "U1", "A"), (2, "A", "U1", "C"), (1, "A", "U2", "C"), (1, "A", "U3", "G"), (1, "A", "U4", "T"), (2, "A", "U4", "C")]
    assert hap(spark, rows) == [(2, 2, 1)]
    assert hap(spark, rows, AlleleParams(no_dup_hap=False)) == [(3, 4, 1)]
    assert hap(spark, [(1, "A", "U1", "A"), (2, "A", "U1", "C")]) == []


def test_flips_are_per_region_and_snp(spark):
    flips = spark.createDataFrame([(1, 1, 1)], "region_idx long, snp_idx long, flip int")
    rows = [(1, "A", "U1", "A"), (2, "A", "U2", "C")]
    assert hap(spark, rows, flips=flips) == [(1, 1, 0)]  # SNP 2 was left out by phasing


def test_snp_filters(spark):
    first = spark.createDataFrame([(1, "A", f"U{k}", "C") for k in range(9)] + [(1, "A", "U9", "G")], "snp_idx long, cell string, umi string, allele string")
    t = pileup.snp_totals(first, snp_table(spark, SNPS))
    assert pileup.passing_snps(t, AlleleParams(min_count=10)).count() == 1
    assert pileup.passing_snps(t, AlleleParams(min_count=10, min_maf=0.1)).count() == 0
    assert pileup.filter_pileup(spark.createDataFrame([(1, 9, 9), (2, 5, 12)], "snp_idx long, ad long, dp long"), 10, 0.1).count() == 1


def test_genotypes_and_attributes(spark):
    df = spark.createDataFrame([("GT:DP", "0|1:3"), ("DP:GT", "3:1/0"), ("GT", "1/1"), ("GT:DP", "0/1"), ("DP", "3")], "f string, s string")
    got = [r[0] and (r[0].ref_hap, r[0].alt_hap) for r in df.select(fields.hap_pair(fields.format_field(F.col("f"), F.col("s")))).collect()]
    assert got == [(0, 1), (1, 0), None, None, None]
    a = spark.createDataFrame([('gene_id "g1"; gene_name "N"; tag "a"; tag "b";',), ("ID=x;Parent=y",)], "a string")
    m = [r[0] for r in a.select(fields.attributes(F.col("a"))).collect()]
    assert m == [{"gene_id": "g1", "gene_name": "N", "tag": "b"}, {"ID": "x", "Parent": "y"}]
    names = spark.createDataFrame([("chr1",), ("CHR1",), ("1",)], "c string")
    assert [r[0] for r in names.select(chrom.chrom_key(F.col("c"))).collect()] == ["1"] * 3
    assert alleles.BASES == ("A", "C", "G", "T")


def test_reference_repair(spark):
    rows = [
        (1, ["A", "C"], [["0", "1"]], [False], "A", (0, ["A", "C"], ["0/1"])), (2, ["A", "C"], [["0", "1"]], [True], "C", (1, ["C", "A"], ["1|0"])),
        (3, ["A", "C", "G"], [["1", "2"], [".", "."]], [False, False], "T", (1, ["T", "C", "G"], ["1/2", "./."])), (4, ["A"], [[".", "."]], [False], "A", (0, ["A", "C"], ["./."])),
        (5, ["AT", "C"], [["0", "1"]], [False], "A", (-1, None, None)), (6, ["A", "C"], [["0"]], [False], "A", (-1, None, None)), (7, ["A", "C"], [["0", "1"]], [False], None, (-1, None, None)),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "line_no long, alleles array<string>, gts array<array<string>>, phased array<boolean>, fasta string")
    got = {r.line_no: (r.status, r.new_alleles, r.new_gts) for r in fixref.fix_reference(df).collect()}
    assert got == {r[0]: r[5] for r in rows}


def test_contigs():
    header = ["##a", "##contig=<ID=chr10>", "#CHROM\tPOS"]
    assert variants.complete_header(header, ["chr1"]) == ["##a", "##contig=<ID=chr10>", "##contig=<ID=chr1>", "#CHROM\tPOS"]
    assert variants.complete_header(["##a", "#CHROM"], ["2"]) == ["##a", "##contig=<ID=2>", "#CHROM"]
    assert variants.header_chr(header, add=False)[1] == "##contig=<ID=10>"


def test_region_sets(spark):
    a = region_table(spark, [(1, "1", 1, 5, "x"), (2, "1", 7, 9, None)])
    b = region_table(spark, [(3, "1", 1, 5, "x"), (4, "1", 7, 9, "z")])
    assert {r.region_idx for r in regions.merge_regions(a, b).collect()} == {1, 2, 4}
    assert regions.query_region(a, "1_7_9").count() == 1
    last = regions.bins_of_lengths(spark, [("1", 25)], 10).orderBy("start").collect()
    assert [(r.start, r.end) for r in last] == [(1, 10), (11, 20), (21, 30)]


def test_attributes_are_parsed_once(spark):
    """The parts of a text are made once, and not again for every attribute."""
    df = spark.createDataFrame([('gene_id "a"; n "1"; n "2"; gene_id "b"; x=y',), ("",), (None,)], "a string").select(fields.attributes(F.col("a")).alias("m"))
    assert [r.m for r in df.collect()] == [{"n": "2", "gene_id": "b", "x": "y"}, {}, None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_kernels():
    r = np.random.default_rng(0)
    a, b = r.random((3, 4)), r.random((4, 2))
    assert np.allclose(kernels.log_dot_exp(np.log(a), np.log(b)), np.log(a @ b))
    assert np.allclose(kernels.hmm_posterior(np.log(r.random((7, 2)))).sum(1), 1)
    assert np.allclose(kernels.gaussian_smooth(np.ones(5), np.arange(5.0), 2.0), 1)
    assert np.allclose(kernels.normalise(a).sum(1), 1)
    z = np.array([[0.9, 0.1]])
    assert np.allclose(kernels.haplotype_sums(z, np.array([[3.0]]), np.array([[10.0]])), [[0.9 * 3 + 0.1 * 7], [0.1 * 3 + 0.9 * 7]])


def phase_rows():
    r, rows = np.random.default_rng(1), []
    for region in (1, 2):
        for cell in range(16):
            p = 0.2 if cell < 8 else 0.5
            for k in range(6):
                n = 40
                ad = r.binomial(n, 1 - p if k in (1, 4) else p)
                rows.append((region, k, 1000 * k, f"c{cell}", int(ad), n))
    return rows


def test_local_phasing_recovers_flips(spark):
    df = spark.createDataFrame(phase_rows(), "region_idx long, snp_idx long, pos long, cell string, ad long, dp long")
    got = phasing.local_flips(df, PhaseParams(kernel_width=10.0)).collect()
    for region in (1, 2):
        assert {r.snp_idx: r.flip for r in got if r.region_idx == region} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}


def test_phase_correction(spark):
    df = spark.createDataFrame([(*x, 0) for x in phase_rows()] + [(3, 9, 1, "c1", 1, 2, 1)], "region_idx long, snp_idx long, pos long, cell string, ad long, dp long, hap int")
    got = phasing.corrected_snps(df, CorrectionParams(starts=5))
    again = phasing.corrected_snps(df.repartition(3), CorrectionParams(starts=5))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(got) == key(again)
    flips = {r.snp_idx: r.flip for r in got.where("region_idx = 1").collect()}
    assert flips in ({0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}, {0: 1, 1: 0, 2: 1, 3: 1, 4: 0, 5: 1})
    assert got.where("region_idx = 3").first().flip == 0


def plain_correction(ad, dp, hap, starts, max_iter, rng):
    """One start after the other: (likelihood, corrected haplotypes) of each."""
    out = []
    for _ in range(starts):
        first = rng.random(ad.shape[1])
        theta = np.clip(np.stack([first, 1 - first], 1), 1e-10, 1 - 1e-10)
        pi, last = np.where(hap[:, None] == [[0, 1]], 0.99, 0.01), np.inf
        for _ in range(max_iter):
            phi = ad @ np.log(theta) + (dp - ad) @ np.log(1 - theta) + np.log(pi)
            total = np.logaddexp(phi[:, 0], phi[:, 1])
            psi = np.exp(phi - total[:, None])
            theta = np.clip((ad.T @ psi + (dp - ad).T @ (1 - psi)) / np.maximum(dp.sum(0), 1e-10)[:, None], 1e-10, 1 - 1e-10)
            if abs(total.sum() - last) < 1e-6:
                break
            last = total.sum()
        out.append((total.sum(), psi.argmax(1)))
    return out


def many_optima(seed=37):
    r = np.random.default_rng(seed)
    dp = r.integers(0, 30, (12, 5)).astype(float)
    return r.binomial(dp.astype(int), r.random((12, 5))).astype(float), dp, r.integers(0, 2, 12)


def test_phase_correction_is_the_best_of_all_starts(spark):
    ad, dp, hap = many_optima()
    runs = plain_correction(ad, dp, hap, 100, 1000, np.random.default_rng([0, 1]))
    best = max(runs, key=lambda x: x[0])
    assert best[0] > max(runs[:5], key=lambda x: x[0])[0] + 0.01 and (best[1] != max(runs[:5], key=lambda x: x[0])[1]).any()
    got = kernels.best_correction(ad, dp, hap, CorrectionParams(), 1)
    assert np.isclose(got["log_lik"], best[0], atol=1e-5) and (got["hap_new"] == best[1]).all() and (got["flip"] == (best[1] != hap)).all()
    for starts in (1, 5):  # the starts are the same, however many there are
        assert np.isclose(kernels.best_correction(ad, dp, hap, CorrectionParams(starts=starts), 1)["log_lik"], max(x[0] for x in runs[:starts]), atol=1e-5)


def test_phase_correction_query_uses_all_starts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(phasing, "corrected_snps", lambda phase, p=CorrectionParams(): seen.append(p) or phase)
    queries.QUERIES["rpc_flip"](spark, DATA)
    assert seen == [CorrectionParams()] and (seen[0].starts, seen[0].max_iter) == (100, 1000)


def plain_local_phasing(ad, dp, pos, p):
    """SNP by SNP and cell by cell; ad, dp: cells x SNPs as lists."""
    rows = [(a, d) for a, d in zip(ad.tolist(), dp.tolist()) if sum(x > 0 for x in d) >= p.min_expr_snps]
    final = None
    for turn in range(p.max_iter):
        rows = [(a, d) for a, d in rows if not p.baf_low <= sum(a) / max(sum(d), 1e-12) <= p.baf_high]
        if not rows:
            return None
        n = len(pos)
        z = [sum(a[k] for a, _ in rows) / max(1, sum(d[k] for _, d in rows)) if sum(d[k] for _, d in rows) > 0 else 0.5 for k in range(n)]

        def maximise(z):
            theta = [[sum(a[k] * y + (d[k] - a[k]) * (1 - y) for k, y in enumerate(col)) / sum(d) for col in (z, [1 - x for x in z])] for a, d in rows]
            safe = [[1e-6 if t <= 0 else 1 - 1e-6 if t >= 1 else t for t in pair] for pair in theta]
            return [[sum(a[k] * math.log(s[j]) + (d[k] - a[k]) * math.log(1 - s[j]) for (a, d), s in zip(rows, safe)) for j in (0, 1)] for k in range(n)]

        total = lambda ll: sum(max(x) + math.log(sum(math.exp(v - max(x)) for v in x)) for x in ll)
        ll = maximise(z)
        last = total(ll)
        for it in range(p.em_max_iter):
            z = [math.exp(x[0] - max(x)) / sum(math.exp(v - max(x)) for v in x) for x in ll]
            if p.smooth_kernel:
                w = [[math.exp(-(((b - c) / p.kernel_width) ** 2)) for c in pos] for b in pos]
                z = [sum(u * v for u, v in zip(row, z)) / sum(row) for row in w]
            ll = maximise(z)
            now = total(ll)
            if it >= p.em_min_iter and now - last < p.epsilon:
                break
            last = now
        flip = [1 - x >= x for x in z]
        final = flip if final is None else [a != b for a, b in zip(final, flip)]
        if turn >= p.min_iter and (all(flip) or not any(flip)):
            break
        rows = [([d[k] - a[k] if flip[k] else a[k] for k in range(n)], d) for a, d in rows]
    return [int(not x) if sum(final) / len(final) > 0.5 else int(x) for x in final]


def test_local_phasing_against_plain_loops():
    for seed in range(12):
        r = np.random.default_rng(seed)
        cells_, n = int(r.integers(2, 12)), int(r.integers(2, 9))
        dp = r.integers(0, 20, (cells_, n)).astype(float)
        swap = r.random(n) < 0.4
        share = np.where(r.random(cells_)[:, None] < 0.6, 0.2, 0.5) * np.ones(n)
        ad = r.binomial(dp.astype(int), np.where(swap, 1 - share, share)).astype(float)
        pos = np.sort(r.integers(1, 3000, n)).astype(float)
        p = PhaseParams(kernel_width=float(r.choice([1.0, 500.0])), em_max_iter=60, max_iter=8, smooth_kernel=bool(seed % 3))
        want, got = plain_local_phasing(ad, dp, pos.tolist(), p), kernels.local_phasing(ad, dp, pos, p)
        assert (got is None) == (want is None) and (want is None or got.tolist() == want), seed


def test_beginnings_of_phasing():
    r = np.random.default_rng(5)
    dp = r.integers(1, 9, (6, 4)).astype(float)
    ad = r.binomial(dp.astype(int), 0.3).astype(float)
    step = lambda z0: (ad.T @ np.stack([z0, 1 - z0], 1) + (dp - ad).T @ (1 - np.stack([z0, 1 - z0], 1))) / dp.sum(0)[:, None]
    for init, z0 in (("warm", ad.sum(1) / dp.sum(1)), ("current", np.ones(6)), ("random", np.random.default_rng(0).random(6))):
        _, theta, _ = kernels.expectation_maximisation(ad, dp, PhaseParams(init=init, em_max_iter=0))
        assert np.allclose(theta, step(z0))
    with pytest.raises(ValueError):
        PhaseParams(init="other")


SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n" + "".join(
    f"r{k}\t{flag}\tchr1\t{pos}\t60\t40M\t*\t0\t0\t{'ACGT' * 10}\t{'I' * 40}\tCB:Z:{cell}\tUB:Z:U{k % 3}\tNM:i:0\n"
    for k, (pos, cell, flag) in enumerate([(101, "B", 0), (105, "A", 0), (110, "A", 16), (300, "C", 0), (102, "A", 4)])
)


def bam_bytes(text):
    names, body = ["chr1"], b""
    for line in text.splitlines():
        if line.startswith("@"):
            continue
        f = line.split("\t")
        seq = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(f[9][::2], f[9][1::2]))
        tags = b"".join(t[:2].encode() + b"Z" + t[5:].encode() + b"\0" for t in f[11:13]) + b"NMc\0"
        x = struct.pack("<iiBBHHHiiii", 0, int(f[3]) - 1, len(f[0]) + 1, int(f[4]), 0, 1, int(f[1]), len(f[9]), -1, -1, 0)
        x += f[0].encode() + b"\0" + struct.pack("<I", 40 << 4) + seq + bytes(ord(c) - 33 for c in f[10]) + tags
        body += struct.pack("<i", len(x)) + x
    head = b"@HD\tVN:1.6\n"
    return b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(names)) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + body


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    with open(tmp_path / "a.bam", "wb") as f:
        data = bam_bytes(SAM)
        for part in (data[:100], data[100:]):
            f.write(files._block(part))
        f.write(files._EOF)
    (tmp_path / "cells.txt").write_text("B\nA\n")
    (tmp_path / "regions.tsv").write_text("chr1\t101\t200\tg1\nchr1\t500\t600\tg2\n")
    (tmp_path / "snps.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nchr1\t121\t.\tA\tC\t.\t.\t.\tGT\t0|1\nchr1\t122\t.\tAT\tC\t.\t.\t.\tGT\t0|1\nchr1\t125\t.\tA\tG\t.\t.\t.\tGT\t1/1\n")
    return tmp_path


def test_sam_equals_bam(spark, inputs):
    a = sam.read_sam(spark, [str(inputs / "a.sam")]).drop("rec_idx").collect()
    b = bam.read_bam(spark, [str(inputs / "a.bam")]).drop("rec_idx").collect()
    key = lambda r: (r.qname, r.flag, r.chrom, r.pos, r.mapq, r.cigar, r.seq, r.qual, sorted(r.tags.items()))
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == 5
    assert sam.sam_sequences(spark, str(inputs / "a.sam")) == {"chr1": 1000}


def test_bam_pieces_and_regions(spark, tmp_path):
    """Pieces of any size give each record once; a region gives what overlaps."""
    r = np.random.default_rng(2)
    rows = [(0, k, f"r{k}", int(r.choice([0, 16, 4])), str(r.choice(["c1", "c2"])), int(r.integers(1, 900_000)), 60, "50M" if k % 3 else "20M900N30M", "ACGTN" * 10, "I" * 50, {"CB": f"x{k % 5}"}) for k in range(6000)]
    rows += [(0, 6000 + k, f"u{k}", 4, None, 0, 0, None, None, None, {}) for k in range(3)]
    df = spark.createDataFrame(rows, bam.READS).repartition(3)
    path = str(tmp_path / "x.bam")
    assert bam_sink.write_bam(df, path, [("c1", 1_000_000), ("c2", 1_000_000)]) == 6003
    want = sorted(x[2] for x in rows)
    for size in (1, 5000, 1 << 30):
        got = bam.read_bam(spark, [path], split_bytes=size)
        assert sorted(x.qname for x in got.collect()) == want and (size > 1 << 20 or got.rdd.getNumPartitions() > 3)
    order = [x.qname for x in bam.read_bam(spark, [path], split_bytes=5000).orderBy("rec_idx").collect()]
    assert order == [x[2] for x in sorted(rows, key=lambda x: (x[4] is None, x[4], x[5], x[1]))]
    for a, b in ((1, 900_000), (5000, 5000), (400_000, 420_000), (16_384, 16_385), (950_000, 960_000)):
        got = sorted(x.qname for x in bam.read_bam(spark, [path], region=f"c2:{a}-{b}").collect())
        assert got == sorted(x[2] for x in rows if x[4] == "c2" and x[5] <= b and x[5] + (50 if x[7] == "50M" else 950) > a)
    assert bam.read_bam(spark, [path], region="c9:1-5").count() == 0
    kept = bam.read_bam(spark, [path], exclude=4)
    assert kept.count() == sum(x[3] == 0 or x[3] == 16 for x in rows) and bam.read_bam(spark, [path], min_mapq=61).count() == 0


@pytest.fixture
def rows_to_driver(monkeypatch):
    """Rows that each collect() brings; streams to the driver fail."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows are streamed to the driver"))
    monkeypatch.setattr(DataFrame, "collect", lambda df: [seen.append(len(x := collect(df))), x][1])
    return seen


def sorted_reads(spark, n):
    r = np.random.default_rng(5)
    bases = lambda m: "".join(r.choice(list("ACGTNRY"), m))
    rows = [(0, k, f"r{k}", k % 3 * 16, (None, "c1", "c2")[k % 13 % 3], int(r.integers(1, 90_000)), 60, ("31M", "5S20M100N6M")[k % 2], bases(31), None if k % 7 == 0 else "".join(map(chr, r.integers(33, 73, 31))), {"UB": "U1", "CB": f"x{k % 5}"} if k % 4 else {}) for k in range(n)]
    return rows, spark.createDataFrame(rows, bam.READS).repartition(5)


def test_bam_is_written_by_tasks(spark, tmp_path, rows_to_driver):
    rows, df = sorted_reads(spark, 20_000)
    path = str(tmp_path / "x.bam")
    assert bam_sink.write_bam(df, path, [("c2", 100_000), ("c1", 100_000)]) == 20_000 and sum(rows_to_driver) < 50
    got = bam.read_bam(spark, [path], split_bytes=20_000).orderBy("rec_idx").collect()
    want = sorted(rows, key=lambda x: ({"c2": 0, "c1": 1}.get(x[4], 2), x[5], x[1]))
    assert [tuple(x)[2:] for x in got] == [x[2:] for x in want]
    found = bam.read_bam(spark, [path], region="c1:30000-31000").collect()
    assert sorted(x.qname for x in found) == sorted(x[2] for x in rows if x[4] == "c1" and x[5] <= 31_000 and x[5] + (31 if x[7] == "31M" else 126) > 30_000)
    assert bam_sink.write_bam(df.where("false"), path, [("c1", 9)]) == 0 and bam.read_bam(spark, [path]).count() == 0


def test_sam_is_written_by_tasks(spark, tmp_path, rows_to_driver):
    rows, df = sorted_reads(spark, 2000)
    path = str(tmp_path / "x.sam")
    assert bam_sink.write_sam(df, path, [("c1", 100_000), ("c2", 100_000)]) == 2000 and sum(rows_to_driver) < 50
    assert [tuple(x)[2:] for x in sam.read_sam(spark, [path]).orderBy("rec_idx").collect()] == [x[2:] for x in rows]
    assert sam.sam_sequences(spark, path) == {"c1": 100_000, "c2": 100_000}


def test_vcf_index(tmp_path):
    r = np.random.default_rng(4)
    rows = sorted((c, int(p)) for c in (1, 2) for p in r.integers(1, 900_000, 3000))
    path = str(tmp_path / "v.vcf.gz")
    with files.text_file(path) as write:
        write("##x")
        write("#CHROM\tPOS\tID\tREF\tALT")
        for c, p in rows:
            write(f"chr{c}\t{p}\t.\tA\tC")
    bam_sink.index_vcf(path)
    data = gzip.decompress(open(path + ".tbi", "rb").read())
    n, kind, *columns = struct.unpack_from("<7i", data, 4)
    assert (data[:4], n, kind, columns) == (b"TBI\1", 2, 2, [1, 2, 0, 35, 0]) and data[36:46] == b"chr1\0chr2\0"
    index = bam.Index(b"BAI\1" + data[4:8] + data[46:])
    for c, a, b in ((1, 100_000, 120_000), (2, 1, 900_000), (2, 5, 6)):
        got = []
        for s, e in index.chunks(c - 1, a - 1, b):
            with open(path, "rb") as f:
                x = bam.Blocks(f, s)
                while x.tell() < e and (line := x.line()):
                    v = line.split(b"\t")
                    got += [int(v[1])] * (v[0] == b"chr%d" % c and a <= int(v[1]) <= b)
        assert got == [p for q, p in rows if q == c and a <= p <= b]
    with files.text_file(path) as write:
        write("chr1\t9\t.\tA\tC")
        write("chr1\t8\t.\tA\tC")
    with pytest.raises(ValueError):
        bam_sink.index_vcf(path)


def test_genomes_without_one_window(spark, tmp_path):
    r = np.random.default_rng(3)
    contigs = {f"c{k}": "".join(r.choice(list("ACGT"), int(r.integers(1, 60_000)))) for k in range(40)}
    with open(tmp_path / "g.fa", "w") as f:
        for c, s in contigs.items():
            f.write(f">{c} text\n" + "".join(s[k : k + 70] + "\n" for k in range(0, len(s), 70)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for x in region_files.read_fasta(spark, str(tmp_path / "g.fa"), 1000).orderBy("chrom", "chunk_no").collect():
            got[x.chrom] = got.get(x.chrom, "") + x.seq
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == contigs


def test_depth_plan_and_directory(spark, inputs):
    out = str(inputs / "out")
    got = counting.count_features(spark, [str(inputs / "a.sam")], str(inputs / "regions.tsv"), out, str(inputs / "cells.txt"))
    assert sorted((r.cell, r.n) for r in got.collect()) == [("A", 2), ("B", 1)]
    d = mtx.read_depth_dir(spark, out)
    assert d["features"].orderBy("row").first().end == 200 and d["cells"].orderBy("col").first().cell == "A"
    assert sorted(map(tuple, d["counts"].collect())) == [(1, 1, 2), (1, 2, 1)]
    assert mtx.mtx_shape(spark, out + "/matrix.mtx") == (2, 2, 2)


def test_allele_plan(spark, inputs):
    snps = vcf.read_phased_vcf(spark, str(inputs / "snps.vcf"))
    assert snps.count() == 1
    out = str(inputs / "alleles")
    got = counting.count_alleles(spark, [str(inputs / "a.sam")], str(inputs / "regions.tsv"), snps, out, str(inputs / "cells.txt"))
    # 121 shows A in r0 (101 + 20), A in r1 (105 + 16), T in r2 (110 + 11)
    assert sorted((r.cell, r.ad, r.dp, r.oth) for r in got.collect()) == [("A", 0, 1, 1), ("B", 0, 1, 0)]
    layers = {(r.row, r.col, r.layer): r.value for r in mtx.read_allele_dir(spark, out)["counts"].collect()}
    assert layers == {(1, 1, "DP"): 1, (1, 2, "DP"): 1, (1, 1, "OTH"): 1}


def test_pipeline_with_hook(spark, inputs):
    snps = vcf.read_phased_vcf(spark, str(inputs / "snps.vcf"))
    seen = []

    def hook(table):
        seen.extend(table.columns)
        return snps

    got = counting.allelic_pipeline(spark, [str(inputs / "a.sam")], str(inputs / "regions.tsv"), snps, str(inputs / "p"), hook, str(inputs / "cells.txt"), min_count=1, min_maf=0)
    assert got.count() == 2 and "FORMAT" in seen


def test_commands(spark, inputs, capsys, monkeypatch):
    """baf with a phasing program (a stand-in that swaps every haplotype), and fixref to standard output."""
    panel, program = inputs / "panel", inputs / "phase.sh"
    panel.mkdir()
    (panel / "x.chr1.bcf").write_text("")
    (inputs / "map.txt").write_text("")
    program.write_text('#!/bin/sh\nwhile [ $# -gt 0 ]; do case $1 in --vcfTarget) t=$2;; --outPrefix) o=$2;; esac; shift 2; done\ngzip -dc $t | sed "s|0/1$|1\\|0|" | gzip > $o.vcf.gz\n')
    program.chmod(0o755)
    monkeypatch.setattr(cli, "_session", lambda: spark)
    args = ["baf", "-s", str(inputs / "a.sam"), "-b", str(inputs / "cells.txt"), "-R", str(inputs / "regions.tsv"), "--snpvcf", str(inputs / "snps.vcf"), "--minCOUNT", "1", "--minMAF", "0"]
    assert cli.main([*args, "-O", str(inputs / "plain")]) == 0
    assert cli.main([*args, "-O", str(inputs / "phased"), "--eagle", str(program), "--gmap", str(inputs / "map.txt"), "--paneldir", str(panel)]) == 0
    layer = lambda d: {(r.row, r.col, r.layer): r.value for r in mtx.read_allele_dir(spark, str(inputs / d))["counts"].collect()}
    plain, phased = layer("plain"), layer("phased")
    assert {k: v for k, v in plain.items() if k[2] != "AD"} == {k: v for k, v in phased.items() if k[2] != "AD"} and plain != phased
    with pytest.raises(SystemExit):
        cli.main([*args, "-O", "x", "--eagle", str(program)])
    (inputs / "g.fa").write_text(">chr1\n" + "ACGT" * 100 + "\n")
    capsys.readouterr()
    assert cli.main(["fixref", "-i", str(inputs / "snps.vcf"), "-r", str(inputs / "g.fa"), "-v"]) == 0
    body = [x.split("\t") for x in capsys.readouterr().out.splitlines() if not x.startswith("#")]
    assert [(x[1], x[3], x[4], x[9]) for x in body] == [("121", "A", "C", "0|1:0|1"), ("125", "A", "G", "1/1:1/1")]


def test_qualities_keep_their_case(spark):
    df = spark.createDataFrame([("4M", "acgt", "aAzZ", 1)], "c string, s string, q string, p long")
    b = cigar.cigar_blocks(F.col("c"), F.col("p"))
    assert list(df.select(*[cigar.quality_at(b, F.col("q"), F.lit(k)) for k in (1, 2, 3, 4)]).first()) == [64, 32, 89, 57]


def test_phasing_correction_plan(spark, tmp_path):
    rows = [x for x in phase_rows() if x[0] == 1]
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    (tmp_path / "p.vcf").write_text(head + "".join(f"chr1\t{1000 * k + 1}\t.\tA\tC\t.\t.\t.\tGT\t0|1\n" for k in range(6)))
    for t, at in (("ad", 4), ("dp", 5)):
        lines = [f"{x[1] + 1}\t{int(x[3][1:]) + 1}\t{x[at]}" for x in rows]
        (tmp_path / f"{t}.mtx").write_text("\n".join(["%%MatrixMarket matrix coordinate integer general", f"6 16 {len(lines)}", *lines]) + "\n")
    (tmp_path / "r.tsv").write_text("1\t1\t9000\tg\n2\t1\t5\th\n")
    args = [str(tmp_path / x) for x in ("ad.mtx", "dp.mtx", "p.vcf", "r.tsv", "out")]
    snp, region = counting.correct_phasing(spark, *args, params=CorrectionParams(starts=3))
    flips = {r.pos // 1000 for r in snp.collect() if r.ref_hap != r.ref_hap_new}
    assert flips in ({1, 4}, {0, 2, 3, 5})
    assert {(r.name, r.n_snp, r.n_flip) for r in region.collect()} == {("g", 6, len(flips)), ("h", 0, 0)}
    assert (tmp_path / "out" / "sample_region_stat.tsv").read_text().splitlines()[0] == "chrom\tstart\tend\tname\tn_flip\tn_snp"


def test_text_sources(spark, inputs, tmp_path):
    v, header = vcf.read_vcf(spark, str(inputs / "snps.vcf"))
    tables.write_vcf(v, header, str(tmp_path / "copy.vcf.gz"))
    again, _ = vcf.read_vcf(spark, str(tmp_path / "copy.vcf.gz"))
    assert sorted(map(tuple, again.drop("line_no").collect())) == sorted(map(tuple, v.drop("line_no").collect()))
    (tmp_path / "g.fa").write_text(">1 x\nACGT\nACG\n>2\nTTTT\n")
    g = region_files.read_fasta(spark, str(tmp_path / "g.fa"), 3)
    assert {(r.chrom, r.chunk_no): r.seq for r in g.collect()} == {("1", 0): "ACG", ("1", 1): "TAC", ("1", 2): "G", ("2", 0): "TTT", ("2", 1): "T"}
    sites = spark.createDataFrame([("1", 4), ("1", 7), ("2", 4), ("2", 9), ("3", 1)], "chrom string, pos long")
    assert {(r.chrom, r.pos): r.fasta for r in fixref.lookup_base(sites, g, 3).collect()} == {("1", 4): "T", ("1", 7): "G", ("2", 4): "T", ("2", 9): None, ("3", 1): None}
    (tmp_path / "s.tsv").write_text("chrom\tpos\tref\talt\trh\tah\nchr2\t5\ta\tc\t1\t0\n2\t6\tA\tC\t1\t1\n2\tx\tA\tC\t0\t1\n")
    assert [(r.chrom, r.pos, r.ref_hap) for r in vcf.read_snp_tsv(spark, str(tmp_path / "s.tsv")).collect()] == [("2", 5, 1)]
    (tmp_path / "bad.tsv").write_text("1\t2\n")
    with pytest.raises(Exception, match="bad region line"):
        region_files.read_regions(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "x.bed").write_text("chr1\t0\t10\tq\n")
    assert region_files.read_intervals(spark, str(tmp_path / "x.bed"), "bed").first().label == "chr1:1-10"


def test_genes(spark, tmp_path):
    line = lambda kind, a, b, att: f"1\tx\t{kind}\t{a}\t{b}\t.\t-\t.\t{att}\n"
    g = 'gene_id "g1"; gene_name "N";'
    t = g + ' transcript_id "t1";'
    (tmp_path / "a.gtf").write_text("#c\n" + line("gene", 10, 90, g) + line("transcript", 10, 99, t) + line("exon", 10, 19, t) + line("exon", 50, 99, t))
    genes = region_files.read_genes(spark, str(tmp_path / "a.gtf"))
    r = genes.first()
    assert [(e.start, e.end) for e in r.transcripts[0].exons] == [(50, 99), (10, 19)]
    info = region_files.gene_info(region_files.with_premrna(genes)).first()
    assert (info.start, info.end, info.n_transcripts, info.max_exons) == (10, 99, 2, 2)
    assert tables.write_genes(genes, str(tmp_path / "b.gtf.gz")) == 4
    assert region_files.read_genes(spark, str(tmp_path / "b.gtf.gz")).first().transcripts[0].tran_id == "t1"


def test_cells_and_modes(spark, tmp_path):
    (tmp_path / "c.txt").write_text("B\nA\nB\n")
    with pytest.raises(ValueError):
        cells.read_barcodes(spark, str(tmp_path / "c.txt"))
    with pytest.raises(ValueError):
        check_modes(True, True, "CB")
    with pytest.raises(ValueError):
        check_modes(False, False, "CB")
    assert resolve_umi_tag("AUTO", True) == "UB" and resolve_umi_tag("AUTO", False) is None and resolve_umi_tag("None", True) is None
    assert [r.cell for r in cells.sample_table(spark, 2).collect()] == ["Sample0", "Sample1"]


def test_streaming_depth(spark, tmp_path):
    from tallyhap.streaming.depth import stream_depth

    r = reads(spark, [read(1, 110, "40M", "U1"), read(2, 120, "40M", "U1"), read(3, 130, "40M", "U2")])
    r.where("rec_idx < 3").write.parquet(str(tmp_path / "in"))
    r.where("rec_idx = 3").write.mode("append").parquet(str(tmp_path / "in"))
    g = region_table(spark, [(1, "1", 100, 300, "g")])
    live = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_depth(live, g, cell_table(spark, "A")).writeStream.outputMode("complete").format("memory").queryName("depths").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(x) for x in spark.sql("SELECT * FROM depths").collect()] == [(1, "A", 2)]
