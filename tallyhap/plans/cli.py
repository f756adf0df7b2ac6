"""Command line: basefc, baf, rpc, fixref and convert."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.fixref import fix_reference, lookup_base, status_counts
from ..operators.regions import fixed_bins
from ..params import AlleleParams, CorrectionParams, DepthParams
from ..session import ship_package
from ..sinks.tables import write_regions, write_lines
from ..sources.regions import read_fasta, read_intervals
from ..sources.text import id_list
from ..sources.vcf import read_phased_vcf, read_sites, read_snp_tsv
from .counting import allelic_pipeline, correct_phasing, count_features
from .refphase import eagle_phasing

log = logging.getLogger("tallyhap")


def _session() -> SparkSession:
    return ship_package(SparkSession.builder.appName("tallyhap").getOrCreate())


def _number(text: str) -> float:
    """Bases without a point, a fraction with one."""
    return float(text) if "." in text else int(text)


def _reads(p: argparse.ArgumentParser) -> None:
    p.add_argument("-s", "--sam", help="comma-separated alignment files")
    p.add_argument("-S", "--samList", "--samlist", help="file of alignment files")
    p.add_argument("-b", "--barcode")
    p.add_argument("-R", "--region", required=True)
    p.add_argument("-i", "--sampleIDs")
    p.add_argument("-I", "--sampleList")
    p.add_argument("-O", "--outdir", required=True)
    p.add_argument("-p", "--ncores", type=int, default=1, help="unused: Spark deals the work")
    p.add_argument("-D", "--debug", type=int, default=0, help="log more, if above 0")
    p.add_argument("--cellTAG", default="CB")
    p.add_argument("--UMItag", default="AUTO")
    p.add_argument("--inclFLAG", type=int, default=0)
    p.add_argument("--exclFLAG", type=int)
    p.add_argument("--minLEN", type=int, default=30)
    p.add_argument("--minMAPQ", type=float, default=20)
    p.add_argument("--countORPHAN", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyhap")
    sub = top.add_subparsers(dest="command", required=True)
    base = sub.add_parser("basefc", help="total depth of features")
    _reads(base)
    base.add_argument("--minINCLUDE", type=_number, default=0.9)
    allele = sub.add_parser("baf", help="allele counts of features")
    _reads(allele)
    allele.add_argument("--snpvcf", required=True, help="phased SNPs: VCF, or TSV of six columns")
    allele.add_argument("--label", default="sample", help="task label, and the sample of files without barcodes or sample ids")
    allele.add_argument("--gmap", help="genetic map of the phasing program")
    allele.add_argument("--eagle", help="the phasing program; without it SNPs keep their haplotypes")
    allele.add_argument("--paneldir", help="reference panels, one file a chromosome")
    allele.add_argument("--refCell")
    allele.add_argument("--minCOUNT", type=int, default=11)
    allele.add_argument("--minMAF", type=float, default=0.1)
    rpc = sub.add_parser("rpc", help="correct reference phasing by cell counts")
    rpc.add_argument("-b", "--barcode", help="unused: cells are columns")
    rpc.add_argument("-p", "--nproc", type=int, default=1, help="unused: Spark deals the work")
    rpc.add_argument("-A", "--AD", required=True)
    rpc.add_argument("-D", "--DP", required=True)
    rpc.add_argument("-O", "--outdir", required=True)
    rpc.add_argument("-P", "--phasedSNP", required=True)
    rpc.add_argument("-R", "--region", required=True)
    rpc.add_argument("-S", "--sid", default="sample")
    rpc.add_argument("-v", "--verbose", action="store_true")
    rpc.add_argument("--epsilonHAP", type=float, default=CorrectionParams.epsilon_hap)
    rpc.add_argument("--ninit", type=int, default=CorrectionParams.starts)
    fix = sub.add_parser("fixref", help="repair REF, ALT and GT by a genome")
    fix.add_argument("-i", "--input", required=True)
    fix.add_argument("-r", "--ref", required=True)
    fix.add_argument("-o", "--output", help="standard output by default")
    fix.add_argument("-v", "--verbose", action="store_true", help="log the sites of each status")
    conv = sub.add_parser("convert", help="convert regions, or make fixed bins")
    conv.add_argument("-i", "--input")
    conv.add_argument("-I", "--inType", choices=("bed", "gff", "tsv"))
    conv.add_argument("-o", "--output", required=True)
    conv.add_argument("-O", "--outType", choices=("bed", "tsv"), default="tsv")
    conv.add_argument("-B", "--binsize", type=int, help="in kb")
    conv.add_argument("-H", "--hg", choices=("19", "38"), default="38")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if getattr(a, "debug", 0) else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = _session()
    if a.command == "convert":
        if (a.input is None) == (a.binsize is None):
            raise SystemExit("give either --input or --binsize")
        regions = read_intervals(spark, a.input, a.inType or "tsv") if a.input else fixed_bins(spark, f"hg{a.hg}", a.binsize)
        log.info("%d regions", write_regions(regions, a.output, a.outType))
        return 0
    if a.command == "rpc":
        _, regions = correct_phasing(spark, a.AD, a.DP, a.phasedSNP, a.region, a.outdir, a.sid, CorrectionParams(epsilon_hap=a.epsilonHAP, starts=a.ninit))
        if a.verbose:
            log.info("%d SNPs flipped", regions.agg(F.coalesce(F.sum("n_flip"), F.lit(0))).first()[0])
        return 0
    if a.command == "fixref":
        sites, header, samples = read_sites(spark, a.input)
        found = fix_reference(lookup_base(sites, read_fasta(spark, a.ref), 10_000))
        if a.verbose:
            for r in status_counts(found).orderBy("status").collect():
                log.info("%d sites %s", r["n"], {-1: "skipped", 0: "matching", 1: "fixed"}[r["status"]])
        fixed = found.where("status >= 0").orderBy("line_no")
        cells = [F.concat(F.get("ogts", F.lit(k)), F.lit(":"), F.get("new_gts", F.lit(k))).alias(s) for k, s in enumerate(samples)]
        rows = fixed.select("chrom", "pos", F.lit("."), F.get("new_alleles", F.lit(0)), F.array_join(F.slice("new_alleles", 2, 1 << 20), ","), F.lit("."), F.lit("PASS"), F.concat(F.lit("OAL="), "oal"), F.lit("OGT:GT"), *cells)
        more = ['##INFO=<ID=OAL,Number=.,Type=String,Description="Old alleles">', '##FORMAT=<ID=OGT,Number=1,Type=String,Description="Old genotype">']
        lines = [*header[:-1], *more, header[-1]]
        if a.output:
            log.info("%d records", write_lines(rows, a.output, lines))
        else:
            for line in lines:
                sys.stdout.write(line + "\n")
            for r in rows.toLocalIterator():
                sys.stdout.write("\t".join("" if x is None else str(x) for x in r) + "\n")
        return 0
    sam = id_list(a.samList, spark) if a.samList else id_list(a.sam or "")
    ids = id_list(a.sampleList, spark) if a.sampleList else id_list(a.sampleIDs) if a.sampleIDs else None
    common = dict(cell_tag=None if a.cellTAG == "None" else a.cellTAG, umi_tag=a.UMItag, min_mapq=a.minMAPQ, min_len=a.minLEN, incl_flag=a.inclFLAG, excl_flag=a.exclFLAG, no_orphan=not a.countORPHAN)
    if a.command == "basefc":
        count_features(spark, sam, a.region, a.outdir, a.barcode, ids, DepthParams(**common, min_include=a.minINCLUDE))
    else:
        snps = read_snp_tsv(spark, a.snpvcf) if a.snpvcf.endswith((".tsv", ".tsv.gz")) else read_phased_vcf(spark, a.snpvcf)
        if a.eagle and not (a.gmap and a.paneldir):
            raise SystemExit("--eagle needs --gmap and --paneldir")
        hook = eagle_phasing(spark, a.eagle, a.gmap, a.paneldir, f"{a.outdir}/phasing") if a.eagle else None
        if not a.barcode and ids is None:  # one sample, named by the label
            ids = [a.label] if len(sam) == 1 else [f"{a.label}_{k}" for k in range(len(sam))]
        allelic_pipeline(spark, sam, a.region, snps, a.outdir, hook, a.barcode, ids, a.minCOUNT, a.minMAF, a.refCell, params=AlleleParams(**common, all_regions=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
