"""Reference phasing by an external program, a run for each chromosome.

The program is the caller's; it gets a VCF of a chromosome's SNPs, a reference
panel and a genetic map, and leaves a phased VCF under a prefix.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.variants import merge_variants
from ..sinks.tables import write_chrom_vcfs
from ..sources.vcf import read_phased_vcf


def panel_of(paneldir: str, chrom: str) -> str | None:
    """The panel file of a chromosome: that whose name has it as a part."""
    for name in sorted(os.listdir(paneldir)):
        if name.endswith((".bcf", ".vcf.gz")) and {chrom, f"chr{chrom}"} & set(name.replace("_", ".").replace("-", ".").split(".")):
            return os.path.join(paneldir, name)
    return None


def eagle_phasing(spark: SparkSession, program: str, gmap: str, paneldir: str, out: str, chroms: list[str] | None = None, at_once: int = 4) -> Callable[[DataFrame], DataFrame]:
    """A hook for allelic_pipeline. Chromosomes without a panel keep no SNP; a
    run that fails raises CalledProcessError, its output is beside its result."""
    for path in (program, gmap, paneldir):
        if not os.path.exists(path):
            raise ValueError(f"{path} does not exist")

    def one(chrom: str) -> str | None:
        panel = panel_of(paneldir, chrom)
        if panel is None:
            return None
        command = [program, "--vcfTarget", f"{out}/target.{chrom}.vcf.gz", "--vcfRef", panel, "--geneticMapFile", gmap, "--outPrefix", f"{out}/phased.{chrom}", "--numThreads", "1"]
        with open(f"{out}/phasing.{chrom}.log", "w") as log:
            subprocess.run(command, stdout=log, stderr=subprocess.STDOUT, check=True)
        return f"{out}/phased.{chrom}.vcf.gz"

    def phase(table: DataFrame) -> DataFrame:
        names = chroms or [str(k) for k in range(1, 23)]
        dot = lambda name: F.lit(".").alias(name)
        rows = table.select("snp_idx", "CHROM", "POS", dot("ID"), "REF", "ALT", dot("QUAL"), F.lit("PASS").alias("FILTER"), dot("INFO"), "FORMAT", "sample").orderBy("CHROM", "POS")
        header = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', *(f"##contig=<ID=chr{c}>" for c in names), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample"]
        sizes = write_chrom_vcfs(rows, header, f"{out}/target", names, "snp_idx")
        with ThreadPoolExecutor(at_once) as pool:  # the programs work, not these threads
            done = [x for x in pool.map(one, [c for c in names if sizes[c]]) if x]
        if not done:
            raise ValueError(f"no chromosome has both SNPs and a panel in {paneldir}")
        found = merge_variants([read_phased_vcf(spark, x).drop("snp_idx") for x in done])
        key = [F.regexp_replace("CHROM", "^(?i:chr)", "").alias("chrom"), F.col("POS").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt")]
        return found.join(table.select("snp_idx", *key), ["chrom", "pos", "ref", "alt"])

    return phase
