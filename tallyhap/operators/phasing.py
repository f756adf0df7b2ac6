"""Local phasing and phasing correction of regions, as grouped functions.

SNPs meet their counts by key, never by place. A flip belongs to a (region,
SNP): regions that overlap don't see each other's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import CorrectionParams, PhaseParams
from .kernels import best_correction, local_phasing


def eligible_regions(regions: DataFrame, inside: DataFrame, p: PhaseParams = PhaseParams()) -> DataFrame:
    """region_idx, n_snps, gap of regions long and dense enough to phase."""
    stats = inside.groupBy("region_idx").agg(F.count("*").alias("n_snps"), (F.max("pos") - F.min("pos") + 1).alias("gap"))
    long = regions.where(F.col("end_excl") - F.col("start") >= p.min_len).select("region_idx")
    return stats.join(long, "region_idx").where((F.col("n_snps") >= max(1, p.min_snps)) & (F.col("gap") >= p.min_gap))


def phase_input(inside: DataFrame, counts: DataFrame, ref_cells: DataFrame | None = None) -> DataFrame:
    """region_idx, snp_idx, pos, cell, ad, dp: AD towards haplotype 1, without
    reference cells and zero depths."""
    used = counts.where("dp > 0")
    if ref_cells is not None:
        used = used.join(ref_cells, "cell", "left_anti")
    both = inside.join(used, "snp_idx")
    return both.select("region_idx", "snp_idx", "pos", "cell", F.when(F.col("ref_hap") == 1, F.col("dp") - F.col("ad")).otherwise(F.col("ad")).alias("ad"), "dp")


def snp_shares(snps: DataFrame, counts: DataFrame) -> DataFrame:
    """snp_idx, z0: the share of haplotype 1 over all cells. It is a SNP's own,
    the same in every region that holds it."""
    ad = F.when(F.col("ref_hap") == 1, F.col("dp") - F.col("ad")).otherwise(F.col("ad"))
    both = counts.where("dp > 0").join(snps.select("snp_idx", "ref_hap"), "snp_idx")
    return both.groupBy("snp_idx").agg((F.sum(ad).cast("double") / F.sum("dp")).alias("z0"))


def cell_stats(phase: DataFrame, p: PhaseParams = PhaseParams()) -> DataFrame:
    """region_idx, cell, depth, n_expr and whether the cell is imbalanced."""
    s = phase.groupBy("region_idx", "cell").agg(F.sum("ad").alias("ad"), F.sum("dp").alias("depth"), F.count("*").alias("n_expr"))
    baf = F.col("ad") / F.col("depth")
    return s.select("region_idx", "cell", "depth", "n_expr", ((baf < p.baf_low) | (baf > p.baf_high)).alias("imbalanced"))


def _dense(g: pd.DataFrame, rows: str, columns: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, i = np.unique(g[rows].to_numpy(), return_inverse=True)
    c, j = np.unique(g[columns].to_numpy(), return_inverse=True)
    ad, dp = np.zeros((len(r), len(c))), np.zeros((len(r), len(c)))
    np.add.at(ad, (i, j), g["ad"].to_numpy(float))
    np.add.at(dp, (i, j), g["dp"].to_numpy(float))
    return ad, dp, c


def local_flips(phase: DataFrame, p: PhaseParams = PhaseParams()) -> DataFrame:
    """region_idx, snp_idx, flip (0 or 1). A region without imbalanced cells has no rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["pos", "snp_idx"])
        snps = g[["snp_idx", "pos"]].drop_duplicates("snp_idx").sort_values("snp_idx")
        ad, dp, ids = _dense(g, "cell", "snp_idx")
        place = snps["pos"].to_numpy(float)
        order = np.lexsort((ids, place))
        flip = local_phasing(ad[:, order], dp[:, order], place[order], p)
        if flip is None:
            return pd.DataFrame({"region_idx": [], "snp_idx": [], "flip": []}, dtype=np.int64)
        return pd.DataFrame({"region_idx": g["region_idx"].iloc[0], "snp_idx": ids[order], "flip": flip})

    return phase.groupBy("region_idx").applyInPandas(run, "region_idx long, snp_idx long, flip int")


def corrected_snps(phase: DataFrame, p: CorrectionParams = CorrectionParams()) -> DataFrame:
    """phase: region_idx, snp_idx, cell, ad, dp, hap. region_idx, snp_idx,
    hap_new, flip. A region's single SNP stays as it is."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        region = int(g["region_idx"].iloc[0])
        hap = g[["snp_idx", "hap"]].drop_duplicates("snp_idx").sort_values("snp_idx")["hap"].to_numpy(int)
        if len(hap) == 1:
            return pd.DataFrame({"region_idx": region, "snp_idx": g["snp_idx"].iloc[:1].to_numpy(), "hap_new": hap, "flip": 0})
        ad, dp, ids = _dense(g.rename(columns={"snp_idx": "c", "cell": "r"}), "r", "c")
        best = best_correction(ad.T, dp.T, hap, p, region)
        return pd.DataFrame({"region_idx": region, "snp_idx": ids, "hap_new": best["hap_new"], "flip": best["flip"]})

    return phase.groupBy("region_idx").applyInPandas(run, "region_idx long, snp_idx long, hap_new int, flip int")


def region_flip_stats(flips: DataFrame) -> DataFrame:
    return flips.groupBy("region_idx").agg(F.sum("flip").cast("long").alias("n_flip"), F.count("*").alias("n_snp"))


def smooth_positions(values: DataFrame, width: float) -> DataFrame:
    """values (grp, pos, v) -> grp, pos, smooth: Gaussian kernel means. A point
    meets those within 6 widths, behind which weights are below a double's
    precision beside its own weight of 1; pairs are found by bins of that reach."""
    reach = max(1.0, 6 * width)
    bin_of = F.floor(F.col("pos") / reach)
    here = values.select("grp", "pos", bin_of.alias("bin"))
    near = values.select(F.col("grp").alias("g"), F.col("pos").alias("x"), F.col("v").alias("u"), F.explode(F.sequence(bin_of - 1, bin_of + 1)).alias("b"))
    w = F.exp(-F.pow((F.col("x") - F.col("pos")) / width, F.lit(2)))
    both = here.join(near, (F.col("grp") == F.col("g")) & (F.col("bin") == F.col("b")) & (F.abs(F.col("x") - F.col("pos")) <= reach))
    return both.groupBy("grp", "pos").agg((F.sum(F.col("u") * w) / F.sum(w)).alias("smooth"))


def theta_step(phase: DataFrame, z: DataFrame) -> DataFrame:
    """One M-step: region_idx, cell, theta0 from z (region_idx, snp_idx, z0)."""
    both = phase.join(z, ["region_idx", "snp_idx"])
    top = F.sum(F.col("ad") * F.col("z0") + (F.col("dp") - F.col("ad")) * (1 - F.col("z0")))
    return both.groupBy("region_idx", "cell").agg((top / F.sum("dp")).alias("theta0"))


def row_loglik(phase: DataFrame, theta: DataFrame) -> DataFrame:
    """region_idx, snp_idx, ll0: sum of ad log theta + bd log(1 - theta), clamped."""
    t = F.when(F.col("theta0") <= 0, 1e-6).when(F.col("theta0") >= 1, 1 - 1e-6).otherwise(F.col("theta0"))
    both = phase.join(theta, ["region_idx", "cell"])
    return both.groupBy("region_idx", "snp_idx").agg(F.sum(F.col("ad") * F.log(t) + (F.col("dp") - F.col("ad")) * F.log(1 - t)).alias("ll0"))
