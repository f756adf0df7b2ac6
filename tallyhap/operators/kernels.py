"""Numeric kernels of phasing, in numpy. They run inside grouped functions, one
region at a time."""

from __future__ import annotations

import numpy as np

from ..params import CorrectionParams, PhaseParams


def log_sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top).squeeze(axis)


def log_dot_exp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) @ exp(b)) without overflow."""
    return log_sum_exp(a[..., :, None] + b[None, ...], axis=-2)


def normalise(x: np.ndarray, axis: int = 1) -> np.ndarray:
    return x / np.sum(x, axis=axis, keepdims=True)


def less_max(x: np.ndarray, axis: int = 1) -> np.ndarray:
    return x - np.max(x, axis=axis, keepdims=True)


def posterior(loglik: np.ndarray) -> np.ndarray:
    return normalise(np.exp(less_max(loglik)))


def gaussian_smooth(v: np.ndarray, x: np.ndarray, width: float, offset: float = 0.0) -> np.ndarray:
    """Means of v weighted by exp(offset - distance^2 / width^2), in rows of
    bounded size so that memory is linear in the number of points."""
    out = np.empty(len(v))
    for k in range(0, len(v), 1024):
        w = np.exp(offset - ((x[None, :] - x[k : k + 1024, None]) / width) ** 2)
        out[k : k + 1024] = w @ v / w.sum(1)
    return out


def hmm_posterior(emission: np.ndarray, diagonal: float = 0.99, pi: np.ndarray | None = None, transition: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over log emissions (steps x states). By default the
    start is uniform, and staying has `diagonal` of the probability."""
    m, n = emission.shape
    if transition is None:
        d = (diagonal - 1 / n) * n / (n - 1)
        transition = d * np.eye(n) + (1 - d) / n
    likely = np.exp(less_max(emission))
    before, after = np.empty((m, n)), np.ones((m, n))
    ahead = np.full(n, 1 / n) if pi is None else pi
    for i in range(m):  # each step is scaled to a distribution, so nothing runs out of range
        before[i] = ahead * likely[i] / (ahead @ likely[i])
        ahead = before[i] @ transition
    for i in range(m - 1, 0, -1):
        back = transition @ (likely[i] * after[i])
        after[i - 1] = back / back.sum()
    return normalise(before * after)


def _clamped(theta: np.ndarray, epsilon: float) -> np.ndarray:
    return np.where(theta <= 0, epsilon, np.where(theta >= 1, 1 - epsilon, theta))


def expectation_maximisation(ad: np.ndarray, dp: np.ndarray, p: PhaseParams, positions: np.ndarray | None = None, start: np.ndarray | None = None, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """ad, dp: SNPs x cells. Returns Z (SNPs x 2), theta (cells x 2) and the
    log-likelihoods. A SNP left without depth starts undecided."""
    bd, depth = dp - ad, dp.sum(1)
    if start is not None:
        z0 = start[:, 0]
    elif p.init == "current":  # as if nothing were flipped
        z0 = np.ones(len(ad))
    elif p.init == "random":
        z0 = (rng or np.random.default_rng(p.seed)).random(len(ad))
    else:
        z0 = np.where(depth > 0, ad.sum(1) / np.maximum(depth, 1), 0.5)
    z = np.stack([z0, 1 - z0], 1)
    cell = np.maximum(dp.sum(0), 1e-12)[:, None]

    def step(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        theta = (ad.T @ z + bd.T @ (1 - z)) / cell
        safe = _clamped(theta, 1e-6)
        return theta, ad @ np.log(safe) + bd @ np.log(1 - safe)

    theta, loglik = step(z)
    seen = [float(log_sum_exp(loglik, 1).sum())]
    for it in range(p.em_max_iter):
        z = posterior(loglik)
        if p.smooth_hmm:  # probabilities where logs would be expected: kept as known
            z = hmm_posterior(z, p.hmm_diagonal)
        if p.smooth_kernel and positions is not None:
            z0 = gaussian_smooth(z[:, 0], positions, p.kernel_width, p.kernel_offset)
            z = np.stack([z0, 1 - z0], 1)
        theta, loglik = step(z)
        seen.append(float(log_sum_exp(loglik, 1).sum()))
        if it >= p.em_min_iter and seen[-1] - seen[-2] < p.epsilon:
            break
    return z, theta, seen


def haplotype_sums(z: np.ndarray, ad: np.ndarray, dp: np.ndarray, hard: bool = False) -> np.ndarray:
    """Per state and cell the counts of the haplotype, soft or by the likelier state."""
    if hard:
        first = (z[:, 0] >= z[:, 1]).astype(float)
        z = np.stack([first, 1 - first], 1)
    return z.T @ ad + (1 - z).T @ (dp - ad)


def local_phasing(ad: np.ndarray, dp: np.ndarray, positions: np.ndarray, p: PhaseParams) -> np.ndarray | None:
    """ad, dp: cells x SNPs, oriented to haplotype 1. 0/1 flips, or None if no
    cell is imbalanced."""
    keep = (dp > 0).sum(1) >= p.min_expr_snps
    ad, dp, final = ad[keep].astype(float), dp[keep].astype(float), None
    for i in range(p.max_iter):
        baf = ad.sum(1) / np.maximum(dp.sum(1), 1e-12)
        off = (baf < p.baf_low) | (baf > p.baf_high)
        ad, dp = ad[off], dp[off]
        if not len(ad):
            return None
        z, _, _ = expectation_maximisation(ad.T, dp.T, p, positions)
        flip = z[:, 1] >= z[:, 0]
        final = flip if final is None else final ^ flip
        if i >= p.min_iter and (flip.all() or not flip.any()):
            break
        ad = np.where(flip[None, :], dp - ad, ad)
    final = final.astype(int)
    return 1 - final if final.mean() > 0.5 else final


def correct_phase(ad: np.ndarray, dp: np.ndarray, hap: np.ndarray, p: CorrectionParams, theta: np.ndarray) -> dict:
    """The phasing correction from several starts side by side, and of them the
    one of the highest likelihood; the first of equal ones. ad, dp: SNPs x
    cells; theta: cells x 2 x starts. A start that has converged drops out."""
    bd, depth = dp - ad, np.maximum(dp.sum(0), 1e-10)[:, None, None]
    prior = np.log(np.where(hap[:, None] == 0, [[1 - p.epsilon_hap, p.epsilon_hap]], [[p.epsilon_hap, 1 - p.epsilon_hap]]))[:, :, None]
    theta, starts = _clamped(theta, 1e-10), np.arange(theta.shape[2])
    last, best = np.full(len(starts), np.nan), {"log_lik": -np.inf, "start": -1}

    def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (a @ x.reshape(len(x), -1)).reshape(len(a), 2, -1)

    for it in range(p.max_iter):
        phi = times(ad, np.log(theta)) + times(bd, np.log(1 - theta)) + prior
        top = phi.max(1)
        less = np.exp(phi.min(1) - top)  # of the unlikelier state, to the likelier one
        total = (top + np.log1p(less)).sum(0)
        second = phi[:, 1] > phi[:, 0]
        psi = np.where(second, less, 1.0) / (1 + less)
        psi = np.stack([psi, np.where(second, 1.0, less) / (1 + less)], 1)
        theta = _clamped((times(ad.T, psi) + times(bd.T, psi[:, ::-1])) / depth, 1e-10)
        done = (np.abs(total - last) < p.epsilon) | (it + 1 == p.max_iter)
        for k in np.flatnonzero(done):
            if (total[k], -starts[k]) > (best["log_lik"], -best["start"]):
                best = {"start": int(starts[k]), "log_lik": float(total[k]), "psi": psi[:, :, k], "theta": theta[:, :, k], "hap_new": second[:, k].astype(int)}
        starts, last, theta = starts[~done], total[~done], theta[:, :, ~done]
        if not len(starts):
            break
    flip = (best["hap_new"] != hap).astype(int)
    return best | {"flip": flip, "ad_phased": np.where(flip[:, None] == 1, bd, ad)}


def best_correction(ad: np.ndarray, dp: np.ndarray, hap: np.ndarray, p: CorrectionParams, seed: int) -> dict:
    """The start of the highest likelihood; the first of equal ones. So many
    starts go together that memory is bounded by the region's size."""
    rng, most = np.random.default_rng([p.seed, seed]), max(1, 500_000 // sum(ad.shape))
    parts = [min(most, p.starts - k) for k in range(0, p.starts, most)]
    # the generator deals a start's cells together, so parts of any size give the same starts
    first = (rng.random((k, ad.shape[1])).T for k in parts)
    found = (correct_phase(ad, dp, hap, p, np.stack([x, 1 - x], 1)) for x in first)
    return max(found, key=lambda r: r["log_lik"])
