"""A small convolutional text classifier in numpy.

Symbols (hashed words, or characters) are embedded, convolved with filters of
several widths, max-pooled over the whole text and put through a logistic
layer. A text of any length is scored over all of its symbols: long ones are
processed in windows that overlap by the widest filter, and the maxima merge.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence

import numpy as np


class TextCNN:
    """Symbol 0 pads; a text is an integer array of symbols below `symbols`, or
    has several columns of them whose embeddings add up (a word and its parts)."""

    def __init__(self, symbols: int, dim: int = 12, widths: Sequence[int] = (1, 2, 3), filters: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.widths, self.filters, self.dim, self.seed = tuple(widths), filters, dim, seed
        self.E = r.normal(0, 0.3, (symbols, dim)).astype(np.float32)
        self.E[0] = 0
        self.W = [r.normal(0, (w * dim) ** -0.5, (w * dim, filters)).astype(np.float32) for w in self.widths]
        self.c = [np.zeros(filters, np.float32) for _ in self.widths]
        self.v = r.normal(0, 0.1, len(self.widths) * filters).astype(np.float32)
        self.b = np.float32(0)

    # -- scoring ---------------------------------------------------------
    def embed(self, ids: np.ndarray) -> np.ndarray:
        X = self.E[ids]
        return X.sum(1) if ids.ndim == 2 else X

    def _pooled(self, ids: np.ndarray, starts: np.ndarray, want: bool = False, table: np.ndarray | None = None):
        """Maxima per text over flat ids. Texts are separated by max(widths)-1
        zeros; starts has the first place of each. want: also their places.
        table: embeddings that ids point into, in place of E."""
        X, top = self.embed(ids) if table is None else table[ids], max(self.widths)
        n = len(ids) - top + 1
        out, at = [], []
        for w, W, c in zip(self.widths, self.W, self.c):
            H = X[:n] @ W[: self.dim]
            for k in range(1, w):
                H += X[k : k + n] @ W[k * self.dim : (k + 1) * self.dim]
            H += c
            out.append(np.maximum.reduceat(H, starts, axis=0))
            if want:
                ends = np.append(starts[1:], n)
                at.append(np.stack([s + H[s:e].argmax(0) for s, e in zip(starts, ends)]))
        P = np.concatenate(out, axis=1)
        return (P, at) if want else P

    def flat(self, texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Texts end to end with padding before and after each one."""
        gap = max(self.widths) - 1
        sizes = np.array([max(1, len(t)) + gap for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids = np.zeros((int(sizes.sum()) + gap, *texts[0].shape[1:]), np.int64)
        for s, t in zip(starts, texts):
            ids[s + gap : s + gap + len(t)] = t
        return ids, starts

    def logits(self, texts: Sequence[np.ndarray], table: np.ndarray | None = None, window: int = 200_000) -> np.ndarray:
        """One logit per text; about `window` symbols are held at a time."""
        out = np.zeros(len(texts))
        gap, batch, held = max(self.widths) - 1, [], 0

        def flush() -> None:
            nonlocal batch, held
            if batch:
                P = self._pooled(*self.flat([texts[i] for i in batch]), table=table)
                out[batch] = np.maximum(P, 0) @ self.v + self.b
            batch, held = [], 0

        for i, t in enumerate(texts):
            if len(t) > window:
                step = window - gap
                P = np.max([self._pooled(*self.flat([t[k : k + window]]), table=table) for k in range(0, len(t), step)], axis=0)
                out[i] = (np.maximum(P, 0) @ self.v + self.b)[0]
                continue
            if held + len(t) > window:
                flush()
            batch.append(i)
            held += len(t) + gap
        flush()
        return out

    # -- learning --------------------------------------------------------
    def fit(self, texts: Sequence[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.2, weights: np.ndarray | None = None, squares: dict[str, np.ndarray] | None = None) -> TextCNN:
        """Logistic loss by Adagrad; batches are drawn by the seed. squares: sums
        of squared gradients to go on from, which are changed."""
        r = np.random.default_rng(self.seed)
        weights = np.ones(len(texts)) if weights is None else weights
        G = self.squares() if squares is None else squares
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for k in range(0, len(order), batch):
                self._step([texts[i] for i in order[k : k + batch]], y[order[k : k + batch]], weights[order[k : k + batch]], G, rate)
        return self

    def squares(self) -> dict[str, np.ndarray]:
        return {k: np.full_like(a, 1e-2) for k, a in self._params()}

    def step(self, texts: Sequence[np.ndarray], y: Sequence[float], squares: dict[str, np.ndarray], rate: float = 0.2) -> None:
        """One batch, as in `fit`."""
        self._step(texts, np.array(y, float), np.ones(len(texts)), squares, rate)

    def state(self, squares: dict[str, np.ndarray]) -> np.ndarray:
        """All parameters and their squares in one vector."""
        return np.concatenate([*(a.ravel() for _, a in self._params()), [self.b], *(squares[k].ravel() for k, _ in self._params())]).astype(np.float32)

    def load(self, squares: dict[str, np.ndarray], state: np.ndarray) -> None:
        """Take over a vector of `state`, in place."""
        own = [a for _, a in self._params()]
        half = sum(a.size for a in own)
        for at, into in ((0, own), (half + 1, [squares[k] for k, _ in self._params()])):
            for a in into:
                a[...] = state[at : at + a.size].reshape(a.shape)
                at += a.size
        self.b = np.float32(state[half])

    def copied(self) -> TextCNN:
        return copy.deepcopy(self)

    def _params(self):
        yield "E", self.E
        yield "v", self.v
        for k in range(len(self.widths)):
            yield f"W{k}", self.W[k]
            yield f"c{k}", self.c[k]

    def _step(self, texts, y, weight, G, rate) -> None:
        ids, starts = self.flat(texts)
        P, at = self._pooled(ids, starts, want=True)
        A = np.maximum(P, 0)
        d = ((1 / (1 + np.exp(-np.clip(A @ self.v + self.b, -30, 30))) - y) * weight / len(texts)).astype(np.float32)
        dP = np.where(P > 0, d[:, None] * self.v, 0)

        def down(name, a, g, rows=None):
            if rows is None:
                G[name] += g * g
                a -= rate * g / np.sqrt(G[name])
            else:
                G[name][rows] += g * g
                a[rows] -= rate * g / np.sqrt(G[name][rows])

        touched, grads = [], []
        for k, w in enumerate(self.widths):
            g = dP[:, k * self.filters : (k + 1) * self.filters]
            dW = np.zeros_like(self.W[k])
            for j in range(w):
                sym = ids[at[k] + j]  # texts x filters (x columns)
                sym = sym.reshape(*at[k].shape, -1)
                part = slice(j * self.dim, (j + 1) * self.dim)
                dW[part] = np.einsum("tfcd,tf->df", self.E[sym], g)
                each = (g[:, :, None] * self.W[k][part].T[None]).reshape(-1, self.dim)
                for column in range(sym.shape[2]):
                    touched.append(sym[:, :, column].ravel())
                    grads.append(each)
            down(f"W{k}", self.W[k], dW)
            down(f"c{k}", self.c[k], g.sum(0))
        rows, place = np.unique(np.concatenate(touched), return_inverse=True)
        dE = np.zeros((len(rows), self.dim), np.float32)
        np.add.at(dE, place, np.concatenate(grads))
        down("E", self.E, dE, rows)
        self.E[0] = 0
        down("v", self.v, A.T @ d)
        self.b -= np.float32(rate * d.sum())


def calibrate(logits: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, steps: int = 60) -> tuple[float, float]:
    """Platt scaling by Newton steps: (a, b) such that 1 / (1 + exp(-(a x + b)))
    is a probability. With one class only, the smoothed prior is returned."""
    w = np.ones(len(y)) if weights is None else weights
    pos, neg = (w * y).sum(), (w * (1 - y)).sum()
    if not len(y) or pos == 0 or neg == 0:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    X, p = np.stack([logits, np.ones(len(y))], 1), np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(X @ p, -30, 30)))
        H = (X * (w * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ X + 1e-6 * np.eye(2)
        step = np.linalg.solve(H, X.T @ (w * (t - q)))
        p += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def probability(logits: np.ndarray, ab: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(ab[0] * logits + ab[1], -30, 30)))
