"""PCA, incremental PCA and truncated SVD from Gram aggregates; a randomized range finder for wide tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.base import Model, Params
from loomstat.errors import InvalidParameter
from loomstat.functions.vectors import add_grams, centred, gram


def signed(components: np.ndarray) -> np.ndarray:
    """Each row with its entry of largest size positive."""
    at = np.abs(components).argmax(1)
    s = np.sign(components[np.arange(len(components)), at])
    return components * np.where(s == 0, 1, s)[:, None]


def solver(name: str, n: int, p: int, k: int) -> str:
    if name != "auto":
        return name
    if 5 * k >= 4 * min(n, p):
        return "full"
    if n > 10 * p and p <= 1000:
        return "covariance"
    return "full" if max(n, p) <= 500 else "randomized"


def randomized_eigh(m: np.ndarray, k: int, oversampling: int = 10, power: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Largest k eigenvalues and vectors of a symmetric matrix by a random basis and power iterations."""
    q = np.random.default_rng(seed).normal(size=(len(m), min(len(m), k + oversampling)))
    for _ in range(max(1, power) + 1):
        q = np.linalg.qr(m @ q)[0]
    values, vectors = np.linalg.eigh(q.T @ m @ q)
    order = np.argsort(values)[::-1][:k]
    return values[order], (q @ vectors[:, order]).T


def _top(m: np.ndarray, k: int, how: str) -> tuple[np.ndarray, np.ndarray]:
    if how == "randomized":
        return randomized_eigh(m, k)
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1][:k]
    return values[order], vectors[:, order].T


class PCA(Params):
    """Centred; variances by n - 1; components signed by their largest entry; optional whitening."""

    defaults = {"features": (), "k": 2, "solver": "auto", "whiten": False, "prefix": "pc_"}

    def check(self) -> None:
        if self.solver not in ("auto", "full", "covariance", "randomized"):
            raise InvalidParameter(f"solver {self.solver}")

    def solve(self, g: dict) -> "ProjectionModel":
        p, k = len(self.features), min(self.k, len(self.features))
        scatter, _ = centred(g)
        values, vectors = _top(scatter, k, solver(self.solver, int(g["n"]), p, k))
        values, vectors = np.maximum(values, 0), signed(vectors)
        variance = values / max(1.0, g["n"] - 1)
        total = np.trace(scatter) / max(1.0, g["n"] - 1)
        plain = {a: b.tolist() if isinstance(b, np.ndarray) else b for a, b in g.items()}
        return ProjectionModel(features=list(self.features), mean=g["mean"].tolist(), components=vectors.tolist(), variance=variance.tolist(), ratio=(variance / total if total else variance * 0).tolist(), singular=np.sqrt(values).tolist(), whiten=self.whiten, prefix=self.prefix, gram=plain)

    def fit(self, df: DataFrame) -> "ProjectionModel":
        return self.solve(gram(df, list(self.features)))


class IncrementalPCA(PCA):
    """PCA of batches whose counts, means and scatters add up."""

    def update(self, model: "ProjectionModel", df: DataFrame) -> "ProjectionModel":
        old = {k: np.array(v) if isinstance(v, list) else v for k, v in model.gram.items()}
        return self.solve(add_grams(old, gram(df, list(self.features))))


class TruncatedSVD(Params):
    """Not centred; the explained variance is the population variance of the projections; ratios add up to 1 at most."""

    defaults = {"features": (), "k": 2, "solver": "full", "prefix": "sv_"}

    def fit(self, df: DataFrame) -> "ProjectionModel":
        g = gram(df, list(self.features))
        values, vectors = _top(g["xx"], min(self.k, len(self.features)), self.solver)
        vectors = signed(vectors)
        cov = g["xx"] / g["n"] - np.outer(g["mean"], g["mean"])
        variance = np.einsum("ij,jk,ik->i", vectors, cov, vectors)
        total = np.trace(cov)
        ratio = variance / total if total else variance * 0
        return ProjectionModel(features=list(self.features), mean=[0.0] * len(self.features), components=vectors.tolist(), variance=variance.tolist(), ratio=(ratio / max(1.0, ratio.sum())).tolist(), singular=np.sqrt(np.maximum(values, 0)).tolist(), whiten=False, prefix=self.prefix)


class ProjectionModel(Model):
    def columns(self) -> dict[str, Column]:
        out = {}
        for i, (c, v) in enumerate(zip(self.components, self.variance)):
            e = F.lit(0.0)
            for n, w, m in zip(self.features, c, self.mean):
                e = e + (F.col(n).cast("double") - m) * w
            out[f"{self.prefix}{i}"] = e / (v**0.5 if self.whiten and v > 0 else 1.0)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())

    def inverse(self, df: DataFrame, suffix: str = "_back") -> DataFrame:
        out = {}
        for j, (n, m) in enumerate(zip(self.features, self.mean)):
            e = F.lit(float(m))
            for i, (c, v) in enumerate(zip(self.components, self.variance)):
                e = e + F.col(f"{self.prefix}{i}") * (c[j] * (v**0.5 if self.whiten and v > 0 else 1.0))
            out[f"{n}{suffix}"] = e
        return df.withColumns(out)
