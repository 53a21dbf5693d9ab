"""Distances and kernels of array columns, as expressions; Gram matrices as aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.base import check_features, check_guard, finite_guard
from loomstat.errors import InvalidParameter


def vector(names: list[str]) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def squared_euclidean(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def chebyshev(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: F.greatest(s, x))


def cosine(a, b) -> Column:
    """1 - cosine; a vector of norm 0 is at distance 1 from all."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(1.0)


def nan_euclidean(a, b) -> Column:
    """Over the components present in both (null or NaN are missing), scaled up to all; NaN without any."""
    there = lambda x: x.isNotNull() & ~F.isnan(x)
    squares = F.filter(F.zip_with(_col(a), _col(b), lambda x, y: F.when(there(x) & there(y), (x - y) * (x - y))), lambda v: v.isNotNull())
    return F.when(F.size(squares) > 0, F.sqrt(_sum(squares) * F.size(_col(a)) / F.size(squares))).otherwise(F.lit(float("nan")))


METRICS = {"euclidean": euclidean, "squared_euclidean": squared_euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "cosine": cosine, "nan_euclidean": nan_euclidean}


def distance(metric: str, a, b) -> Column:
    if metric not in METRICS:
        raise InvalidParameter(f"no metric {metric}")
    return METRICS[metric](a, b)


def kernel(name: str, a, b, gamma: float = 1.0, coef0: float = 0.0, degree: float = 3.0) -> Column:
    if name == "linear":
        return dot(a, b)
    if name == "polynomial":
        return F.pow(dot(a, b) * gamma + coef0, F.lit(float(degree)))
    if name == "rbf":
        return F.exp(squared_euclidean(a, b) * -gamma)
    if name == "sigmoid":
        return F.tanh(dot(a, b) * gamma + coef0)
    raise InvalidParameter(f"no kernel {name}")


def gamma_scale(df: DataFrame, features: list[str]) -> float:
    """1 / (p * variance of all cells)."""
    cells = df.select(F.explode(vector(features)).alias("x")).agg(F.var_pop("x").alias("v")).first()
    return 1.0 / (len(features) * cells.v) if cells.v else 1.0


#: Products that are summed as plain aggregate columns; more go through Arrow batches.
MOST_COLUMNS = 300


def gram(df: DataFrame, features: list[str], target: str | None = None, weight: str | None = None) -> dict:
    """One job: n (sum of weights), mean, X'X, and with a target X'y, y'y, mean of y. Not centred."""
    check_features(df, [*features, *([target] if target else [])])
    names = [*features, *([target] if target else [])]
    p = len(names)
    x = [F.col(n).cast("double") for n in names]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    s, m = np.zeros((p, p)), np.zeros(p)
    if len(pairs) <= MOST_COLUMNS:
        row = df.agg(*finite_guard(names), F.sum(w).alias("w"), *[F.sum(w * x[i]).alias(f"m{i}") for i in range(p)], *[F.sum(w * x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
        check_guard(row, names)
        n = row["w"]
        for i in range(p):
            m[i] = row[f"m{i}"]
        for i, j in pairs:
            s[i, j] = s[j, i] = row[f"s{i}_{j}"]
    else:
        guard = df.agg(*finite_guard(names)).first()
        check_guard(guard, names)

        def partial(batches):
            total = np.zeros((p + 1, p + 1))
            for b in batches:
                a = np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]]])
                total += (a * b.columns[-1].to_numpy(zero_copy_only=False)[:, None]).T @ a
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

        cells = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], w.alias("w")).mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        full = np.zeros((p + 1) ** 2)
        for r in cells:
            full[r.k] = r.v
        full = full.reshape(p + 1, p + 1)
        n, m, s = full[0, 0], full[0, 1:], full[1:, 1:]
    k = len(features)
    out = {"n": float(n), "mean": m[:k] / n, "xx": s[:k, :k]}
    if target:
        out |= {"xy": s[:k, k], "yy": float(s[k, k]), "y_mean": float(m[k] / n)}
    return out


def centred(g: dict) -> tuple[np.ndarray, np.ndarray | None]:
    xx = g["xx"] - g["n"] * np.outer(g["mean"], g["mean"])
    return xx, (g["xy"] - g["n"] * g["mean"] * g["y_mean"] if "xy" in g else None)


def add_grams(a: dict, b: dict) -> dict:
    """Merge of two Gram states."""
    n = a["n"] + b["n"]
    out = {"n": n, "mean": (a["mean"] * a["n"] + b["mean"] * b["n"]) / n, "xx": a["xx"] + b["xx"]}
    if "xy" in a:
        out |= {"xy": a["xy"] + b["xy"], "yy": a["yy"] + b["yy"], "y_mean": (a["y_mean"] * a["n"] + b["y_mean"] * b["n"]) / n}
    return out
