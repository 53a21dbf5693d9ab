"""Scalers, one-hot encoding and polynomial features: one aggregate to fit, column expressions to transform."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.base import Model, Params, check_features, check_guard, finite_guard
from loomstat.errors import InvalidParameter, UnknownLabel, UnsupportedOperation
from loomstat.functions.sparse import of_cells, sparse


def _scaled(names: list[str], suffix: str) -> list[str]:
    return [f"{n}{suffix}" for n in names]


class StandardScaler(Params):
    """z = (x - mean) / population deviation; a column without spread is divided by 1."""

    defaults = {"features": (), "with_mean": True, "with_std": True, "suffix": "_scaled"}

    def fit(self, df: DataFrame) -> "StandardScalerModel":
        names = list(self.features)
        check_features(df, names)
        x = [F.col(n).cast("double") for n in names]
        row = df.agg(*finite_guard(names), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)]).first()
        check_guard(row, names)
        return StandardScalerModel(features=names, with_mean=self.with_mean, with_std=self.with_std, suffix=self.suffix, count=row["_rows"], mean=[row[f"m{i}"] for i in range(len(x))], m2=[row[f"v{i}"] * row["_rows"] for i in range(len(x))])


class StandardScalerModel(Model):
    def update(self, df: DataFrame) -> "StandardScalerModel":
        """Merge another batch's count, mean and squared deviations."""
        new = StandardScaler(features=self.features, with_mean=self.with_mean, with_std=self.with_std, suffix=self.suffix).fit(df)
        n = self.count + new.count
        gaps = [b - a for a, b in zip(self.mean, new.mean)]
        mean = [a + g * new.count / n for a, g in zip(self.mean, gaps)]
        m2 = [a + b + g * g * self.count * new.count / n for a, b, g in zip(self.m2, new.m2, gaps)]
        return StandardScalerModel(**{**self.state(), "count": n, "mean": mean, "m2": m2})

    def scale(self) -> list[float]:
        return [s if (s := math.sqrt(max(0.0, m / self.count))) > 0 else 1.0 for m in self.m2]

    def columns(self) -> dict[str, Column]:
        out = {}
        for n, to, m, s in zip(self.features, _scaled(self.features, self.suffix), self.mean, self.scale()):
            c = F.col(n).cast("double")
            c = c - m if self.with_mean else c
            out[to] = c / s if self.with_std else c
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())

    def inverse_columns(self) -> dict[str, Column]:
        out = {}
        for n, to, m, s in zip(self.features, _scaled(self.features, self.suffix), self.mean, self.scale()):
            c = F.col(to) * s if self.with_std else F.col(to)
            out[n] = c + m if self.with_mean else c
        return out


class MinMaxScaler(Params):
    """y = low + (x - min) * span / range; a column of one value is multiplied by the span."""

    defaults = {"features": (), "low": 0.0, "high": 1.0, "clip": False, "suffix": "_scaled"}

    def check(self) -> None:
        if not self.low < self.high:
            raise InvalidParameter("low must be below high")

    def fit(self, df: DataFrame) -> "MinMaxScalerModel":
        names = list(self.features)
        check_features(df, names)
        row = df.agg(*finite_guard(names), *[f(F.col(n).cast("double")).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("a", F.min), ("b", F.max))]).first()
        check_guard(row, names)
        return MinMaxScalerModel(**{**self.params(), "features": names}, least=[row[f"a{i}"] for i in range(len(names))], most=[row[f"b{i}"] for i in range(len(names))])


class MinMaxScalerModel(Model):
    def update(self, df: DataFrame) -> "MinMaxScalerModel":
        new = MinMaxScaler(features=self.features).fit(df)
        return MinMaxScalerModel(**{**self.state(), "least": list(map(min, self.least, new.least)), "most": list(map(max, self.most, new.most))})

    def columns(self) -> dict[str, Column]:
        out = {}
        for n, to, a, b in zip(self.features, _scaled(self.features, self.suffix), self.least, self.most):
            c = (F.col(n).cast("double") - a) * ((self.high - self.low) / (b - a) if b > a else self.high - self.low) + self.low
            out[to] = F.least(F.greatest(c, F.lit(self.low)), F.lit(self.high)) if self.clip else c
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


class RobustScaler(Params):
    """(x - median) / (upper - lower quantile), quantiles interpolated linearly; a span that is not positive counts 1."""

    defaults = {"features": (), "with_centering": True, "with_scaling": True, "lower": 25.0, "upper": 75.0, "unit_variance": False, "suffix": "_scaled", "sketch": False}

    def check(self) -> None:
        if not 0 <= self.lower < self.upper <= 100:
            raise InvalidParameter("quantiles must satisfy 0 <= lower < upper <= 100")

    def _sketched(self, df: DataFrame, old: list[str] | None = None) -> "RobustScalerModel":
        """Quantiles of mergeable sketches of bounded size; old ones (base64) are merged in."""
        names = list(self.features)
        check_features(df, names)
        row = df.agg(*finite_guard(names), *[F.kll_sketch_agg_double(F.col(n).cast("double"), F.lit(800)).alias(f"k{i}") for i, n in enumerate(names)])
        merged = {f"k{i}": F.col(f"k{i}") if old is None else F.kll_sketch_merge_double(F.col(f"k{i}"), F.unbase64(F.lit(old[i]))) for i in range(len(names))}
        row = row.withColumns(merged)
        ranks = (self.lower / 100, 0.5, self.upper / 100)
        got = row.select("_rows", *[f"_bad_{i}" for i in range(len(names))], *[F.base64(f"k{i}").alias(f"s{i}") for i in range(len(names))], *[F.kll_sketch_get_quantile_double(f"k{i}", F.lit(r)).alias(f"q{i}_{j}") for i in range(len(names)) for j, r in enumerate(ranks)]).first()
        check_guard(got, names)
        return RobustScalerModel(**{**self.params(), "features": names}, quantiles=[[got[f"q{i}_{j}"] for j in range(3)] for i in range(len(names))], sketches=[got[f"s{i}"] for i in range(len(names))])

    def fit(self, df: DataFrame) -> "RobustScalerModel":
        if self.sketch:
            return self._sketched(df)
        names = list(self.features)
        check_features(df, names)
        at = F.array(F.lit(self.lower / 100), F.lit(0.5), F.lit(self.upper / 100))
        row = df.agg(*finite_guard(names), *[F.percentile(F.col(n).cast("double"), at).alias(f"q{i}") for i, n in enumerate(names)]).first()
        check_guard(row, names)
        return RobustScalerModel(**{**self.params(), "features": names}, quantiles=[list(row[f"q{i}"]) for i in range(len(names))])


class RobustScalerModel(Model):
    def update(self, df: DataFrame) -> "RobustScalerModel":
        """Another batch; only models that were fitted with sketch=True keep what this needs."""
        if not getattr(self, "sketches", None):
            raise UnsupportedOperation("fit with sketch=True to update")
        own = RobustScaler(**{k: getattr(self, k) for k in RobustScaler.defaults})
        return own._sketched(df, self.sketches)

    def scale(self) -> list[float]:
        normal = NormalDist()
        unit = normal.inv_cdf(self.upper / 100) - normal.inv_cdf(self.lower / 100) if self.unit_variance else 1.0
        return [(q[2] - q[0]) / unit if q[2] > q[0] else 1.0 for q in self.quantiles]

    def columns(self) -> dict[str, Column]:
        out = {}
        for n, to, q, s in zip(self.features, _scaled(self.features, self.suffix), self.quantiles, self.scale()):
            c = F.col(n).cast("double")
            c = c - q[1] if self.with_centering else c
            out[to] = c / s if self.with_scaling else c
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


def label_table(df: DataFrame, column: str, row_id: str) -> list:
    """Distinct values of a column, null aside, in the order of their first row."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("_at"))
    return [r[0] for r in first.orderBy("_at", column).select(column).collect()]


class OneHotEncoder(Params):
    """A column of 0 and 1 for each category, in the order of first occurrence by row_id; null is all zeros.

    sparse_output names one column of sparse rows instead."""

    defaults = {"features": (), "row_id": None, "handle_unknown": "reject", "sparse_output": None}

    def check(self) -> None:
        if self.handle_unknown not in ("reject", "ignore"):
            raise InvalidParameter("handle_unknown is reject or ignore")
        if self.row_id is None:
            raise InvalidParameter("row_id gives the order of first occurrence")

    def fit(self, df: DataFrame) -> "OneHotEncoderModel":
        check_features(df, list(self.features), numeric=False)
        return OneHotEncoderModel(features=list(self.features), handle_unknown=self.handle_unknown, sparse_output=self.sparse_output, categories=[label_table(df, n, self.row_id) for n in self.features])


class OneHotEncoderModel(Model):
    def update(self, df: DataFrame, row_id: str) -> "OneHotEncoderModel":
        """Categories of another batch go behind those known."""
        more = [[v for v in label_table(df, n, row_id) if v not in known] for n, known in zip(self.features, self.categories)]
        return OneHotEncoderModel(**{**self.state(), "categories": [a + b for a, b in zip(self.categories, more)]})

    def names(self) -> list[str]:
        return [f"{n}_{i}" for n, c in zip(self.features, self.categories) for i in range(len(c))]

    def _sparse(self) -> Column:
        cells, at = [], 0
        for n, known in zip(self.features, self.categories):
            place = F.array_position(F.array(*map(F.lit, known)), F.col(n)) if known else F.lit(0)
            cells.append(F.struct((place - 1 + at).cast("int").alias("i"), F.lit(1.0).alias("v"), (F.coalesce(place, F.lit(0)) > 0).alias("there")))
            at += len(known)
        return of_cells(at, F.filter(F.array(*cells), lambda c: c.there))

    def columns(self) -> dict[str, Column]:
        if self.sparse_output:
            return {self.sparse_output: self._sparse()}
        values = [(n, v) for n, c in zip(self.features, self.categories) for v in c]
        return {to: F.coalesce((F.col(n) == F.lit(v)).cast("double"), F.lit(0.0)) for to, (n, v) in zip(self.names(), values)}

    def transform(self, df: DataFrame) -> DataFrame:
        if self.handle_unknown == "reject":
            for n, known in zip(self.features, self.categories):
                odd = df.where(F.col(n).isNotNull() & ~F.col(n).isin(known)).select(n).first()
                if odd is not None:
                    raise UnknownLabel(f"{n}: {odd[0]!r}")
        return df.withColumns(self.columns())


class PolynomialFeatures(Params):
    """Products of features up to a degree: by degree, then in lexicographic order of feature positions.

    sparse_output names one column of sparse rows instead of a column for each product."""

    defaults = {"features": (), "degree": 2, "interaction_only": False, "include_bias": True, "prefix": "poly_", "sparse_output": None}

    def check(self) -> None:
        if self.degree < 0:
            raise InvalidParameter("degree must not be negative")

    def terms(self) -> list[tuple[int, ...]]:
        pick = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        start = 0 if self.include_bias else 1
        return [t for d in range(start, self.degree + 1) for t in pick(range(len(self.features)), d)]

    def fit(self, df: DataFrame) -> "PolynomialFeatures":
        check_features(df, list(self.features))
        return self

    def columns(self) -> dict[str, Column]:
        out = {}
        for k, term in enumerate(self.terms()):
            c = F.lit(1.0)
            for i in term:
                c = c * F.col(self.features[i]).cast("double")
            out[f"{self.prefix}{k}"] = c
        return {self.sparse_output: sparse(F.array(*out.values()))} if self.sparse_output else out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())
