"""Isolation forest: each tree grows on a bounded sample of rows, scoring is a broadcast of the trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from loomstat.base import Model, Params, check_features
from loomstat.errors import EmptyInput, InvalidParameter

#: Above this the harmonic number is taken from its expansion.
EXACT_HARMONIC = 2048


def average_path(n: int) -> float:
    """Mean depth at which an unsuccessful search of n rows ends."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    m = n - 1
    h = sum(1 / i for i in range(1, m + 1)) if m <= EXACT_HARMONIC else math.log(m) + 0.5772156649015329 + 1 / (2 * m)
    return 2 * h - 2 * m / n


class IsolationForest(Params):
    """anomaly = 2^(-mean depth / c); score = -anomaly; decision = score - offset, below 0 an outlier (label -1)."""

    defaults = {"features": (), "row_id": None, "trees": 100, "max_samples": 256, "contamination": "auto", "seed": 0}

    def check(self) -> None:
        if self.row_id is None or self.trees < 1 or self.contamination != "auto" and not 0 < self.contamination <= 0.5:
            raise InvalidParameter("row_id given, trees positive, contamination auto or in (0, 0.5]")

    def fit(self, df: DataFrame) -> "IsolationModel":
        names = list(self.features)
        check_features(df, names)
        # one bounded sample, from which each tree takes its own part
        most = self.max_samples * min(self.trees, 64)
        rows = df.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(self.row_id).alias("_id")).orderBy(F.xxhash64(F.lit(self.seed), "_id"), "_id").limit(most).collect()
        if not rows:
            raise EmptyInput("no rows")
        x = np.array([[r[n] for n in names] for r in rows], float)
        rng = np.random.default_rng(self.seed)
        m = min(self.max_samples, len(x))
        depth = math.ceil(math.log2(max(2, m)))
        trees = [self._grow(x[rng.choice(len(x), m, replace=False)], rng, depth) for _ in range(self.trees)]
        model = IsolationModel(features=names, trees=trees, c=average_path(m) or 1.0, offset=-0.5)
        if self.contamination != "auto":
            model.offset = model.scores(df).agg(F.percentile("score", F.lit(float(self.contamination)))).first()[0]
        return model

    def _grow(self, x: np.ndarray, rng, limit: int) -> list:
        nodes: list = []

        def build(rows, depth):
            at = len(nodes)
            nodes.append(None)
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if depth >= limit or not len(spread):
                nodes[at] = [-1, 0.0, 0, 0, depth + average_path(len(rows))]
                return at
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            left = rows[:, f] <= cut
            a = build(rows[left], depth + 1)
            b = build(rows[~left], depth + 1)
            nodes[at] = [f, cut, a, b, 0.0]
            return at

        build(x, 0)
        return nodes


class IsolationModel(Model):
    def scores(self, df: DataFrame, name: str = "score") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.features, self.trees, self.c))

        def run(batches):
            features, trees, c = shared.value
            packed = [np.array(t, float) for t in trees]
            for b in batches:
                x = np.column_stack([p.cast(pa.float64()).to_numpy(zero_copy_only=False) for p in (b.column(f) for f in features)])
                total = np.zeros(len(x))
                for t in packed:
                    at, live = np.zeros(len(x), int), np.arange(len(x))
                    while len(live):
                        n = t[at[live]]
                        inner = n[:, 0] >= 0
                        total[live[~inner]] += n[~inner, 4]
                        live, n = live[inner], n[inner]
                        at[live] = np.where(x[live, n[:, 0].astype(int)] <= n[:, 1], n[:, 2], n[:, 3]).astype(int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(-(2.0 ** (-(total / len(packed)) / c)))], names=[*b.schema.names, name])

        return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, DoubleType()))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scores(df).withColumn("decision", F.col("score") - self.offset).withColumn("outlier", F.when(F.col("decision") < 0, -1).otherwise(1))
