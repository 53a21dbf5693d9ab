"""Imputation of missing values (null or NaN)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from loomstat.base import Model, Params, check_features, number
from loomstat.errors import InvalidParameter, UnexpectedMissingness, UnsupportedOperation


class SimpleImputer(Params):
    """mean, median, most_frequent (ties: smallest) or constant for each column.

    A column without any value is left out, unless keep_empty_features (then 0) or the
    strategy is constant. add_indicator puts a 0/1 column behind for each column that
    had missing values at fit."""

    defaults = {"features": (), "strategy": "mean", "fill_value": 0.0, "keep_empty_features": False, "add_indicator": False, "suffix": "_imputed"}

    def check(self) -> None:
        if self.strategy not in ("mean", "median", "most_frequent", "constant"):
            raise InvalidParameter(f"strategy {self.strategy}")

    def fit(self, df: DataFrame) -> "SimpleImputerModel":
        names = list(self.features)
        check_features(df, names)
        x = [number(n) for n in names]
        pick = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "most_frequent": lambda c: F.mode(c, True), "constant": lambda c: F.first(F.lit(float(self.fill_value)))}[self.strategy]
        row = df.agg(*[pick(c).alias(f"f{i}") for i, c in enumerate(x)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(x)], F.count(F.lit(1)).alias("rows")).first()
        fills = [row[f"f{i}"] for i in range(len(names))]
        if self.strategy == "constant":
            fills = [float(self.fill_value)] * len(names)
        elif self.keep_empty_features:
            fills = [0.0 if f is None else f for f in fills]
        return SimpleImputerModel(features=names, fills=fills, counts=[row[f"n{i}"] for i in range(len(names))], gaps=[row[f"n{i}"] < row["rows"] for i in range(len(names))], add_indicator=self.add_indicator, suffix=self.suffix)


    def update(self, model: "SimpleImputerModel", df: DataFrame) -> "SimpleImputerModel":
        """Means of all batches by their counts; constants stay. Medians and modes need the whole column."""
        if self.strategy not in ("mean", "constant"):
            raise UnsupportedOperation(f"{self.strategy} cannot be updated batch by batch")
        new = self.fit(df)
        fills, counts = [], []
        for a, n, b, m in zip(model.fills, model.counts, new.fills, new.counts):
            fills.append(b if not n else a if not m else (a * n + b * m) / (n + m) if self.strategy == "mean" else a)
            counts.append(n + m)
        return SimpleImputerModel(**{**new.state(), "fills": fills, "counts": counts, "gaps": [x or y for x, y in zip(model.gaps, new.gaps)]})


class SimpleImputerModel(Model):
    def columns(self) -> dict[str, Column]:
        out = {f"{n}{self.suffix}": F.coalesce(number(n), F.lit(f)) for n, f in zip(self.features, self.fills) if f is not None}
        if self.add_indicator:
            out |= {f"{n}_missing": number(n).isNull().cast("double") for n, gap in zip(self.features, self.gaps) if gap}
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


class MissingIndicator(Params):
    """0/1 columns of missingness, of the columns that had any at fit or of all."""

    defaults = {"features": (), "scope": "missing_only", "error_on_new": True}

    def check(self) -> None:
        if self.scope not in ("missing_only", "all"):
            raise InvalidParameter("scope is missing_only or all")

    def fit(self, df: DataFrame) -> "MissingIndicatorModel":
        names = list(self.features)
        check_features(df, names)
        row = df.agg(*[F.max(number(n).isNull()).alias(f"g{i}") for i, n in enumerate(names)]).first()
        gaps = [bool(row[f"g{i}"]) for i in range(len(names))]
        return MissingIndicatorModel(features=names, gaps=gaps, scope=self.scope, error_on_new=self.error_on_new)


class MissingIndicatorModel(Model):
    def columns(self) -> dict[str, Column]:
        return {f"{n}_missing": number(n).isNull().cast("double") for n, gap in zip(self.features, self.gaps) if gap or self.scope == "all"}

    def transform(self, df: DataFrame) -> DataFrame:
        fresh = [n for n, gap in zip(self.features, self.gaps) if not gap]
        if self.error_on_new and self.scope == "missing_only" and fresh:
            row = df.agg(*[F.max(number(n).isNull()).alias(n) for n in fresh]).first()
            for n in fresh:
                if row[n]:
                    raise UnexpectedMissingness(n)
        return df.withColumns(self.columns())


class KNNImputer(Params):
    """A missing cell from the k nearest training rows that have the column, by NaN-Euclidean distance.

    Ties go to the smaller row_id. Without a donor at a finite distance the column's mean stands in, without any donor 0.
    Receivers with the same values are one; what differs meets all training rows in blocks by their number (at least `blocks`),
    and only the k best of a block go on."""

    defaults = {"features": (), "row_id": None, "k": 5, "weights": "uniform", "blocks": 8, "suffix": "_imputed"}

    def check(self) -> None:
        if self.weights not in ("uniform", "distance") or self.k < 1 or self.row_id is None:
            raise InvalidParameter("weights is uniform or distance, k at least 1, row_id given")

    def fit_transform(self, train: DataFrame, df: DataFrame | None = None) -> DataFrame:
        df = train if df is None else df
        names = list(self.features)
        check_features(train, names)
        means = train.agg(*[F.avg(number(n)).alias(n) for n in names]).first()
        gaps = " or ".join(f"`{n}` is null" for n in names)
        receivers = df.select(*[number(n).alias(n) for n in names]).where(gaps).distinct().select(F.struct(*names).alias("_r"))
        asked, n = receivers.count(), train.count()
        blocks, parts = max(self.blocks, -(-n // DONORS)), max(1, -(-asked // RECEIVERS))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
        cells = F.array(*[number(n) for n in names])
        donors = train.select(F.col(self.row_id).alias("_donor"), cells.alias("_v"), F.lit(True).alias("_d"), own(self.row_id, blocks).alias("_block"), every(parts).alias("_part"))
        met = receivers.select(F.lit(None).cast(donors.schema["_donor"].dataType).alias("_donor"), F.array(*[F.col("_r")[n] for n in names]).alias("_v"), F.lit(False).alias("_d"), every(blocks).alias("_block"), own("_r", parts).alias("_part")).unionByName(donors)
        pairs = met.repartition(blocks * parts, "_part", "_block").groupBy("_part", "_block").applyInArrow(nearest_donors(self.k, len(names)), StructType([
            StructField("_v", ArrayType(DoubleType())), StructField("_n", IntegerType()), StructField("_donor", donors.schema["_donor"].dataType), StructField("_distance", DoubleType()), StructField("_value", DoubleType())]))
        order = Window.partitionBy("_v", "_n").orderBy("_distance", "_donor")
        near = pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= self.k)
        value, w = F.col("_value"), F.when(F.col("_distance") > 0, 1 / F.col("_distance"))
        exact = F.sum(F.when(F.col("_distance") == 0, 1.0).otherwise(0.0))
        mean = F.avg(value) if self.weights == "uniform" else F.when(exact > 0, F.sum(F.when(F.col("_distance") == 0, value).otherwise(0.0)) / exact).otherwise(F.sum(value * w) / F.sum(w))
        found = near.groupBy("_v", "_n").agg(mean.alias("_m")).groupBy("_v").agg(*[F.max(F.when(F.col("_n") == i, F.col("_m"))).alias(f"_fill_{n}") for i, n in enumerate(names)])
        key = df.withColumn("_v", F.when(F.exists(cells, lambda x: x.isNull()), cells))
        fills = {f"{n}{self.suffix}": F.coalesce(number(n), F.col(f"_fill_{n}"), F.lit(means[n] if means[n] is not None else 0.0)) for n in names}
        return key.join(found, "_v", "left").withColumns(fills).select(self.row_id, *[c for c in df.columns if c != self.row_id], *[c for c in fills if c not in df.columns])


#: Training rows of a block, and different receivers that meet it.
DONORS, RECEIVERS = 65_536, 16_384


def nearest_donors(k: int, p: int):
    """For a group of receivers and donors: each receiver's k nearest donors by (distance, id) for each of its gaps."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        donors, asked = table.filter(table.column("_d")), table.filter(pc.invert(table.column("_d"))).combine_chunks()
        donors = donors.take(pc.sort_indices(donors, sort_keys=[("_donor", "ascending")], null_placement="at_start")).combine_chunks()
        if not asked.num_rows or not donors.num_rows:
            return
        matrix = lambda t: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("_v").chunks]).reshape(-1, p)
        q, x = matrix(asked), np.ascontiguousarray(matrix(donors).T)
        keys, ids = pa.concat_arrays(asked.column("_v").chunks), pa.concat_arrays(donors.column("_donor").chunks)
        here = ~np.isnan(x)
        out, size = [], 0
        for i, row in enumerate(q):
            squares, both = np.zeros(x.shape[1]), np.zeros(x.shape[1], np.int64)
            for j in np.flatnonzero(~np.isnan(row)):
                squares += np.where(here[j], (x[j] - row[j]) ** 2, 0.0)
                both += here[j]
            with np.errstate(all="ignore"):
                d = np.sqrt(squares * p / both)  # without a common value NaN
            for j in np.flatnonzero(np.isnan(row)):
                at = np.flatnonzero(here[j] & (both > 0))
                own = d[at]
                if len(at) > k:  # all that tie with the k-th, in order of their ids
                    own = own[few := np.flatnonzero(~(own > np.partition(own, k - 1)[k - 1]))]
                    at = at[few]
                best = np.argsort(own, kind="stable")[:k]
                out.append((np.full(len(best), i), np.full(len(best), j, np.int32), at[best], own[best], x[j, at[best]]))
                size += len(best)
            if size and (size > 10_000 or i == len(q) - 1):
                of, gap, place, far, value = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(gap), ids.take(pa.array(place)), pa.array(far), pa.array(value)], names=["_v", "_n", "_donor", "_distance", "_value"])
                out, size = [], 0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search(batches)

    return nearest
