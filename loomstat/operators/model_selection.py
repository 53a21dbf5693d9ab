"""Splits as columns, cross-validation and parameter search. Order comes from a hash of a stable row id, never from partitions."""

from __future__ import annotations

import itertools
import math
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.base import NUMERIC
from loomstat.errors import InvalidParameter
from loomstat.operators.metrics import score as score_of

#: Ranges of the hash within which rows are ranked.
RANGES = 256


def shuffled(row_id: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(row_id))


def ranked(df: DataFrame, order: list[Column], name: str, by: list[str] = (), key: Column | None = None) -> DataFrame:
    """df with each row's 0-based rank by `order` (within `by`): ranks within ranges of a key that the order begins with, plus the counts of the ranges before.

    The key is the order's first column scaled to RANGES steps; without one the rows of a group are ranked in one window."""
    if key is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    keyed = df.withColumn("_range", key)
    counts = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return keyed.withColumn("_own", own).join(F.broadcast(before), [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before")


def _value_range(df: DataFrame, column: str) -> Column | None:
    """Steps of equal width from a numeric column's least to its largest value; None for other types, whose rows are ranked in one window."""
    if not isinstance(df.schema[column].dataType, NUMERIC):
        return None
    low, high = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    if low is None or not high > low:
        return None
    return F.floor((F.col(column).cast("double") - low) / ((high - low) * (1 + 1e-12)) * RANGES)


def _hash_range(c: Column) -> Column:
    return F.floor((c.cast("double") / 2.0**64 + 0.5) * RANGES)


def train_test_split(df: DataFrame, row_id: str, test_size: float = 0.25, seed: int = 0, shuffle: bool = True, stratify: str | None = None) -> DataFrame:
    """df with is_test; the test part has ceil(n * test_size) rows (in each stratum, if given), the head of the shuffled order."""
    if not 0 < test_size < 1:
        raise InvalidParameter("test_size is a share between 0 and 1")
    by = [stratify] if stratify else []
    h = shuffled(row_id, seed)
    placed = ranked(df, [h, F.col(row_id)] if shuffle else [F.col(row_id)], "_rank", by, _hash_range(h) if shuffle else _value_range(df, row_id))
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") * test_size).alias("_tests"))
    joined = placed.join(F.broadcast(sizes), by) if by else placed.join(F.broadcast(sizes))
    return joined.withColumn("is_test", F.col("_rank") < F.col("_tests")).drop("_rank", "_tests")


def k_fold(df: DataFrame, row_id: str, k: int = 5, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """df with fold: contiguous chunks of the order, the first n mod k one row longer."""
    if k < 2:
        raise InvalidParameter("k must be 2 or more")
    h = shuffled(row_id, seed)
    placed = ranked(df, [h, F.col(row_id)] if shuffle else [F.col(row_id)], "_rank", [], _hash_range(h) if shuffle else _value_range(df, row_id))
    n = df.agg(F.count("*").alias("_n"))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    head = more * (size + 1)
    fold = F.when(F.col("_rank") < head, F.floor(F.col("_rank") / (size + 1))).otherwise(more + F.floor((F.col("_rank") - head) / F.greatest(size, F.lit(1))))
    return placed.join(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def stratified_k_fold(df: DataFrame, row_id: str, label: str, k: int = 5, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """df with fold: position within the class, modulo k."""
    order = [shuffled(row_id, seed), F.col(row_id)] if shuffle else [F.col(row_id)]
    placed = ranked(df, order, "_rank", [label], _hash_range(shuffled(row_id, seed)) if shuffle else _value_range(df, row_id))
    return placed.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def group_k_fold(df: DataFrame, group: str, k: int | None = None, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """df with fold: groups, shuffled, dealt round-robin; without k each group is a fold."""
    groups = df.select(group).distinct()
    order = [F.xxhash64(F.lit(seed), F.col(group)), F.col(group)] if shuffle else [F.col(group)]
    h = F.xxhash64(F.lit(seed), F.col(group))
    at = ranked(groups, order, "fold", [], _hash_range(h) if shuffle else _value_range(groups, group))
    at = at if k is None else at.withColumn("fold", F.col("fold") % k)
    return df.join(at.withColumn("fold", F.col("fold").cast("int")), group)


def cross_val_score(estimator, df: DataFrame, scoring: str, label: str, prediction: str = "prediction", fold: str = "fold", parallelism: int = 4) -> list[float]:
    """One score a fold, in fold order; folds run as jobs side by side."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())

    def one(k):
        model = estimator.fit(df.where(F.col(fold) != k))
        return score_of(scoring, model.transform(df.where(F.col(fold) == k)), label, prediction)

    with ThreadPool(max(1, min(parallelism, len(folds)))) as pool:
        return pool.map(one, folds)


def grid(**lists) -> list[dict]:
    names = list(lists)
    return [dict(zip(names, values)) for values in itertools.product(*lists.values())]


class GridSearch:
    """Every candidate on every fold; best mean score, NaN last, ties to the earlier candidate."""

    def __init__(self, estimator, candidates: list[dict], scoring: str, label: str, prediction: str = "prediction", error_score: float | None = None, refit: bool = True):
        if not candidates:
            raise InvalidParameter("no candidates")
        self.estimator, self.candidates, self.scoring, self.label, self.prediction, self.error_score, self.refit = estimator, candidates, scoring, label, prediction, error_score, refit

    def _scores(self, candidate: dict, df: DataFrame) -> list[float]:
        try:
            return cross_val_score(self.estimator.copy(**candidate), df, self.scoring, self.label, self.prediction)
        except Exception:
            if self.error_score is None:
                raise
            return [self.error_score]

    def fit(self, df: DataFrame) -> "GridSearch":
        """df has the column fold."""
        self.results_ = []
        for c in self.candidates:
            s = self._scores(c, df)
            mean = sum(s) / len(s)
            self.results_.append({"params": c, "scores": s, "mean": mean, "std": math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))})
        self.best_index_ = min(range(len(self.results_)), key=lambda i: (math.isnan(self.results_[i]["mean"]), -self.results_[i]["mean"] if not math.isnan(self.results_[i]["mean"]) else 0, i))
        self.best_params_ = self.results_[self.best_index_]["params"]
        self.model_ = self.estimator.copy(**self.best_params_).fit(df) if self.refit else None
        return self


def halving_schedule(candidates: int, most: int, factor: int = 3, least: int = 1) -> list[tuple[int, int]]:
    """(resource, candidates) of each round: resources grow by the factor, survivors are ceil(n / factor)."""
    if factor < 2 or least < 1 or most < least:
        raise InvalidParameter("factor 2 or more, 1 <= least <= most")
    out, resource = [], least
    while resource <= most and candidates >= 1:
        out.append((resource, candidates))
        if candidates == 1:
            break
        candidates, resource = math.ceil(candidates / factor), resource * factor
    return out


class HalvingGridSearch(GridSearch):
    """Rounds on growing samples of rows (by hash of row_id); the best share of candidates goes on."""

    def __init__(self, *args, row_id: str, factor: int = 3, least: int = 50, **kw):
        super().__init__(*args, **kw)
        self.row_id, self.factor, self.least = row_id, factor, least

    def fit(self, df: DataFrame) -> "HalvingGridSearch":
        n = df.count()
        alive, self.trace_ = list(range(len(self.candidates))), []
        for resource, size in halving_schedule(len(alive), n, self.factor, min(self.least, n)):
            part = df.orderBy(shuffled(self.row_id, 0), self.row_id).limit(resource)
            means = {i: sum(s) / len(s) for i in alive for s in [self._scores(self.candidates[i], part)]}
            self.trace_.append({"resource": resource, "means": means})
            alive = sorted(alive, key=lambda i: (math.isnan(means[i]), -means[i] if not math.isnan(means[i]) else 0, i))[: math.ceil(size / self.factor)]
        self.best_index_ = alive[0]
        self.best_params_ = self.candidates[alive[0]]
        self.model_ = self.estimator.copy(**self.best_params_).fit(df) if self.refit else None
        return self
