"""Metrics over label and score columns: each is a DataFrame of aggregates, so it stays lazy and mergeable."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomstat.base import Model
from loomstat.errors import EmptyInput, InvalidParameter
from loomstat.functions import vectors as V
from loomstat.functions.blocks import Tile

EPSILON = 2.220446049250313e-16


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """label, prediction, n of the pairs that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """All pairs over the sorted union of labels, zeros included."""
    cells = confusion(df, label, prediction)
    names = cells.select(F.explode(F.array("label", "prediction")).alias("label")).distinct()
    # labels are few: what is paired here are the rows of an aggregate
    grid = names.agg(F.sort_array(F.collect_set("label")).alias("all")).select(F.explode("all").alias("label"), "all").select("label", F.explode("all").alias("prediction"))
    return grid.join(cells, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """label, support, precision, recall, f1; 0/0 is 0."""
    sides = confusion(df, label, prediction).select(F.explode(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    t = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return t.select("label", "support", "predicted", "hit", ratio(F.col("hit"), F.col("predicted")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"))


def precision_recall_f1(df: DataFrame, label: str, prediction: str, average: str = "macro", positive=1) -> DataFrame:
    t = per_class(df, label, prediction)
    three = ("precision", "recall", "f1")
    if average == "macro":
        return t.agg(*[F.avg(m).alias(m) for m in three])
    if average == "weighted":
        return t.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in three])
    if average == "micro":
        return t.agg((F.sum("hit") / F.sum("support")).alias("precision")).select("precision", F.col("precision").alias("recall"), F.col("precision").alias("f1"))
    if average == "binary":
        return t.where(F.col("label") == F.lit(positive)).select(*three)
    raise InvalidParameter(f"average {average}")


def balanced_accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return per_class(df, label, prediction).where("support > 0").agg(F.avg("recall").alias("balanced_accuracy"))


def matthews(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Multiclass correlation coefficient; 0 where it is not defined."""
    t = per_class(df, label, prediction).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in ("hit", "support")], *[F.sum(e.cast("double")).alias(n) for n, e in (("tp", F.col("support") * F.col("predicted")), ("tt", F.col("support") * F.col("support")), ("pp", F.col("predicted") * F.col("predicted")))])
    s2 = F.col("support") * F.col("support")
    spread = (s2 - F.col("pp")) * (s2 - F.col("tt"))
    return t.select(F.when(spread > 0, (F.col("hit") * F.col("support") - F.col("tp")) / F.sqrt(spread)).otherwise(0.0).alias("mcc"))


def regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mse, rmse, mae, r2; with a constant target r2 is 1 if exact, else 0."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    t = df.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("v"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return t.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def _counts(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """score, p, n: positives and negatives of each distinct score. Everything after works on these."""
    hit = (F.col(label) == F.lit(positive)).cast("long")
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("n"))


#: Ranges that running sums over scores are cut into.
RANGES = 64


def _cumulated(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Per distinct score tp and fp of scores at least as high, and the totals.

    Running sums go range by range of scores: sums within a range, plus the totals of the
    ranges above, so that no task sees all scores."""
    counts = _counts(df, label, score, positive)
    cuts = df.agg(F.percentile_approx(F.col(score).cast("double"), F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 10_000).alias("cuts"))
    placed = counts.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")
    totals = placed.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    whole = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = totals.select("range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"), F.sum("rp").over(whole).alias("all_p"), F.sum("rn").over(whole).alias("all_n"))
    own = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("wp", F.sum("p").over(own)).withColumn("wn", F.sum("n").over(own)).join(F.broadcast(base), "range").select("score", "p", "n", (F.col("bp") + F.col("wp")).alias("tp"), (F.col("bn") + F.col("wn")).alias("fp"), "all_p", "all_n")


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """threshold, fpr, tpr for each distinct score; no point for the empty prediction."""
    return _cumulated(df, label, score, positive).select(F.col("score").alias("threshold"), (F.col("fp") / F.col("all_n")).alias("fpr"), (F.col("tp") / F.col("all_p")).alias("tpr"))


def auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties by half."""
    return _cumulated(df, label, score, positive).agg((F.sum(F.col("p").cast("double") * (F.col("all_n") - F.col("fp") + F.col("n") / 2.0)) / F.first(F.col("all_p").cast("double") * F.col("all_n"))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    return _cumulated(df, label, score, positive).agg(F.sum(F.col("p") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def precision_recall_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    return _cumulated(df, label, score, positive).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("all_p")).alias("recall"))


def multiclass_auc(df: DataFrame, label: str, scores: dict, average: str = "macro") -> DataFrame:
    """One-vs-rest AUC; scores maps each class to its score column."""
    each = None
    for value, column in scores.items():
        one = _cumulated(df, label, column, value).agg((F.sum(F.col("p").cast("double") * (F.col("all_n") - F.col("fp") + F.col("n") / 2.0)) / F.first(F.col("all_p").cast("double") * F.col("all_n"))).alias("auc"), F.first("all_p").alias("support"))
        each = one if each is None else each.unionByName(one)
    if average == "macro":
        return each.agg(F.avg("auc").alias("auc"))
    if average == "weighted":
        return each.agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"))
    if average == "micro":
        pairs = df.select(F.explode(F.array(*[F.struct((F.col(label) == F.lit(v)).cast("int").alias("y"), F.col(c).cast("double").alias("s")) for v, c in scores.items()])).alias("x")).select("x.y", "x.s")
        return auc(pairs, "y", "s")
    raise InvalidParameter(f"average {average}")


def log_loss(df: DataFrame, label: str, probability: str, positive=1) -> DataFrame:
    p = F.least(F.greatest(F.col(probability).cast("double"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.agg(F.avg(F.when(F.col(label) == F.lit(positive), -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def multiclass_log_loss(df: DataFrame, label: str, probabilities: dict) -> DataFrame:
    p = F.coalesce(*[F.when(F.col(label) == F.lit(v), F.col(c).cast("double")) for v, c in probabilities.items()])
    return df.agg(F.avg(-F.log(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON)))).alias("log_loss"))


# --- clusterings ---


def _centroids(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    return df.where(F.col(cluster) >= 0).groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)])


def calinski_harabasz(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """Between over within dispersion, each by its degrees of freedom; noise (below 0) is left out."""
    parts = df.where(F.col(cluster) >= 0).groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), *[a.alias(k) for i, f in enumerate(features) for k, a in ((f"m{i}", F.avg(F.col(f).cast("double"))), (f"v{i}", F.var_pop(F.col(f).cast("double"))))])
    d = range(len(features))
    t = parts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * sum((F.col(f"v{i}") for i in d), F.lit(0.0))).alias("within"), *[F.sum(F.col("n") * F.col(f"m{i}")).alias(f"s{i}") for i in d], F.sum(F.col("n") * sum((F.col(f"m{i}") * F.col(f"m{i}") for i in d), F.lit(0.0))).alias("q"))
    between = F.col("q") - sum((F.col(f"s{i}") * F.col(f"s{i}") for i in d), F.lit(0.0)) / F.col("n")
    return t.select(F.when(F.col("within") > 0, between / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).otherwise(F.lit(math.inf)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to centre distance."""
    cents = _centroids(df, features, cluster)
    d = range(len(features))
    gap = F.sqrt(sum(((F.col(f).cast("double") - F.col(f"m{i}")) * (F.col(f).cast("double") - F.col(f"m{i}")) for i, f in enumerate(features)), F.lit(0.0)))
    s = df.where(F.col(cluster) >= 0).join(cents, F.col(cluster) == F.col("c")).groupBy("c").agg(F.avg(gap).alias("s"), *[F.first(f"m{i}").alias(f"m{i}") for i in d])
    packed = s.agg(F.collect_list(F.struct("c", "s", F.array(*[f"m{i}" for i in d]).alias("m"))).alias("all"))  # a row for each cluster
    pairs = packed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.c <> b.c")
    distance = F.sqrt(F.aggregate(F.zip_with("a.m", "b.m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda p, q: p + q))
    ratio = F.when(distance > 0, (F.col("a.s") + F.col("b.s")) / distance).otherwise(F.lit(math.inf))
    return pairs.groupBy("a.c").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


#: Rows of a block whose silhouettes are summed, rows that they meet at most, and cells of such a block.
SILHOUETTE_ROWS, SILHOUETTE_OTHERS, SILHOUETTE_CELLS = 4096, 65_536, 1 << 22


def silhouette_samples(df: DataFrame, features: list[str], cluster: str, row_id: str, blocks: int = 1) -> DataFrame:
    """row_id, cluster, silhouette by Euclidean distance; noise is left out, a row alone in its cluster has 0.

    Every row meets every other; both sides are dealt into blocks by their number (at least `blocks`), and only sums per row
    and cluster leave a task. Rows with a null feature have 0 and count for no other row."""
    p = len(features)
    x = df.where(F.col(cluster) >= 0).select(F.col(row_id).alias("id"), F.col(cluster).alias("c"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    whole = x.where(" and ".join(f"v[{i}] is not null" for i in range(p)))
    n = whole.count()
    blocks, parts = max(1, blocks, -(-n // max(1, min(SILHOUETTE_OTHERS, SILHOUETTE_CELLS // p)))), max(1, -(-n // SILHOUETTE_ROWS))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda k: F.pmod(F.xxhash64("id", "v"), F.lit(k)).cast("int")
    met = whole.select("*", F.lit(True).alias("_a"), own(parts).alias("_p"), every(blocks).alias("_b")).unionByName(whole.select("*", F.lit(False).alias("_a"), every(parts).alias("_p"), own(blocks).alias("_b")))
    kinds = x.schema
    schema = StructType([StructField("id", kinds["id"].dataType), StructField("c", kinds["c"].dataType), StructField("c2", kinds["c"].dataType), StructField("s", DoubleType()), StructField("n", LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asked, others = (table.filter(m).combine_chunks() for m in (table.column("_a"), pc.invert(table.column("_a"))))
        if not asked.num_rows or not others.num_rows:
            return
        matrix = lambda t: pa.concat_arrays(t.column("v").chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        coded = pa.concat_arrays(others.column("c").chunks).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        q, y, codes = matrix(asked), matrix(others)[order], codes[order]
        sizes = np.bincount(codes, minlength=len(coded.dictionary))
        ids, own_c = pa.concat_arrays(asked.column("id").chunks), pa.concat_arrays(asked.column("c").chunks)
        strips = [(at, codes[at : at + 2048]) for at in range(0, len(y), 2048)]
        strips = [(np.ascontiguousarray(y[at : at + 2048].T), starts := np.r_[0, np.flatnonzero(np.diff(k)) + 1], k[starts]) for at, k in strips]
        for i in range(0, len(q), 16):
            a = q[i : i + 16]
            out = np.zeros((len(a), len(sizes)))
            for w, starts, k in strips:
                out[:, k] += np.add.reduceat(euclidean(a, w), starts, axis=1)
            row, of = np.repeat(np.arange(i, i + len(a)), len(sizes)), np.tile(np.arange(len(sizes)), len(a))
            columns = [ids.take(pa.array(row)), own_c.take(pa.array(row)), coded.dictionary.take(pa.array(of)), pa.array(out.ravel()), pa.array(sizes[of])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # rows of one id do not meet; usually that is the row itself
    same = whole.alias("a").join(whole.alias("b"), F.col("a.id") == F.col("b.id")).select("a.id", "a.c", F.col("b.c").alias("c2"), (-V.euclidean("a.v", "b.v")).alias("s"), F.lit(-1).cast("long").alias("n"))
    found = met.repartition(blocks * parts, "_p", "_b").groupBy("_p", "_b").applyInArrow(sums, schema).unionByName(same)
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    t = found.groupBy("id", "c", "c2").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).groupBy("id", "c").agg(F.max(F.when(F.col("c") == F.col("c2"), mean)).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), mean)).alias("b"))
    t = t.unionByName(x.where(" or ".join(f"v[{i}] is null" for i in range(p))).select("id", "c", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")))
    top = F.greatest("a", "b")
    return t.select(F.col("id").alias(row_id), F.col("c").alias("cluster"), F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("silhouette"))


def euclidean(a: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Distances of the rows of a and the columns of across: few features by their differences, many by inner products."""
    if len(across) > 16:
        return np.sqrt(Tile(a, across.T).squared)
    out, d = np.zeros((len(a), across.shape[1])), np.empty((len(a), across.shape[1]))
    for k, row in enumerate(across):
        np.subtract(a[:, k, None], row, out=d)
        d *= d
        out += d
    return np.sqrt(out, out=out)


def silhouette(df: DataFrame, features: list[str], cluster: str, row_id: str) -> DataFrame:
    return silhouette_samples(df, features, cluster, row_id).agg(F.avg("silhouette").alias("silhouette"))


def _contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    return cells.join(rows, cells.a.eqNullSafe(rows.a)).drop(rows.a).join(cols, cells.b.eqNullSafe(cols.b)).drop(cols.b)


def adjusted_rand(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    two = lambda x: x * (x - 1) / 2
    t = _contingency(df, truth, cluster).agg(F.sum(two(F.col("n"))).alias("i"), F.sum(two(F.col("ra")) * F.col("n") / F.col("ra")).alias("a"), F.sum(two(F.col("cb")) * F.col("n") / F.col("cb")).alias("b"), two(F.sum("n")).alias("all"))
    expected, top = F.col("a") * F.col("b") / F.col("all"), (F.col("a") + F.col("b")) / 2
    return t.select(F.when((F.col("all") == 0) | (top == expected), 1.0).otherwise((F.col("i") - expected) / (top - expected)).alias("adjusted_rand"))


def information(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """mutual_information, homogeneity, completeness, v_measure, nmi (arithmetic); natural logarithms."""
    t = _contingency(df, truth, cluster)
    total = t.agg(F.sum("n").alias("all_n"))
    t = t.join(F.broadcast(total)).agg(
        F.sum(F.col("n") / F.col("all_n") * F.log(F.col("n") * F.col("all_n") / (F.col("ra") * F.col("cb")))).alias("mi"),
        F.sum(-F.col("n") / F.col("all_n") * F.log(F.col("ra") / F.col("all_n"))).alias("ha"), F.sum(-F.col("n") / F.col("all_n") * F.log(F.col("cb") / F.col("all_n"))).alias("hb"))
    h, c = F.when(F.col("ha") > 0, F.col("mi") / F.col("ha")).otherwise(1.0), F.when(F.col("hb") > 0, F.col("mi") / F.col("hb")).otherwise(1.0)
    return t.select(F.col("mi").alias("mutual_information"), h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"), F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


# --- states that add up over batches ---


class ClassificationState(Model):
    """Counts of (label, prediction), one cell for each pair that occurs; empty to begin with."""

    def __init__(self, cells=()):
        super().__init__(cells=[list(c) for c in cells])

    def observe(self, df: DataFrame, label: str, prediction: str) -> "ClassificationState":
        return self.merge(ClassificationState([(r.label, r.prediction, r.n) for r in confusion(df, label, prediction).collect()]))

    def merge(self, other: "ClassificationState") -> "ClassificationState":
        total: dict = {}
        for y, p, n in (*self.cells, *other.cells):
            total[y, p] = total.get((y, p), 0) + n
        return ClassificationState([(y, p, n) for (y, p), n in total.items()])

    def result(self) -> dict[str, float]:
        """accuracy, and macro precision, recall and f1 over the labels seen on either side; 0/0 is 0."""
        n = sum(c for _, _, c in self.cells)
        if not n:
            raise EmptyInput("nothing was observed")
        ratio = lambda a, b: a / b if b else 0.0
        names = {x for y, p, _ in self.cells for x in (y, p)}
        parts = []
        for name in names:
            hit, support, predicted = (sum(c for y, p, c in self.cells if test(y, p)) for test in (lambda y, p: y == p == name, lambda y, p: y == name, lambda y, p: p == name))
            parts.append((ratio(hit, predicted), ratio(hit, support), ratio(2 * hit, support + predicted)))
        macro = [sum(x) / len(parts) for x in zip(*parts)]
        return {"accuracy": sum(c for y, p, c in self.cells if y == p) / n, **dict(zip(("precision", "recall", "f1"), macro))}


class RegressionState(Model):
    """Count, mean and squared deviations of the labels, and sums of errors; rows with a null are left out."""

    def __init__(self, n=0, mean=0.0, spread=0.0, squared=0.0, absolute=0.0):
        super().__init__(n=n, mean=mean, spread=spread, squared=squared, absolute=absolute)

    def observe(self, df: DataFrame, label: str, prediction: str) -> "RegressionState":
        y, e = F.col(label).cast("double"), F.col(prediction).cast("double") - F.col(label)
        r = df.where(e.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("v"), F.sum(e * e).alias("s"), F.sum(F.abs(e)).alias("a")).first()
        return self.merge(RegressionState(r.n, r["mean"], r.v * r.n, r.s, r.a)) if r.n else self

    def merge(self, other: "RegressionState") -> "RegressionState":
        n = self.n + other.n
        if not n:
            return RegressionState()
        apart = other.mean - self.mean
        return RegressionState(n, self.mean + apart * other.n / n, self.spread + other.spread + apart * apart * self.n * other.n / n, self.squared + other.squared, self.absolute + other.absolute)

    def result(self) -> dict[str, float]:
        """mse, rmse, mae, r2 (of labels that do not differ: 1 without errors, else 0)."""
        if not self.n:
            raise EmptyInput("nothing was observed")
        mse = self.squared / self.n
        r2 = 1 - self.squared / self.spread if self.spread else float(self.squared == 0)
        return {"mse": mse, "rmse": math.sqrt(mse), "mae": self.absolute / self.n, "r2": r2}


# --- scorers ---

SCORERS = {
    "accuracy": (accuracy, "accuracy"), "balanced_accuracy": (balanced_accuracy, "balanced_accuracy"), "matthews": (matthews, "mcc"),
    "precision": (precision_recall_f1, "precision"), "recall": (precision_recall_f1, "recall"), "f1": (precision_recall_f1, "f1"),
    "auc": (auc, "auc"), "average_precision": (average_precision, "average_precision"), "log_loss": (log_loss, "-log_loss"),
    "mse": (regression, "-mse"), "rmse": (regression, "-rmse"), "mae": (regression, "-mae"), "r2": (regression, "r2"),
}


def score(name: str, df: DataFrame, label: str, prediction: str) -> float:
    """A scorer's value, higher being better (losses are negated)."""
    if name not in SCORERS:
        raise InvalidParameter(f"no scorer {name}")
    metric, column = SCORERS[name]
    row = metric(df, label, prediction).first()
    value = row[column.lstrip("-")] if row else None
    if value is None:
        raise EmptyInput("no rows to score")
    return -value if column.startswith("-") else value
