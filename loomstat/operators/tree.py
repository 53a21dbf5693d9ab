"""Decision trees grown level by level: one job a level sums statistics for (node, feature, value), running sums
give every split, and only the best split of each node comes to the driver.

With max_bins=None the split points are all midpoints of distinct neighbouring values (exact
CART); otherwise values are first put into that many quantile bins, which bounds what a task
sorts whatever the number of rows."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.base import Model, Params, check_features
from loomstat.errors import EmptyInput, InvalidParameter


def feature_count(rule, p: int) -> int:
    """all, sqrt, log2, a share or a count, rounded down, from 1 to p."""
    n = {"all": p, "sqrt": int(math.sqrt(p)), "log2": int(math.log2(p)) if p > 1 else 1}.get(rule) if isinstance(rule, str) else int(rule * p) if isinstance(rule, float) else rule
    if n is None:
        raise InvalidParameter(f"features rule {rule}")
    return max(1, min(p, n))


def _draw(*key) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") / 2**64


def route(nodes: dict, features: list[str], leaf, at: int = 0) -> Column:
    """leaf(node id) of the leaf that a row falls into."""
    n = nodes[at]
    if n.get("feature") is None:
        return leaf(at)
    return F.when(F.col(features[n["feature"]]).cast("double") <= n["threshold"], route(nodes, features, leaf, n["left"])).otherwise(route(nodes, features, leaf, n["right"]))


def gini(s: dict, k: int) -> Column:
    n = sum((s[f"c{i}"] for i in range(1, k)), s["c0"])
    return n - sum((s[f"c{i}"] * s[f"c{i}"] for i in range(1, k)), s["c0"] * s["c0"]) / n


def entropy(s: dict, k: int) -> Column:
    n = sum((s[f"c{i}"] for i in range(1, k)), s["c0"])
    return -sum((F.when(s[f"c{i}"] > 0, s[f"c{i}"] * F.log(s[f"c{i}"] / n)).otherwise(0.0) for i in range(k)), F.lit(0.0))


def squared(s: dict) -> Column:
    return s["yy"] - s["y"] * s["y"] / s["w"]


def _at_least(name: str):
    return lambda c: c >= F.col(name)


def grow(df: DataFrame, features: list[str], stats: dict[str, Column], impurity, max_depth=None, min_split=2, min_leaf=1, max_features="all", seed=0, splitter="best", max_bins=None, max_leaves=None, least_gain=1e-12) -> dict:
    """Nodes by id: stats, feature, threshold, left, right, gain. stats must hold n, the row count; impurity(stats) is additive (not a mean).

    Ties go to the smaller feature, then the smaller threshold. With max_leaves the open leaf of
    largest gain is split first."""
    check_features(df, features)
    p, names = len(features), list(stats)
    base = df.select(*[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], *[c.cast("double").alias(s) for s, c in stats.items()])
    if max_bins:
        at = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
        edges = base.agg(*[F.percentile_approx(f"_x{i}", at, 10_000).alias(f"_x{i}") for i in range(p)]).first()
        for i in range(p):
            cuts = sorted(set(edges[i]))
            above = F.filter(F.array(*map(F.lit, cuts)), _at_least(f"_x{i}"))
            base = base.withColumn(f"_x{i}", F.coalesce(F.array_min(above), F.col(f"_x{i}") * 0 + (cuts[-1] + max(1.0, abs(cuts[-1])))))
    base = base.persist()
    root = base.agg(*[F.sum(s).alias(s) for s in names]).first().asDict()
    if not root["n"]:
        base.unpersist()
        raise EmptyInput("no rows")
    nodes, fresh, leaves, depth = {0: {"stats": root, "depth": 0}}, [0], 1, 0
    columns = [f"_x{i}" for i in range(p)]

    def candidates(open_: list[int]) -> dict[int, dict]:
        open_ = [i for i in open_ if nodes[i]["stats"]["n"] >= min_split and (max_depth is None or nodes[i]["depth"] < max_depth)]
        if not open_:
            return {}
        allowed = {i: sorted(range(p), key=lambda f, i=i: _draw(seed, i, f))[: feature_count(max_features, p)] for i in open_}
        node = route(nodes, columns, lambda at: F.lit(at if at in allowed else None).cast("int"))
        picks = F.coalesce(*[F.when(F.col("_node") == i, F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_x{f}").alias("v")) for f in fs])) for i, fs in allowed.items()])
        cells = base.withColumn("_node", node).where("_node is not null").select("_node", *names, F.explode(picks).alias("_p")).groupBy("_node", "_p.f", "_p.v").agg(*[F.sum(s).alias(s) for s in names])
        w = Window.partitionBy("_node", "f").orderBy("v")
        whole = Window.partitionBy("_node", "f")
        c = cells.select("_node", "f", "v", F.lead("v").over(w).alias("_next"), *[F.sum(s).over(w).alias("l_" + s) for s in names], *[F.sum(s).over(whole).alias("t_" + s) for s in names]).where("_next is not null")
        left, total = {s: F.col("l_" + s) for s in names}, {s: F.col("t_" + s) for s in names}
        right = {s: total[s] - left[s] for s in names}
        gain = impurity(total) - impurity(left) - impurity(right)
        c = c.withColumn("_gain", gain).where((left["n"] >= min_leaf) & (right["n"] >= min_leaf) & (F.col("_gain") > least_gain))
        threshold = F.col("v") + (F.col("_next") - F.col("v")) / 2 if not max_bins else F.col("v")
        order = F.struct((-F.round("_gain", 9)).alias("g"), F.col("f"), F.col("v")) if splitter == "best" else F.struct(F.xxhash64(F.lit(seed), "_node", "f", "v").alias("g"), F.col("f"), F.col("v"))
        best = c.groupBy("_node").agg(F.min_by(F.struct("f", threshold.alias("threshold"), F.col("_gain").alias("gain"), *["l_" + s for s in names], *["t_" + s for s in names]), order).alias("b")).collect()
        return {r["_node"]: r["b"].asDict() for r in best}

    def split(i: int, b: dict) -> list[int]:
        left, right = len(nodes), len(nodes) + 1
        nodes[i] |= {"feature": b["f"], "threshold": b["threshold"], "gain": b["gain"], "left": left, "right": right}
        nodes[left] = {"stats": {s: b["l_" + s] for s in names}, "depth": nodes[i]["depth"] + 1}
        nodes[right] = {"stats": {s: b["t_" + s] - b["l_" + s] for s in names}, "depth": nodes[i]["depth"] + 1}
        return [left, right]

    try:
        if max_leaves is None:
            while fresh:
                found = candidates(fresh)
                fresh = [c for i in sorted(found) for c in split(i, found[i])]
        else:
            ready: dict[int, dict] = {}
            while leaves < max_leaves:
                ready |= candidates(fresh)
                if not ready:
                    break
                i = min(ready, key=lambda i: (-ready[i]["gain"], i))
                fresh = split(i, ready.pop(i))
                leaves += 1
    finally:
        base.unpersist()
    return nodes


def importances(nodes: dict, p: int) -> list[float]:
    out = [0.0] * p
    for n in nodes.values():
        if n.get("feature") is not None:
            out[n["feature"]] += n["gain"]
    total = sum(out)
    return [x / total for x in out] if total else out


class _Tree(Params):
    defaults = {"features": (), "label": "label", "prediction": "prediction", "max_depth": None, "min_split": 2, "min_leaf": 1, "max_features": "all", "splitter": "best", "seed": 0, "max_bins": None, "class_weight": None, "criterion": None, "weight": None}

    def _grow(self, df, stats, impurity):
        return grow(df, list(self.features), stats, impurity, self.max_depth, self.min_split, self.min_leaf, self.max_features, self.seed, self.splitter, self.max_bins)


class DecisionTreeClassifier(_Tree):
    """CART with gini or entropy (natural logarithm); ties of the leaf's classes go to the smaller."""

    def fit(self, df: DataFrame) -> "TreeModel":
        from loomstat.operators.linear import class_weights

        if self.criterion not in (None, "gini", "entropy"):
            raise InvalidParameter(f"criterion {self.criterion}")
        weights = class_weights(df, self.label, self.class_weight)
        classes = sorted(weights)
        row = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        stats = {"n": F.when(row > 0, 1.0).otherwise(0.0) if self.weight is None else row} | {f"c{i}": F.when(F.col(self.label) == F.lit(c), row * weights[c]).otherwise(0.0) for i, c in enumerate(classes)}
        rule = entropy if self.criterion == "entropy" else gini
        nodes = self._grow(df, stats, lambda s: rule(s, len(classes)))
        values = {}
        for i, n in nodes.items():
            counts = [n["stats"][f"c{k}"] for k in range(len(classes))]
            values[i] = [c / (sum(counts) or 1) for c in counts]
        return TreeModel(kind="classifier", features=list(self.features), classes=classes, nodes=_plain(nodes), values={str(k): v for k, v in values.items()}, prediction=self.prediction, importances=importances(nodes, len(self.features)))


class DecisionTreeRegressor(_Tree):
    """Least squared error."""

    def fit(self, df: DataFrame) -> "TreeModel":
        y = F.col(self.label).cast("double")
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        nodes = self._grow(df, {"n": w, "w": w, "y": w * y, "yy": w * y * y}, squared)
        return TreeModel(kind="regressor", features=list(self.features), classes=[], nodes=_plain(nodes), values={str(i): [n["stats"]["y"] / n["stats"]["w"]] for i, n in nodes.items()}, prediction=self.prediction, importances=importances(nodes, len(self.features)))


def _plain(nodes: dict) -> dict:
    return {str(i): {k: n.get(k) for k in ("feature", "threshold", "left", "right", "gain", "depth")} for i, n in nodes.items()}


class TreeModel(Model):
    def _nodes(self) -> dict:
        return {int(i): n for i, n in self.nodes.items()}

    def leaf(self) -> Column:
        return route(self._nodes(), self.features, lambda at: F.lit(at))

    def value(self, k: int = 0) -> Column:
        return route(self._nodes(), self.features, lambda at: F.lit(float(self.values[str(at)][k])))

    def predict(self) -> Column:
        if self.kind == "regressor":
            return self.value()
        best = lambda at: F.lit(self.classes[max(range(len(self.classes)), key=lambda k: (self.values[str(at)][k], -k))])
        return route(self._nodes(), self.features, best)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction, self.predict())
