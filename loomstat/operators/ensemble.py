"""Forests, bagging and boosting over the level-wise trees. Bootstraps are counts drawn from a hash of row_id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.base import Model, Params
from loomstat.errors import EmptyInput, InvalidParameter
from loomstat.operators.cluster import cut_lineage
from loomstat.operators.tree import DecisionTreeClassifier, DecisionTreeRegressor, TreeModel, _draw, _plain, grow, route, squared


def uniform(row_id: str, *seed: int) -> Column:
    """A draw from [0, 1) that depends on the row and the seed alone."""
    return F.pmod(F.xxhash64(*map(F.lit, seed), F.col(row_id)), F.lit(1 << 52)) / float(1 << 52)


MOST_DRAWS = 18


def bootstrap_count(row_id: str, *seed: int) -> Column:
    """How often a row is drawn: Poisson of mean 1, the limit of drawing n of n with replacement; more than
    MOST_DRAWS have a probability under that of one step of the draw."""
    u, out, p, total = uniform(row_id, *seed), F.lit(float(MOST_DRAWS)), math.exp(-1), 0.0
    cuts = []
    for k in range(MOST_DRAWS):
        total += p
        cuts.append((k, total))
        p /= k + 1
    for k, cut in reversed(cuts):
        out = F.when(u < cut, float(k)).otherwise(out)
    return out


class _Forest(Params):
    defaults = {"features": (), "label": "label", "prediction": "prediction", "row_id": None, "trees": 100, "max_depth": None, "min_split": 2, "min_leaf": 1, "max_features": "sqrt", "bootstrap": True, "max_bins": 64, "seed": 0, "class_weight": None}
    tree: type = DecisionTreeClassifier

    def fit(self, df: DataFrame) -> "ForestModel":
        if self.row_id is None:
            raise InvalidParameter("row_id makes the draws independent of partitions")
        models = []
        for t in range(self.trees):
            part, weight = df, None
            if self.bootstrap:
                weight = "_draws"
                part = df.withColumn("_draws", bootstrap_count(self.row_id, self.seed, t)).where("_draws > 0")
            grower = self.tree(features=self.features, label=self.label, max_depth=self.max_depth, min_split=self.min_split, min_leaf=self.min_leaf, max_features=self.max_features, seed=self.seed * 100_003 + t, max_bins=self.max_bins, weight=weight, class_weight=self.class_weight)
            models.append(grower.fit(part))
        p = len(self.features)
        return ForestModel(kind=models[0].kind, features=list(self.features), classes=sorted({c for m in models for c in m.classes}), trees=[m.state() for m in models], prediction=self.prediction, row_id=self.row_id, label=self.label, seed=self.seed, bootstrap=self.bootstrap, importances=[sum(m.importances[i] for m in models) / len(models) for i in range(p)])


class RandomForestClassifier(_Forest):
    """Mean of the trees' class shares."""


class RandomForestRegressor(_Forest):
    tree = DecisionTreeRegressor


class ForestModel(Model):
    def _members(self) -> list[TreeModel]:
        return [TreeModel(**t) for t in self.trees]

    def _share(self, m: TreeModel, c) -> Column:
        return m.value(m.classes.index(c)) if c in m.classes else F.lit(0.0)

    def _pick(self, sums: list[Column]) -> Column:
        a = F.array(*sums)
        return F.get(F.array(*map(F.lit, self.classes)), F.array_position(a, F.array_max(a)).cast("int") - 1)

    def predict(self, use: list[Column] | None = None) -> Column:
        members = self._members()
        use = use or [F.lit(1.0)] * len(members)
        n = sum(use[1:], use[0])
        if self.kind == "regressor":
            return sum((u * m.value() for u, m in zip(use, members)), F.lit(0.0)) / n
        return self._pick([sum((u * self._share(m, c) for u, m in zip(use, members)), F.lit(0.0)) / n for c in self.classes])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction, self.predict())

    def out_of_bag(self, df: DataFrame) -> DataFrame:
        """Predictions from the trees that did not draw the row; rows that every tree drew are left out."""
        if not self.bootstrap:
            raise InvalidParameter("out-of-bag predictions need a bootstrap")
        use = [F.when(bootstrap_count(self.row_id, self.seed, t) == 0, 1.0).otherwise(0.0) for t in range(len(self.trees))]
        return df.where(sum(use[1:], use[0]) > 0).withColumn(self.prediction, self.predict(use))


class Bagging(Params):
    """Any estimator on bootstraps, optionally on a share of the features; predictions are averaged, or voted with ties to the smaller class."""

    defaults = {"estimator": None, "row_id": None, "members": 10, "bootstrap": True, "max_samples": 1.0, "feature_share": 1.0, "seed": 0, "vote": False, "prediction": "prediction"}

    def fit(self, df: DataFrame) -> "Bagging":
        fitted = self.copy()
        fitted.models_ = []
        names = list(self.estimator.features)
        for t in range(self.members):
            count = bootstrap_count(self.row_id, self.seed, t) if self.bootstrap else F.lit(1.0)
            part = df.where(uniform(self.row_id, self.seed, t, 1) < self.max_samples) if self.max_samples < 1 else df
            part = part.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), count.cast("int")))).drop("_copy")
            own = sorted(sorted(names, key=lambda n: _draw(self.seed, t, n))[: max(1, int(len(names) * self.feature_share))], key=names.index)
            fitted.models_.append(self.estimator.copy(features=own).fit(part))
        return fitted

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models_):
            out = m.transform(out).withColumnRenamed(m.prediction, f"_p{i}")
        every = F.array(*[f"_p{i}" for i in range(len(self.models_))])
        if self.vote:
            votes = F.transform(F.array_sort(F.array_distinct(every)), lambda v: F.struct((-F.size(F.filter(every, lambda p: p == v))).alias("n"), v.alias("v")))
            best = F.array_min(votes).v
        else:
            best = F.aggregate(every, F.lit(0.0), lambda a, b: a + b) / len(self.models_)
        return out.withColumn(self.prediction, best).select(*df.columns, self.prediction)


# --- boosting ---

EPSILON = 1e-15


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


LOSSES = {
    "squared_error": (lambda y, z: z - y, lambda y, z: F.lit(1.0)),
    "absolute_error": (lambda y, z: F.signum(z - y), lambda y, z: F.lit(1.0)),
    "huber": (lambda y, z: F.when(F.abs(z - y) <= 1, z - y).otherwise(F.signum(z - y)), lambda y, z: F.when(F.abs(z - y) <= 1, 1.0).otherwise(0.0)),
    "log_loss": (lambda y, z: _sigmoid(z) - y, lambda y, z: _sigmoid(z) * (1 - _sigmoid(z))),
}
LOSS_VALUES = {
    "squared_error": lambda y, z: (z - y) * (z - y) / 2,
    "absolute_error": lambda y, z: F.abs(z - y),
    "huber": lambda y, z: F.when(F.abs(z - y) <= 1, (z - y) * (z - y) / 2).otherwise(F.abs(z - y) - 0.5),
    "log_loss": lambda y, z: F.greatest(z, F.lit(0.0)) - y * z + F.log1p(F.exp(-F.abs(z))),
}


class GradientBoosting(Params):
    """Stages of trees on gradients; a leaf is -sum(g) / (sum(h) + l2) * rate, 0 where sum(h) is not positive.

    The raw prediction of the stages so far is one column, written every `cut` stages to keep the
    plan short. histogram=True bins the features and grows leaves best first by
    GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2).

    patience: stop when the mean loss of the rows held out has not fallen by tol for so many stages; each
    row is held out with the probability `validation`, by its row_id. probability names a column of class
    probabilities, in the order of classes."""

    defaults = {"features": (), "label": "label", "prediction": "prediction", "probability": None, "patience": None, "validation": 0.1, "tol": 1e-4, "row_id": None, "loss": "squared_error", "stages": 100, "rate": 0.1, "max_depth": 3, "min_leaf": 1, "subsample": 1.0, "l2": 0.0, "seed": 0, "max_bins": None, "histogram": False, "max_leaves": 31, "cut": 10}

    def check(self) -> None:
        if self.loss not in LOSSES:
            raise InvalidParameter(f"loss {self.loss}")
        if self.patience is not None and (self.patience < 1 or not 0 < self.validation < 1 or self.row_id is None):
            raise InvalidParameter("patience is positive, validation between 0 and 1, and row_id tells which rows are held out")
        if self.probability and self.loss != "log_loss":
            raise InvalidParameter("only log_loss gives probabilities")

    def _start(self, df: DataFrame, y: Column) -> float:
        mean = df.agg(F.avg(y)).first()[0]
        if self.loss != "log_loss":
            return float(mean)
        p = min(max(mean, EPSILON), 1 - EPSILON)
        return math.log(p / (1 - p))

    def fit(self, df: DataFrame) -> "BoostingModel":
        names = list(self.features)
        classes = sorted(r[0] for r in df.select(self.label).distinct().collect()) if self.loss == "log_loss" else []
        if self.loss == "log_loss" and len(classes) < 2:
            raise InvalidParameter("two classes or more are needed")
        targets = [(F.col(self.label) == F.lit(c)).cast("double") for c in (classes[1:] if len(classes) == 2 else classes)] or [F.col(self.label).cast("double")]
        gradient, hessian = LOSSES[self.loss]
        chains = []
        held = uniform(self.row_id, self.seed, -1) < self.validation if self.patience else F.lit(False)
        for k, y in enumerate(targets):
            start, trees, best, waited = self._start(df.where(~held), y), [], math.inf, 0
            rows = df.select(*names, *([self.row_id] if self.row_id else []), y.alias("_y"), held.alias("_held")).withColumn("_z", F.lit(start))
            for stage in range(self.stages):
                part = rows.where(~F.col("_held"))
                part = part.where(uniform(self.row_id, self.seed, k, stage) < self.subsample) if self.subsample < 1 else part
                g, h = gradient(F.col("_y"), F.col("_z")), hessian(F.col("_y"), F.col("_z"))
                if self.histogram:
                    stats = {"n": F.lit(1.0), "g": g, "h": h}
                    loss = lambda s: -s["g"] * s["g"] / (s["h"] + self.l2 + 1e-12)
                    nodes = grow(part, names, stats, loss, None, 2, self.min_leaf, "all", self.seed + stage, "best", self.max_bins or 255, self.max_leaves)
                else:
                    stats = {"n": F.lit(1.0), "w": F.lit(1.0), "y": -g, "yy": g * g, "g": g, "h": h}
                    nodes = grow(part, names, stats, squared, self.max_depth, max(2, 2 * self.min_leaf), self.min_leaf, "all", self.seed + stage, "best", self.max_bins)
                values = {str(i): -n["stats"]["g"] / (n["stats"]["h"] + self.l2) * self.rate if n["stats"]["h"] > 0 else 0.0 for i, n in nodes.items()}
                trees.append({"nodes": _plain(nodes), "values": values})
                rows = rows.withColumn("_z", F.col("_z") + _tree_value(trees[-1], names))
                if stage % self.cut == self.cut - 1:
                    rows = cut_lineage(rows)
                if self.patience:
                    loss_now = rows.where("_held").agg(F.avg(LOSS_VALUES[self.loss](F.col("_y"), F.col("_z")))).first()[0]
                    if loss_now is None:
                        raise EmptyInput("no row is held out")
                    waited = 0 if loss_now < best - self.tol else waited + 1
                    best = min(best, loss_now)
                    if waited == self.patience:
                        break
            chains.append({"start": start, "trees": trees})
        return BoostingModel(features=names, classes=classes, chains=chains, loss=self.loss, prediction=self.prediction, probability=self.probability)


def HistGradientBoosting(**params) -> GradientBoosting:
    return GradientBoosting(**{"histogram": True, "min_leaf": 20, "max_bins": 255, **params})


def _tree_value(tree: dict, features: list[str]) -> Column:
    return route({int(i): n for i, n in tree["nodes"].items()}, features, lambda at: F.lit(float(tree["values"][str(at)])))


class BoostingModel(Model):
    def raw(self) -> list[Column]:
        return [sum((_tree_value(t, self.features) for t in c["trees"]), F.lit(c["start"])) for c in self.chains]

    def transform(self, df: DataFrame) -> DataFrame:
        z = self.raw()
        if not self.classes:
            return df.withColumn(self.prediction, z[0])
        if self.probability:
            ones = [_sigmoid(c) for c in z]
            shares = F.array(1 - ones[0], ones[0]) if len(z) == 1 else F.array(*[p / sum(ones[1:], ones[0]) for p in ones])
            df = df.withColumn(self.probability, shares)
        if len(self.classes) == 2:
            return df.withColumn(self.prediction, F.when(z[0] > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))
        a = F.array(*z)
        return df.withColumn(self.prediction, F.get(F.array(*map(F.lit, self.classes)), F.array_position(a, F.array_max(a)).cast("int") - 1))
