"""Linear models. Least squares and its penalties solve p x p systems on the driver from one Gram aggregate;
logistic models and hinge losses iterate over one gradient aggregate a step; SGD passes over the rows in order."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.base import Model, Params, check_features
from loomstat.errors import EmptyInput, InvalidParameter, NotConverged, UnsupportedOperation
from loomstat.functions.vectors import add_grams, centred, gram


def _linear(features: list[str], coef: list[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for n, c in zip(features, coef):
        out = out + F.col(n).cast("double") * float(c)
    return out


class LinearModel(Model):
    """features, coef, intercept; gram state for update()."""

    def predict(self) -> Column:
        return _linear(self.features, self.coef, self.intercept)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction, self.predict())


class _Gram(Params):
    def fit(self, df: DataFrame):
        return self.solve(gram(df, list(self.features), self.label))

    def update(self, model, df: DataFrame):
        """Model of all rows seen: Gram states add up."""
        old = {k: np.array(v) if isinstance(v, list) else v for k, v in model.gram.items()}
        return self.solve(add_grams(old, gram(df, list(self.features), self.label)))

    def _model(self, g: dict, coef: np.ndarray, **more) -> LinearModel:
        intercept = g["y_mean"] - float(coef @ g["mean"]) if self.fit_intercept else 0.0
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in g.items()}
        return LinearModel(features=list(self.features), coef=[float(c) for c in coef], intercept=intercept, prediction=self.prediction, gram=plain, **more)

    def _moments(self, g: dict):
        return centred(g) if self.fit_intercept else (g["xx"], g["xy"])


class LinearRegression(_Gram):
    """Least squares of minimum norm."""

    defaults = {"features": (), "label": "label", "prediction": "prediction", "fit_intercept": True}

    def solve(self, g: dict) -> LinearModel:
        xx, xy = self._moments(g)
        scale = np.sqrt(np.maximum(np.diag(xx), 0))
        scale[scale == 0] = 1
        # scaled for conditioning if the system has full rank; else the minimum-norm solution of the plain one
        s = xx / np.outer(scale, scale)
        if np.linalg.matrix_rank(s, tol=1e-10) == len(s):
            return self._model(g, np.linalg.solve(s, xy / scale) / scale)
        return self._model(g, np.linalg.lstsq(xx, xy, rcond=1e-12)[0])


class Ridge(_Gram):
    """|y - Xb|^2 + alpha |b|^2, intercept without penalty; a list of alphas gives a list of models."""

    defaults = {"features": (), "label": "label", "prediction": "prediction", "fit_intercept": True, "alpha": 1.0}

    def check(self) -> None:
        if min(np.atleast_1d(self.alpha)) < 0:
            raise InvalidParameter("alpha must not be negative")

    def solve(self, g: dict):
        xx, xy = self._moments(g)
        models = []
        for a in np.atleast_1d(self.alpha):
            m = xx + a * np.eye(len(xx))
            try:
                np.linalg.cholesky(m)
                coef = np.linalg.solve(m, xy)
            except np.linalg.LinAlgError:
                coef = np.linalg.lstsq(m, xy, rcond=1e-12)[0]
            models.append(self._model(g, coef, alpha=float(a)))
        return models[0] if np.isscalar(self.alpha) else models


class ElasticNet(_Gram):
    """|y - Xb|^2 / 2n + alpha * ratio |b|_1 + alpha (1 - ratio) / 2 |b|^2, by cyclic coordinate descent on the Gram matrix."""

    defaults = {"features": (), "label": "label", "prediction": "prediction", "fit_intercept": True, "alpha": 1.0, "l1_ratio": 0.5, "positive": False, "tol": 1e-4, "max_iter": 1000}

    def check(self) -> None:
        if min(np.atleast_1d(self.alpha)) < 0 or not 0 <= self.l1_ratio <= 1:
            raise InvalidParameter("alpha >= 0, 0 <= l1_ratio <= 1")

    def solve(self, g: dict):
        xx, xy = self._moments(g)
        n = g["n"]
        yy = g["yy"] - n * g["y_mean"] ** 2 if self.fit_intercept else g["yy"]
        models = []
        for a in np.atleast_1d(self.alpha):
            l1, l2 = n * a * self.l1_ratio, n * a * (1 - self.l1_ratio)
            b, grad = np.zeros(len(xx)), xy.copy()  # grad = X'(y - Xb)
            for _ in range(self.max_iter):
                moved = 0.0
                for j in range(len(b)):
                    if xx[j, j] == 0:
                        continue
                    rho = grad[j] + xx[j, j] * b[j]
                    new = max(0.0, rho - l1) if self.positive else math.copysign(max(0.0, abs(rho) - l1), rho)
                    new /= xx[j, j] + l2
                    if new != b[j]:
                        grad -= xx[:, j] * (new - b[j])
                        moved = max(moved, abs(new - b[j]) * math.sqrt(xx[j, j]))
                        b[j] = new
                if moved <= self.tol * math.sqrt(max(yy, 1e-300)) * 1e-3:
                    break
            else:
                raise NotConverged(f"coordinate descent, alpha {a}")
            models.append(self._model(g, b, alpha=float(a)))
        return models[0] if np.isscalar(self.alpha) else models


class Lasso(ElasticNet):
    defaults = {**ElasticNet.defaults, "l1_ratio": 1.0}


def class_weights(df: DataFrame, label: str, policy="balanced") -> dict:
    """class -> weight: balanced is n / (classes * count); a dict is taken as it is; None is 1."""
    counts = {r[0]: r["count"] for r in df.groupBy(label).count().collect()}
    if policy is None:
        return {c: 1.0 for c in counts}
    if isinstance(policy, dict):
        return {c: float(policy.get(c, 1.0)) for c in counts}
    n = sum(counts.values())
    return {c: n / (len(counts) * k) for c, k in counts.items()}


def batch_sums(df: DataFrame, columns: list[Column], kernel, size: int) -> np.ndarray:
    """Sum over all rows of kernel(matrix of the columns), a vector of `size`: partial sums in Arrow batches, then one sum a place."""
    def partial(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += kernel(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


class LogisticRegression(Params):
    """Mean log-loss + alpha P(w), alpha = 1 / c; penalty l2, l1, elasticnet or none; multinomial for more than two classes.

    Accelerated proximal gradient with backtracking: each step is one aggregate of p * k
    sums. The intercept has no penalty."""

    defaults = {"features": (), "label": "label", "prediction": "prediction", "probability": "probability", "penalty": "l2", "c": 1.0, "l1_ratio": 0.5, "tol": 1e-4, "max_iter": 100, "class_weight": None, "fit_intercept": True}

    def check(self) -> None:
        if self.penalty not in ("l2", "l1", "elasticnet", "none") or self.c <= 0:
            raise InvalidParameter("penalty is l2, l1, elasticnet or none; c is positive")

    def fit(self, df: DataFrame, start: "LogisticModel | None" = None) -> "LogisticModel":
        names = list(self.features)
        check_features(df, names)
        weights = class_weights(df.where(F.col(self.label).isNotNull()), self.label, self.class_weight)
        classes = sorted(weights)
        if len(classes) < 2:
            raise EmptyInput("at least two classes are needed")
        k, p = len(classes), len(names)
        index = F.coalesce(*[F.when(F.col(self.label) == F.lit(c), F.lit(float(i))) for i, c in enumerate(classes)])
        kept = df.where(F.col(self.label).isNotNull()).select(*[F.col(n).cast("double").alias(n) for n in names], index.alias("_y"), F.coalesce(*[F.when(F.col(self.label) == F.lit(c), F.lit(w)) for c, w in weights.items()]).alias("_w")).persist()
        try:
            stats = kept.agg(F.sum("_w").alias("n"), *[F.avg(F.col(n)).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_pop(F.col(n)).alias(f"s{i}") for i, n in enumerate(names)]).first()
            n_w = stats["n"]
            columns = [F.col(c) for c in (*names, "_y", "_w")]
            alpha = 0.0 if self.penalty == "none" else 1 / self.c
            l1 = alpha * {"l1": 1.0, "elasticnet": self.l1_ratio}.get(self.penalty, 0.0)
            l2 = alpha * {"l2": 1.0, "elasticnet": 1 - self.l1_ratio}.get(self.penalty, 0.0)
            fit_b = self.fit_intercept

            def loss_grad(theta):
                w, b = theta[:-1], theta[-1]

                def kernel(a):
                    x, y, cw = a[:, :p], a[:, p].astype(int), a[:, p + 1]
                    z = x @ w + b
                    z -= z.max(1, keepdims=True)
                    e = np.exp(z)
                    pr = e / e.sum(1, keepdims=True)
                    loss = -(cw * np.log(np.maximum(pr[np.arange(len(y)), y], 1e-300))).sum()
                    pr[np.arange(len(y)), y] -= 1
                    pr *= cw[:, None]
                    return np.r_[loss, (x.T @ pr).ravel(), pr.sum(0) if fit_b else np.zeros(k)]

                s = batch_sums(kept, columns, kernel, 1 + p * k + k) / n_w
                return s[0] + l2 / 2 * (w**2).sum(), np.vstack([s[1 : 1 + p * k].reshape(p, k) + l2 * w, s[1 + p * k :]])

            theta = np.zeros((p + 1, k))
            if start is not None:
                theta = np.vstack([np.array(start.coef).T, np.array(start.intercept)])
            step = 1.0 / (sum((stats[f"s{i}"] or 0) ** 2 + stats[f"m{i}"] ** 2 for i in range(p)) / 2 + 0.5 + l2)
            ahead, t, done = theta, 1.0, False
            for _ in range(self.max_iter):
                value, g = loss_grad(ahead)
                while True:
                    new = ahead - step * g
                    new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * l1)
                    d = new - ahead
                    if step < 1e-12 or loss_grad(new)[0] <= value + (g * d).sum() + (d**2).sum() / (2 * step) + 1e-12:
                        break
                    step /= 2
                if np.abs(new - theta).max() < self.tol * max(1.0, np.abs(new).max()) * 0.1:
                    theta, done = new, True
                    break
                t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
                if (g * (new - theta)).sum() > 0:  # restart where momentum leads uphill
                    t_new, ahead = 1.0, new
                else:
                    ahead = new + (t - 1) / t_new * (new - theta)
                theta, t, step = new, t_new, step * 1.25
        finally:
            kept.unpersist()
        return LogisticModel(features=names, classes=classes, coef=theta[:-1].T.tolist(), intercept=theta[-1].tolist(), prediction=self.prediction, probability=self.probability, converged=done)


class LogisticModel(Model):
    def margins(self) -> Column:
        return F.array(*[_linear(self.features, c, b) for c, b in zip(self.coef, self.intercept)])

    def transform(self, df: DataFrame) -> DataFrame:
        e = df.withColumn("_m", self.margins()).withColumn("_top", F.array_max("_m")).withColumn("_e", F.transform("_m", lambda m: F.exp(m - F.col("_top"))))
        total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
        best = F.get(F.array(*map(F.lit, self.classes)), F.array_position("_m", F.col("_top")).cast("int") - 1)
        return e.withColumn(self.probability, F.transform("_e", lambda x: x / total)).withColumn(self.prediction, best).drop("_m", "_top", "_e")


# --- stochastic gradient ---

LOSSES = {
    "hinge": (lambda m: np.maximum(0, 1 - m), lambda m: np.where(m < 1, -1.0, 0.0)),
    "log_loss": (lambda m: np.logaddexp(0, -m), lambda m: -1 / (1 + np.exp(np.clip(m, -500, 500)))),
    "modified_huber": (lambda m: np.where(m >= -1, np.maximum(0, 1 - m) ** 2, -4 * m), lambda m: np.where(m >= -1, -2 * np.maximum(0, 1 - m), -4.0)),
    "squared_hinge": (lambda m: np.maximum(0, 1 - m) ** 2, lambda m: -2 * np.maximum(0, 1 - m)),
    "perceptron": (lambda m: np.maximum(0, -m), lambda m: np.where(m <= 0, -1.0, 0.0)),
}
REGRESSION_LOSSES = {
    "squared_error": (lambda r, e: r * r / 2, lambda r, e: r),
    "huber": (lambda r, e: np.where(np.abs(r) <= e, r * r / 2, e * np.abs(r) - e * e / 2), lambda r, e: np.clip(r, -e, e)),
    "epsilon_insensitive": (lambda r, e: np.maximum(0, np.abs(r) - e), lambda r, e: np.where(np.abs(r) > e, np.sign(r), 0.0)),
    "squared_epsilon_insensitive": (lambda r, e: np.maximum(0, np.abs(r) - e) ** 2, lambda r, e: 2 * np.sign(r) * np.maximum(0, np.abs(r) - e)),
}


def learning_rate(kind: str, eta0: float, power: float, alpha: float, t: int) -> float:
    if kind in ("constant", "adaptive"):
        return eta0
    if kind == "inverse_scaling":
        return eta0 / (1 + t) ** power
    if kind == "optimal":
        return 1 / (alpha * (t + 1 / (alpha * math.sqrt(1 / math.sqrt(alpha)))))
    raise InvalidParameter(f"learning rate {kind}")


class _SGD(Params):
    shared = {"features": (), "label": "label", "prediction": "prediction", "row_id": None, "penalty": "l2", "alpha": 1e-4, "l1_ratio": 0.15, "eta0": 0.01, "power": 0.5, "tol": 1e-3, "max_epochs": 30, "patience": 5, "seed": 0, "averaging": False, "parts": 8}

    def _pass(self, rows: DataFrame, start: np.ndarray, t: int, eta0: float, slope) -> tuple[np.ndarray, float, int]:
        """One epoch: each part, a hash of row_id, runs its rows in hashed order from the common weights; the parts' weights are averaged by rows.

        With parts = 1 this is plain sequential SGD."""
        p = len(start) - 1
        l1 = self.alpha * {"l1": 1.0, "elasticnet": self.l1_ratio}.get(self.penalty, 0.0)
        l2 = self.alpha * {"l2": 1.0, "elasticnet": 1 - self.l1_ratio}.get(self.penalty, 0.0)
        kind, power, alpha = self.learning_rate, self.power, self.alpha

        def run(group: pa.Table) -> pa.Table:
            g = group.sort_by([("_order", "ascending"), ("_id", "ascending")])
            x = np.column_stack([g.column(f"x{i}").to_numpy() for i in range(p)])
            y, cw = g.column("_y").to_numpy(), g.column("_w").to_numpy()
            w, total, at, mean = start.copy(), 0.0, t, np.zeros(p + 1)
            for i in range(len(x)):
                loss, d = slope(w[:p] @ x[i] + w[p], y[i])
                total += cw[i] * float(loss)
                eta = learning_rate(kind, eta0, power, alpha, at)
                w[p] -= eta * cw[i] * d
                w[:p] -= eta * cw[i] * d * x[i]
                w[:p] -= eta * l2 * w[:p]
                if l1:
                    w[:p] = np.sign(w[:p]) * np.maximum(0, np.abs(w[:p]) - eta * l1)
                at += 1
                mean += (w - mean) / (i + 1)
            return pa.table({"n": [len(x)], "loss": [total], "w": pa.array([w.tolist()], pa.list_(pa.float64())), "mean": pa.array([mean.tolist()], pa.list_(pa.float64()))})

        got = rows.groupBy("_part").applyInArrow(run, "n long, loss double, w array<double>, mean array<double>").collect()
        n = sum(r.n for r in got)
        if not n:
            raise EmptyInput("no rows")
        w = sum(np.array(r.mean if self.averaging else r.w) * r.n for r in got) / n
        return w, sum(r.loss for r in got) / n, max(r.n for r in got)

    def _train(self, rows: DataFrame, slope, start: np.ndarray | None = None, epochs: int | None = None) -> tuple[np.ndarray, bool]:
        w = np.zeros(len(self.features) + 1) if start is None else start
        eta0, last, bad, t = self.eta0, math.inf, 0, 0
        for _ in range(epochs or self.max_epochs):
            w, loss, steps = self._pass(rows, w, t, eta0, slope)
            t += steps
            bad = bad + 1 if loss > last - self.tol else 0
            last = loss
            if bad >= self.patience:
                if self.learning_rate != "adaptive" or eta0 < 1e-6:
                    return w, True
                eta0, bad = eta0 / 2, 0
        return w, False

    def _rows(self, df: DataFrame, y: Column, w: Column) -> DataFrame:
        if self.row_id is None:
            raise InvalidParameter("row_id gives the order of the steps")
        key = F.xxhash64(F.lit(self.seed), F.col(self.row_id))
        return df.select(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(self.features)], y.cast("double").alias("_y"), w.cast("double").alias("_w"), key.alias("_order"), F.col(self.row_id).alias("_id"), F.pmod(key, F.lit(self.parts)).alias("_part"))


class SGDClassifier(_SGD):
    """One-vs-rest linear classifier; loss hinge, log_loss, modified_huber, squared_hinge or perceptron."""

    defaults = {**_SGD.shared, "loss": "hinge", "learning_rate": "optimal", "class_weight": None}

    def check(self) -> None:
        if self.loss not in LOSSES:
            raise InvalidParameter(f"loss {self.loss}")

    def fit(self, df: DataFrame, start: "SGDModel | None" = None, epochs: int | None = None) -> "SGDModel":
        check_features(df, list(self.features))
        weights = class_weights(df, self.label, self.class_weight)
        classes = sorted(weights) if start is None else start.classes
        value, derivative = LOSSES[self.loss]
        slope = lambda z, y: (value(y * z), y * derivative(y * z))
        w = F.coalesce(*[F.when(F.col(self.label) == F.lit(c), F.lit(v)) for c, v in weights.items()])
        todo = classes[1:] if len(classes) == 2 else classes
        found = []
        for i, c in enumerate(todo):
            rows = self._rows(df, F.when(F.col(self.label) == F.lit(c), 1.0).otherwise(-1.0), w)
            first = None if start is None else np.r_[start.coef[i], start.intercept[i]]
            found.append(self._train(rows, slope, first, epochs))
        return SGDModel(features=list(self.features), classes=classes, coef=[x[:-1].tolist() for x, _ in found], intercept=[float(x[-1]) for x, _ in found], loss=self.loss, prediction=self.prediction, converged=all(ok for _, ok in found))

    def partial_fit(self, model: "SGDModel", df: DataFrame) -> "SGDModel":
        return self.fit(df, start=model, epochs=1)


class SGDModel(Model):
    def transform(self, df: DataFrame) -> DataFrame:
        margins = [_linear(self.features, c, b) for c, b in zip(self.coef, self.intercept)]
        if len(margins) == 1:
            return df.withColumn(self.prediction, F.when(margins[0] > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))
        m = F.array(*margins)
        return df.withColumn(self.prediction, F.get(F.array(*map(F.lit, self.classes)), F.array_position(m, F.array_max(m)).cast("int") - 1))

    def probability(self) -> Column:
        """Of the second of two classes; for log_loss and modified_huber only."""
        if len(self.coef) != 1 or self.loss not in ("log_loss", "modified_huber"):
            raise UnsupportedOperation("probabilities need two classes and log_loss or modified_huber")
        z = _linear(self.features, self.coef[0], self.intercept[0])
        return 1 / (1 + F.exp(-z)) if self.loss == "log_loss" else (F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0)) + 1) / 2


class SGDRegressor(_SGD):
    defaults = {**_SGD.shared, "loss": "squared_error", "epsilon": 0.1, "learning_rate": "inverse_scaling", "power": 0.25}

    def check(self) -> None:
        if self.loss not in REGRESSION_LOSSES:
            raise InvalidParameter(f"loss {self.loss}")

    def fit(self, df: DataFrame, start: LinearModel | None = None, epochs: int | None = None) -> LinearModel:
        check_features(df, list(self.features))
        value, derivative = REGRESSION_LOSSES[self.loss]
        e = self.epsilon
        first = None if start is None else np.r_[start.coef, start.intercept]
        w, done = self._train(self._rows(df, F.col(self.label), F.lit(1.0)), lambda z, y: (value(z - y, e), derivative(z - y, e)), first, epochs)
        return LinearModel(features=list(self.features), coef=w[:-1].tolist(), intercept=float(w[-1]), prediction=self.prediction, converged=done)

    def partial_fit(self, model: LinearModel, df: DataFrame) -> LinearModel:
        return self.fit(df, start=model, epochs=1)


class LowRankAdapter(Params):
    """A fitted linear model's coefficients plus (alpha / rank) * B A, learned on new rows with the base fixed."""

    defaults = {"features": (), "label": "label", "rank": 4, "alpha": 1.0, "rate": 0.5, "max_iter": 200, "tol": 1e-8, "seed": 0}

    def fit(self, base: LinearModel, df: DataFrame) -> LinearModel:
        g = gram(df, list(self.features), self.label)
        rng, p, r = np.random.default_rng(self.seed), len(self.features), min(self.rank, len(self.features))
        a, b, scale = rng.normal(0, 1 / math.sqrt(p), (r, p)), np.zeros(r), self.alpha / r
        w0 = np.array(base.coef)
        sx, n = g["n"] * g["mean"], g["n"]
        xy = g["xy"] - base.intercept * sx
        last = math.inf
        top = np.linalg.eigvalsh(g["xx"] / n)[-1] or 1.0
        for _ in range(self.max_iter):
            w = w0 + scale * b @ a
            grad = (g["xx"] @ w - xy) / n
            loss = float(w @ g["xx"] @ w - 2 * w @ xy) / (2 * n)
            if abs(last - loss) < self.tol:
                break
            last, eta = loss, self.rate / top / max(1.0, scale**2 * (np.linalg.norm(a, 2) ** 2 + b @ b))
            a, b = a - eta * scale * np.outer(b, grad), b - eta * scale * a @ grad
        return LinearModel(**{**base.state(), "coef": (w0 + scale * b @ a).tolist(), "adapter": {"a": a.tolist(), "b": b.tolist(), "scale": scale}})


def merge_adapter(model: LinearModel) -> LinearModel:
    """The adapted coefficients as a plain model."""
    state = model.state()
    state.pop("adapter", None)
    return LinearModel(**state)
