"""Support vector machines, fitted on all rows: the linear ones by gradient aggregates, the kernel ones by Newton's method
on a low-rank factor of the kernel; scoring is a broadcast of the support vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from loomstat.base import Model, Params, check_features, check_guard, finite_guard
from loomstat.errors import EmptyInput, InvalidParameter, NotConverged, UnsupportedOperation
from loomstat.functions.vectors import gamma_scale
from loomstat.operators.linear import _linear, batch_sums, class_weights


class LinearSVC(Params):
    """One-vs-rest, squared hinge or hinge (smoothed by its square at the end): |w|^2 / 2 + C * sum of losses."""

    defaults = {"features": (), "label": "label", "prediction": "prediction", "c": 1.0, "loss": "squared_hinge", "tol": 1e-4, "max_iter": 200, "class_weight": None}

    def check(self) -> None:
        if self.loss not in ("squared_hinge", "hinge") or self.c <= 0:
            raise InvalidParameter("loss is squared_hinge or hinge, c positive")

    def fit(self, df: DataFrame) -> "LinearSVCModel":
        names, p = list(self.features), len(self.features)
        check_features(df, names)
        weights = class_weights(df, self.label, self.class_weight)
        classes = sorted(weights)
        if len(classes) < 2:
            raise EmptyInput("two classes or more are needed")
        held = df.persist()
        cw = F.coalesce(*[F.when(F.col(self.label) == F.lit(c), F.lit(w)) for c, w in weights.items()])
        out = []
        try:
            for c in classes[1:] if len(classes) == 2 else classes:
                columns = [F.col(n).cast("double") for n in names] + [F.when(F.col(self.label) == F.lit(c), 1.0).otherwise(-1.0), cw]
                out.append(self._one(held, columns, p))
        finally:
            held.unpersist()
        return LinearSVCModel(features=names, classes=classes, coef=[w[:-1].tolist() for w in out], intercept=[float(w[-1]) for w in out], prediction=self.prediction)

    def _one(self, df, columns, p):
        smooth = 0.0 if self.loss == "squared_hinge" else 0.05

        def kernel(w):
            def run(a):
                x, y, cw = a[:, :p], a[:, p], a[:, p + 1]
                m = 1 - y * (x @ w[:p] + w[p])
                if smooth:  # Huberised hinge
                    loss = np.where(m <= 0, 0, np.where(m < smooth, m * m / (2 * smooth), m - smooth / 2))
                    d = np.where(m <= 0, 0, np.where(m < smooth, m / smooth, 1.0))
                else:
                    loss, d = np.maximum(0, m) ** 2, 2 * np.maximum(0, m)
                g = -cw * d * y
                return np.r_[(cw * loss).sum(), x.T @ g, g.sum()]

            return run

        def at(w):
            s = batch_sums(df, columns, kernel(w), p + 2)
            return 0.5 * w[:p] @ w[:p] + self.c * s[0], np.r_[w[:p], 0] + self.c * s[1:]

        w, ahead, t, step = np.zeros(p + 1), np.zeros(p + 1), 1.0, 1e-2
        for _ in range(self.max_iter):
            value, g = at(ahead)
            while step > 1e-14 and at(ahead - step * g)[0] > value - step / 2 * g @ g:
                step /= 2
            new = ahead - step * g
            if np.abs(new - w).max() < self.tol * max(1.0, np.abs(new).max()) * 0.1:
                return new
            t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
            t_new, ahead = (1.0, new) if g @ (new - w) > 0 else (t_new, new + (t - 1) / t_new * (new - w))
            w, t, step = new, t_new, step * 1.5
        return w


class LinearSVCModel(Model):
    def decision(self) -> list[Column]:
        return [_linear(self.features, c, b) for c, b in zip(self.coef, self.intercept)]

    def transform(self, df: DataFrame) -> DataFrame:
        d = self.decision()
        if len(d) == 1:
            return df.withColumn(self.prediction, F.when(d[0] > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))
        a = F.array(*d)
        return df.withColumn(self.prediction, F.get(F.array(*map(F.lit, self.classes)), F.array_position(a, F.array_max(a)).cast("int") - 1))


def kernel_matrix(name: str, a: np.ndarray, b: np.ndarray, gamma: float, coef0: float, degree: float) -> np.ndarray:
    if name == "linear":
        return a @ b.T
    if name == "polynomial":
        return (gamma * a @ b.T + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * a @ b.T + coef0)
    if name == "rbf":
        return np.exp(-gamma * np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))
    raise InvalidParameter(f"no kernel {name}")


def smo(q, lin: np.ndarray, y: np.ndarray, c: float, tol: float = 1e-3, most: int = 100_000, diagonal: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """min a'Qa/2 + lin'a with 0 <= a <= c and y'a = 0, by pairs of second-order working sets; a and the bias.

    q is the symmetric matrix, or with its diagonal a function that gives a row of it."""
    row = q if callable(q) else q.__getitem__
    diagonal = np.diag(q) if diagonal is None else diagonal
    a, g = np.zeros(len(y)), lin.astype(float).copy()
    for _ in range(most):
        up = np.where(((y > 0) & (a < c)) | ((y < 0) & (a > 0)), -y * g, -np.inf)
        low = ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        i = int(up.argmax())
        down = np.where(low, -y * g, np.inf)
        if up[i] - down.min() < tol:
            break
        gap = up[i] - down
        q_i = row(i)
        curve = np.maximum(diagonal[i] + diagonal - 2 * y[i] * y * q_i, 1e-12)
        j = int(np.where(low & (gap > 0), -(gap**2) / curve, np.inf).argmin())
        step = gap[j] / curve[j]
        hi = min(c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        step = min(step, hi)
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * (y[i] * q_i - y[j] * row(j))
    else:
        raise NotConverged("sequential minimal optimisation")
    free = (a > 1e-12) & (a < c - 1e-12)
    if free.any():
        return a, float((-y * g)[free].mean())
    return a, float((up.max() + down[np.isfinite(down)].min()) / 2)


def platt_sums(scores: np.ndarray, truth: np.ndarray, a: float, b: float, high: float, low: float) -> np.ndarray:
    """Loss, gradient (2) and Hessian (3) of the sigmoid a, b with targets high and low."""
    t, m = np.where(truth > 0, high, low), a * scores + b
    p = 1 / (1 + np.exp(np.clip(m, -500, 500)))
    d, h = t - p, p * (1 - p)
    loss = (np.logaddexp(0, -m) * (1 - t) + np.logaddexp(0, m) * t).sum()
    return np.array([loss, (scores * d).sum(), d.sum(), (scores**2 * h).sum(), (scores * h).sum(), h.sum()])


def platt(at, pos: float, neg: float, rounds: int = 100) -> tuple[float, float]:
    """a, b of P(y=1) = 1 / (1 + exp(a * score + b)), by Newton with backtracking on smoothed targets.

    at(a, b, high, low) gives platt_sums over all rows, of which pos are of y = 1 and neg are not."""
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    now = at(a, b, high, low)
    for _ in range(rounds):
        g = now[1:3]
        if np.abs(g).max() < 1e-5:
            break
        m = np.array([[now[3] + 1e-12, now[4]], [now[4], now[5] + 1e-12]])
        move, step = -np.linalg.solve(m, g), 1.0
        while step > 1e-10 and (new := at(a + step * move[0], b + step * move[1], high, low))[0] > now[0] + 1e-4 * step * g @ move:
            step /= 2
        if step <= 1e-10:
            break
        a, b, now = a + step * move[0], b + step * move[1], new
    return float(a), float(b)


def pick(kernel, x: np.ndarray, z: np.ndarray, squares: np.ndarray, least: float) -> list[int]:
    """Rows of x, by pivoted Cholesky, beside which no row keeps more than `least` of its kernel with itself (squares).

    z is what earlier pivots explain: a row of factors for each row of x."""
    left, chosen, k = squares - (z**2).sum(1), [], z.shape[1]
    room = np.empty((len(x), k + 16))
    room[:, :k] = z
    while len(chosen) < len(x):
        i = int(left.argmax())
        if left[i] <= least:
            break
        if k == room.shape[1]:
            room = np.hstack([room, np.empty_like(room)])
        room[:, k] = (kernel(x, x[i : i + 1])[:, 0] - room[:, :k] @ room[i, :k]) / math.sqrt(left[i])
        left -= room[:, k] ** 2
        left[i], k = 0.0, k + 1
        chosen.append(i)
    return chosen


#: Rows that a task factors at once.
BLOCK = 2_000


def pivots(df: DataFrame, columns: list[Column], kernel, squares, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pivot rows (r x p) out of all rows and the inverse of their Cholesky factor.

    kernel(x, pivots) @ inverse.T are factors z of every row with z z' = K but for a rest of at most
    `least` on the diagonal. Tasks pick from their rows, the driver from what they picked, until no task has a row left."""
    p = len(columns)
    at, inverse = np.empty((0, p)), np.empty((0, 0))
    while True:
        def find(batches, at=at, inverse=inverse):
            mine = np.empty((0, p))
            for b in batches:
                rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else mine[:0]
                for s in range(0, len(rows), BLOCK):
                    x = np.concatenate([mine, rows[s : s + BLOCK]])
                    mine = x[pick(kernel, x, kernel(x, at) @ inverse.T, squares(x), least)]
            yield pa.RecordBatch.from_arrays([pa.array(mine.tolist(), pa.list_(pa.float64()))], names=["x"])

        found = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(find, "x array<double>").collect()
        if not found:
            return at, inverse
        x = np.array(sorted(r.x for r in found))
        # picked from more finely, so that what is left of any row is below `least` soon
        at = np.concatenate([at, x[pick(kernel, x, kernel(x, at) @ inverse.T, squares(x), least / 4)]])
        inverse = np.linalg.inv(np.linalg.cholesky(kernel(at, at)))


class _KernelSVM(Params):
    """|w|^2 / 2 + c * sum of losses over all rows.

    A positive semi-definite kernel is factored (pivots) so closely that it moves no decision by more than about tol. The
    primal problem in the factors is then solved by Newton's method, one aggregate of r x r sums a step, with the kink of
    the loss rounded over a width that shrinks to tol: rows outside that width meet the optimality conditions, as those
    outside the tolerance of sequential minimal optimisation do. Other kernels (sigmoid, polynomial of broken degree or
    negative coef0) have no such factors; all rows then go to the driver, which solves by sequential minimal optimisation."""

    shared = {"features": (), "label": "label", "prediction": "prediction", "row_id": None, "c": 1.0, "kernel": "rbf", "gamma": "scale", "coef0": 0.0, "degree": 3.0, "tol": 1e-3, "max_iter": 100_000}

    def check(self) -> None:
        if self.c <= 0 or self.tol <= 0:
            raise InvalidParameter("c and tol are positive")

    def _columns(self) -> list[Column]:
        return [F.col(n).cast("double") for n in self.features]

    def _scan(self, df: DataFrame, checked: list[str], *more: Column):
        """Guards, and gamma from all rows; the row of aggregates and gamma."""
        names = list(self.features)
        check_features(df, names)
        row = df.agg(*finite_guard(checked), F.max(sum((c * c for c in self._columns()), F.lit(0.0))).alias("_norm"), *more).first()
        check_guard(row, checked)
        gamma = {"scale": gamma_scale(df, names) if self.gamma == "scale" else None, "auto": 1 / len(names)}.get(self.gamma, self.gamma)
        return row, float(gamma)

    def _factored(self, gamma: float) -> bool:
        if self.kernel == "polynomial":
            return gamma >= 0 and self.coef0 >= 0 and self.degree >= 1 and float(self.degree).is_integer()
        return self.kernel == "linear" or self.kernel == "rbf" and gamma >= 0

    def _kernel(self, gamma: float):
        name, coef0, degree = self.kernel, self.coef0, self.degree
        return lambda a, b: kernel_matrix(name, a, b, gamma, coef0, degree)

    def _squares(self, gamma: float):
        name, coef0, degree = self.kernel, self.coef0, self.degree

        def run(x):
            n = (x**2).sum(1)
            return {"linear": lambda: n, "polynomial": lambda: (gamma * n + coef0) ** degree, "rbf": lambda: np.ones(len(x)), "sigmoid": lambda: np.tanh(gamma * n + coef0)}[name]()

        return run

    def _pivots(self, df: DataFrame, gamma: float, n: int, norm: float):
        squares = self._squares(gamma)
        top = float(squares(np.array([[math.sqrt(norm)]]))[0]) or 1.0
        return pivots(df, self._columns(), self._kernel(gamma), squares, max(min(self.tol / (self.c * n), 1e-6 * top), 1e-9 * top))

    def _newton(self, df: DataFrame, target: Column, gamma: float, at: np.ndarray, inverse: np.ndarray, n: int, wide: float, epsilon: float | None = None) -> tuple[np.ndarray, float]:
        """Weights of the pivots and the bias; target is 1 or -1, or with epsilon the value."""
        p, r, c, kernel, columns = len(self.features), len(at), self.c, self._kernel(gamma), [*self._columns(), target]
        upper = np.triu_indices(r + 1)

        def factors(a):
            return np.column_stack([kernel(a[:, :p], at) @ inverse.T, np.ones(len(a))])

        def terms(f, y):
            return [(1 - y * f, -y)] if epsilon is None else [(f - y - epsilon, 1.0), (y - f - epsilon, -1.0)]

        def rounded(u, h):
            s = np.clip(u / h + 0.5, 0, 1)
            return s, np.where(s < 1, h / 2 * s * s, u)

        def look(v, h):
            def run(a):
                z, y = factors(a), a[:, p]
                value, g, hess = 0.0, np.zeros(r + 1), np.zeros((r + 1, r + 1))
                for u, sign in terms(z @ v, y):
                    s, loss = rounded(u, h)
                    bent = z[(s > 0) & (s < 1)]
                    value, g, hess = value + loss.sum(), g + z.T @ (sign * s), hess + bent.T @ bent / h
                return np.r_[value, g, hess[upper]]

            got = c * batch_sums(df, columns, run, 1 + (r + 1) + len(upper[0]))
            hess = np.zeros((r + 1, r + 1))
            hess[upper] = got[r + 2 :]
            hess = np.triu(hess) + np.triu(hess, 1).T + np.diag(np.r_[np.ones(r), 1e-8 * c * n])
            return got[0] + v[:r] @ v[:r] / 2, got[1 : r + 2] + np.r_[v[:r], 0], hess

        def along(v, move, steps, h):
            def run(a):
                z, y = factors(a), a[:, p]
                f, d = z @ v, z @ move
                return np.array([sum(rounded(u, h)[1].sum() for u, _ in terms(f + t * d, y)) for t in steps])

            places = v + np.outer(steps, move)
            return c * batch_sums(df, columns, run, len(steps)) + (places[:, :r] ** 2).sum(1) / 2

        v, h, left = np.zeros(r + 1), max(wide, self.tol), self.max_iter
        while True:
            value, g, hess = look(v, h)
            while True:
                move = np.linalg.solve(hess, -g)
                gain = float(-g @ move)
                if gain <= (self.tol**2 / 10 if h <= self.tol else 1e-3 * value):
                    break
                if not left:
                    raise NotConverged("Newton's method")
                left -= 1
                new = look(v + move, h)
                if new[0] > value - 1e-4 * gain:
                    steps = 0.5 ** np.arange(1, 49)
                    values = along(v, move, steps, h)
                    best = int(values.argmin())
                    if values[best] >= value:  # sums are not exact to the last digits
                        if gain > 1e-9 * value:
                            raise NotConverged("Newton's method")
                        break
                    move = steps[best] * move
                    new = look(v + move, h)
                v, (value, g, hess) = v + move, new
            if h <= self.tol:
                return inverse.T @ v[:r], float(v[r])
            h = max(h / 4, self.tol)

    def _all(self, df: DataFrame) -> tuple[np.ndarray, list]:
        got = df.select(*self._columns(), F.col(self.label)).collect()
        return np.array([[float(v) for v in r[:-1]] for r in got]), [r[-1] for r in got]


def couple(r: np.ndarray) -> np.ndarray:
    """Class probabilities (rows x k) that best agree with pairwise ones r (rows x k x k): least sum of (r_ji p_i - r_ij p_j)^2."""
    k = r.shape[1]
    q = -r * r.transpose(0, 2, 1)
    own = (r.transpose(0, 2, 1) ** 2).sum(2) - np.einsum("nii->ni", r) ** 2
    q[:, np.arange(k), np.arange(k)] = own
    system = np.ones((len(r), k + 1, k + 1))
    system[:, :k, :k], system[:, k, k] = q, 0
    right = np.zeros((len(r), k + 1, 1))
    right[:, k] = 1
    p = np.clip(np.linalg.solve(system, right)[:, :k, 0], 0, None)
    return p / p.sum(1, keepdims=True)


class SVC(_KernelSVM):
    """One-vs-one votes, ties to the smaller class. With probability=True each pair's margins, taken out of fold
    (at most five folds, by hash of row_id or else of the features), are calibrated by a sigmoid, and the pairs are coupled."""

    defaults = {**_KernelSVM.shared, "probability": False}

    def _machine(self, df: DataFrame, y: Column, gamma: float, n: int, base) -> tuple[np.ndarray, np.ndarray, float]:
        """Vectors, weights and bias of one pair; y is 1 or -1."""
        if base is not None:
            return base[0], *self._newton(df, y, gamma, *base, n, 1.0)
        got = np.array([[float(v) for v in r] for r in df.select(*self._columns(), y).collect()])
        x, y, kernel = got[:, :-1], got[:, -1], self._kernel(gamma)
        a, b = smo(lambda i: y[i] * y * kernel(x, x[i : i + 1])[:, 0], -np.ones(len(y)), y, self.c, self.tol, self.max_iter, self._squares(gamma)(x))
        keep = a > 1e-12
        return x[keep], (a * y)[keep], b

    def _sigmoid(self, df: DataFrame, y: Column, gamma: float, pos: int, neg: int, base, fitted) -> tuple[float, float]:
        p, folds, kernel = len(self.features), min(5, pos, neg), self._kernel(gamma)
        fold, machines = F.lit(0), [fitted]
        if folds > 1:
            hashed = F.pmod(F.xxhash64(F.lit("fold"), *([F.col(self.row_id)] if self.row_id else self._columns())), F.lit(folds)).cast("int")
            counts = {(r[0], r[1]): r["count"] for r in df.groupBy(hashed.alias("f"), y.alias("y")).count().collect()}
            if all(sum(k for (f, v), k in counts.items() if f != own and v == c) for own in range(folds) for c in (1.0, -1.0)):
                fold = hashed
                machines = [self._machine(df.where(hashed != f), y, gamma, pos + neg, base) for f in range(folds)]

        def at(a, b, high, low):
            def run(rows):
                scores = np.empty(len(rows))
                for f, (vectors, weights, bias) in enumerate(machines):
                    own = rows[:, p + 1] == f
                    scores[own] = kernel(rows[own, :p], vectors) @ weights + bias
                return platt_sums(scores, rows[:, p], a, b, high, low)

            return batch_sums(df, [*self._columns(), y, fold.cast("double")], run, 6)

        return platt(at, pos, neg)

    def fit(self, df: DataFrame) -> "KernelModel":
        df = df.persist()
        try:
            row, gamma = self._scan(df, list(self.features))
            counts = {r[0]: r["count"] for r in df.groupBy(self.label).count().collect()}
            if None in counts:
                raise EmptyInput(f"{self.label} has missing values")
            classes = sorted(counts)
            if len(classes) < 2:
                raise EmptyInput("two classes or more are needed")
            base = self._pivots(df, gamma, row["_rows"], row["_norm"]) if self._factored(gamma) else None
            machines = []
            for i in range(len(classes)):
                for j in range(i + 1, len(classes)):
                    both = df.where(F.col(self.label).isin(classes[i], classes[j]))
                    y = F.when(F.col(self.label) == F.lit(classes[i]), 1.0).otherwise(-1.0)
                    pos, neg = counts[classes[i]], counts[classes[j]]
                    found = self._machine(both, y, gamma, pos + neg, base)
                    machine = {"i": i, "j": j, "vectors": found[0].tolist(), "weights": found[1].tolist(), "bias": found[2]}
                    if self.probability:
                        machine["sigmoid"] = list(self._sigmoid(both, y, gamma, pos, neg, base, found))
                    machines.append(machine)
        finally:
            df.unpersist()
        return KernelModel(kind="classifier", features=list(self.features), classes=classes, machines=machines, kernel=self.kernel, gamma=gamma, coef0=self.coef0, degree=self.degree, prediction=self.prediction)


class SVR(_KernelSVM):
    defaults = {**_KernelSVM.shared, "epsilon": 0.1}

    def fit(self, df: DataFrame) -> "KernelModel":
        df, label = df.persist(), F.col(self.label).cast("double")
        try:
            row, gamma = self._scan(df, [*self.features, self.label], F.stddev_pop(label).alias("_wide"))
            if self._factored(gamma):
                at, inverse = self._pivots(df, gamma, row["_rows"], row["_norm"])
                vectors, (weights, bias) = at, self._newton(df, label, gamma, at, inverse, row["_rows"], row["_wide"], self.epsilon)
            else:
                x, y = self._all(df)
                y, n, kernel = np.array(y, float), len(y), self._kernel(gamma)
                s = np.r_[np.ones(n), -np.ones(n)]
                a, bias = smo(lambda i: s[i] * s * np.tile(kernel(x, x[i % n][None])[:, 0], 2), np.r_[self.epsilon - y, self.epsilon + y], s, self.c, self.tol, self.max_iter, np.tile(self._squares(gamma)(x), 2))
                keep = np.abs(a[:n] - a[n:]) > 1e-12
                vectors, weights = x[keep], (a[:n] - a[n:])[keep]
        finally:
            df.unpersist()
        return KernelModel(kind="regressor", features=list(self.features), classes=[], machines=[{"i": 0, "j": 0, "vectors": vectors.tolist(), "weights": weights.tolist(), "bias": bias}], kernel=self.kernel, gamma=gamma, coef0=self.coef0, degree=self.degree, prediction=self.prediction)


class KernelModel(Model):
    def decisions(self, df: DataFrame, name: str = "decision") -> DataFrame:
        """df with an array of each machine's decision; Arrow batches against the broadcast support vectors."""
        shared = df.sparkSession.sparkContext.broadcast(self.state())
        features = self.features

        def run(batches):
            m = shared.value
            for b in batches:
                x = np.column_stack([b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features])
                cols = [kernel_matrix(m["kernel"], x, np.array(s["vectors"]).reshape(-1, x.shape[1]), m["gamma"], m["coef0"], m["degree"]) @ np.array(s["weights"]) + s["bias"] for s in m["machines"]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.column_stack(cols).tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, name])

        return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, ArrayType(DoubleType())))

    def probabilities(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """df with an array of probabilities in the order of classes."""
        if self.kind != "classifier" or "sigmoid" not in self.machines[0]:
            raise UnsupportedOperation("fit SVC with probability=True")
        k, machines = len(self.classes), [(m["i"], m["j"], *m["sigmoid"]) for m in self.machines]

        def run(batches):
            for batch in batches:
                d = np.array(batch.column("_d").to_pylist(), float).reshape(-1, len(machines))
                r = np.full((len(d), k, k), 0.5)
                for at, (i, j, a, b) in enumerate(machines):
                    p = np.clip(1 / (1 + np.exp(np.clip(a * d[:, at] + b, -500, 500))), 1e-7, 1 - 1e-7)
                    r[:, i, j], r[:, j, i] = p, 1 - p
                p = couple(r) if k > 2 else r[:, [0, 1], [1, 0]]
                rest = batch.drop_columns(["_d"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p.tolist(), pa.list_(pa.float64()))], names=[*rest.schema.names, name])

        return self.decisions(df, "_d").mapInArrow(run, StructType([*df.schema.fields]).add(name, ArrayType(DoubleType())))

    def transform(self, df: DataFrame) -> DataFrame:
        d = self.decisions(df, "_d")
        if self.kind == "regressor":
            return d.withColumn(self.prediction, F.get("_d", F.lit(0))).drop("_d")
        votes = F.array(*[sum((F.when(F.get("_d", F.lit(k)) > 0, int(m["i"] == c)).otherwise(int(m["j"] == c)) for k, m in enumerate(self.machines)), F.lit(0)) for c in range(len(self.classes))])
        return d.withColumn(self.prediction, F.get(F.array(*map(F.lit, self.classes)), F.array_position(votes, F.array_max(votes)).cast("int") - 1)).drop("_d")
