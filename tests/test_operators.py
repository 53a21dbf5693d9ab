"""Behaviour that the oracle queries do not reach: errors, edge cases, learned models, files, streams."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstat import base, errors
from loomstat.functions import sparse
from loomstat.functions import vectors as V
from loomstat.operators import cluster, decomposition, ensemble, impute, linear, metrics, model_selection, neighbors, outlier, preprocessing, svm, tree
from loomstat.plans.pipeline import Graph, Pipeline
from loomstat.sources import readers
from loomstat.streaming.incremental import fit_stream


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def separable(spark):
    pts = [(2, 1), (1, 2), (1, 1), (-2, -1), (-1, -2), (-1, -1)] * 5
    return table(spark, [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(pts)], "id long, a double, b double, y int")


def test_scaler_of_constant_column(spark):
    df = table(spark, [(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    m = preprocessing.StandardScaler(features=["a", "b"]).fit(df)
    assert [tuple(r) for r in m.transform(df).select("a_scaled", "b_scaled").collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_guards(spark):
    df = table(spark, [(1.0, "x"), (None, "y")], "a double, s string")
    with pytest.raises(errors.NonFiniteValue):
        preprocessing.StandardScaler(features=["a"]).fit(df)
    with pytest.raises(errors.UnsupportedColumnType):
        preprocessing.StandardScaler(features=["s"]).fit(df)
    with pytest.raises(errors.UnknownColumn):
        preprocessing.MinMaxScaler(features=["z"]).fit(df)
    with pytest.raises(errors.InvalidParameter):
        preprocessing.MinMaxScaler(high=0.0)
    with pytest.raises(errors.EmptyInput):
        preprocessing.StandardScaler(features=["a"]).fit(df.where("false"))


def test_unknown_category(spark):
    df = table(spark, [(0, "x"), (1, "y")], "id long, s string")
    m = preprocessing.OneHotEncoder(features=["s"], row_id="id").fit(df)
    with pytest.raises(errors.UnknownLabel):
        m.transform(table(spark, [(2, "z")], "id long, s string"))


def test_exact_least_squares(spark):
    df = table(spark, [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)], "x double, z double").withColumn("y", 3 * F.col("x") - 2 * F.col("z") + 0.5)
    m = linear.LinearRegression(features=["x", "z"], label="y").fit(df)
    assert np.allclose([*m.coef, m.intercept], [3, -2, 0.5])


def test_wide_gram_through_arrow(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 30))
    names = [f"f{i}" for i in range(30)]
    g = V.gram(table(spark, x.tolist(), ", ".join(f"{n} double" for n in names)), names)
    assert np.allclose(g["xx"], x.T @ x) and g["n"] == 50


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_logistic(spark, separable, penalty):
    m = linear.LogisticRegression(features=["a", "b"], label="y", penalty=penalty, c=10.0, max_iter=15).fit(separable)
    out = m.transform(separable)
    assert metrics.accuracy(out, "y", "prediction").first()[0] == 1.0
    assert abs(sum(out.first()["probability"]) - 1) < 1e-9


@pytest.mark.parametrize("loss", ["hinge", "log_loss", "modified_huber", "squared_hinge", "perceptron"])
def test_sgd_losses(spark, separable, loss):
    m = linear.SGDClassifier(features=["a", "b"], label="y", row_id="id", loss=loss, max_epochs=2, parts=1).fit(separable)
    assert metrics.accuracy(m.transform(separable), "y", "prediction").first()[0] == 1.0


def test_svms(spark, separable):
    for m in (svm.SVC(features=["a", "b"], label="y", row_id="id").fit(separable), svm.LinearSVC(features=["a", "b"], label="y", max_iter=10).fit(separable)):
        assert metrics.accuracy(m.transform(separable), "y", "prediction").first()[0] == 1.0


def test_smo_meets_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    q = svm.kernel_matrix("rbf", x, x, 0.5, 0, 3) * np.outer(y, y)
    a, b = svm.smo(q, -np.ones(60), y, 1.0)
    assert abs(a @ y) < 1e-9 and a.min() >= -1e-12 and a.max() <= 1 + 1e-12
    margin = y * ((svm.kernel_matrix("rbf", x, x, 0.5, 0, 3) @ (a * y)) + b)
    assert (margin[a < 1e-9] > 1 - 5e-3).all()


def test_tree_and_forest(spark):
    rows = [(i, ((17 * i) % 101) / 50 - 1, ((31 * i) % 101) / 50 - 1) for i in range(400)]
    df = table(spark, rows, "id long, a double, b double").withColumn("y", ((F.col("a") > 0.1) & (F.col("b") > 0)).cast("int"))
    t = tree.DecisionTreeClassifier(features=["a", "b"], label="y").fit(df)
    assert metrics.accuracy(t.transform(df), "y", "prediction").first()[0] == 1.0 and abs(sum(t.importances) - 1) < 1e-9
    f = ensemble.RandomForestClassifier(features=["a", "b"], label="y", row_id="id", trees=2, max_depth=2, max_features="all", max_bins=16).fit(df)
    assert metrics.accuracy(f.transform(df), "y", "prediction").first()[0] > 0.85
    assert f.out_of_bag(df).count() > 100


def test_boosting_lowers_loss(spark):
    df = table(spark, [(i, i / 50, math.sin(i / 20)) for i in range(200)], "id long, x double, y double")
    m = ensemble.GradientBoosting(features=["x"], label="y", row_id="id", stages=4, rate=0.5, max_depth=2).fit(df)
    assert metrics.regression(m.transform(df), "y", "prediction").first()["r2"] > 0.8


def test_boosting_stops_early_and_gives_probabilities(spark):
    df = table(spark, [(i, i / 50, int(i % 100 < 50)) for i in range(300)], "id long, x double, y int")
    m = ensemble.GradientBoosting(features=["x"], label="y", row_id="id", loss="log_loss", stages=12, rate=1.0, max_depth=2, patience=1, validation=0.3, tol=10.0, probability="share").fit(df)
    assert len(m.chains[0]["trees"]) == 2  # the first stage is better than nothing, the second is not by 10
    for r in m.transform(df).collect():
        assert abs(sum(r.share) - 1) < 1e-9 and r.prediction == int(r.share[1] > 0.5)
    with pytest.raises(errors.InvalidParameter):
        ensemble.GradientBoosting(features=["x"], patience=2)
    with pytest.raises(errors.InvalidParameter):
        ensemble.GradientBoosting(features=["x"], probability="p")


def test_sparse_rows(spark):
    x = np.array([[0, 1, 0, 2], [3, 0, -1, 0], [0, 0, 0, 0], [1, 1, 1, 1], [-2, 0, 4, 0.5]])
    df = table(spark, [(i, row.tolist()) for i, row in enumerate(x)] + [(9, None)], "id int, x array<double>").select("id", sparse.sparse("x").alias("s"))
    assert {r.id: r.d for r in df.select("id", sparse.dense("s").alias("d")).collect()} == {**{i: row.tolist() for i, row in enumerate(x)}, 9: None}
    far = {"euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "manhattan": lambda a, b: np.abs(a - b).sum(), "chebyshev": lambda a, b: np.abs(a - b).max(), "cosine": lambda a, b: 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else 1.0}
    pairs = df.where("id < 9").withColumnsRenamed({"id": "i", "s": "a"}).join(df.where("id < 9").withColumnsRenamed({"id": "j", "s": "b"}), F.lit(True))
    for r in pairs.select("i", "j", sparse.dot("a", "b").alias("dot"), *[sparse.distance(m, "a", "b").alias(m) for m in far]).collect():
        assert abs(r.dot - x[r.i] @ x[r.j]) < 1e-12 and all(abs(r[m] - f(x[r.i], x[r.j])) < 1e-12 for m, f in far.items())
    t = sparse.triplets(df, "id", "s")
    got = np.zeros((5, 5))
    for r in sparse.product(t, t.selectExpr("column as row", "row as column", "value")).collect():
        got[r.row, r.column] = r.value
    assert np.allclose(got, x @ x.T)
    with pytest.raises(errors.InvalidParameter):
        sparse.distance("hamming", "a", "b")


def test_sparse_outputs_equal_dense_ones(spark):
    df = table(spark, [(0, "u", 1.0), (1, "v", 0.0), (2, None, 2.0), (3, "u", -1.0)], "id long, c string, x double")
    dense = preprocessing.OneHotEncoder(features=["c"], row_id="id").fit(df)
    thin = preprocessing.OneHotEncoder(features=["c"], row_id="id", sparse_output="s").fit(df)
    both = thin.transform(dense.transform(df)).withColumn("d", sparse.dense("s")).collect()
    assert all(list(r.d) == [r.c_0, r.c_1] for r in both)
    poly = preprocessing.PolynomialFeatures(features=["x"], sparse_output="s").transform(df).orderBy("id").select(sparse.dense("s")).collect()
    assert [list(r[0]) for r in poly] == [[1, 1, 1], [1, 0, 0], [1, 2, 4], [1, -1, 1]]


def test_metric_states(spark):
    df = table(spark, [(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, p double")
    parts = [metrics.RegressionState().observe(df.where(w), "y", "p") for w in ("y < 3", "y >= 3", "y is null")]
    merged, whole = parts[0].merge(parts[1]).merge(parts[2]).result(), metrics.regression(df.where("y is not null"), "y", "p").first()
    assert all(abs(merged[k] - whole[k]) < 1e-12 for k in ("mse", "rmse", "mae", "r2"))
    with pytest.raises(errors.EmptyInput):
        metrics.RegressionState().result()
    with pytest.raises(errors.EmptyInput):
        metrics.ClassificationState().result()


def test_kmeans_planted(spark):
    rows = [(r, *[g * 1000 + ((7 * r + 13 * f) % 17) * 0.05 for f in range(3)], g) for r in range(60) for g in [r % 3]]
    df = table(spark, rows, "id long, a double, b double, c double, g int")
    m = cluster.KMeans(features=["a", "b", "c"], k=3, row_id="id").fit(df)
    assert metrics.adjusted_rand(m.transform(df), "g", "cluster").first()[0] == 1.0
    again = cluster.KMeans(features=["a", "b", "c"], k=3, row_id="id").fit(df.repartition(7))
    assert np.allclose(sorted(m.centres), sorted(again.centres))


def test_dbscan_noise_and_predict(spark):
    df = table(spark, [(i, float(x)) for i, x in enumerate([0, 0.1, 0.2, 0.3, 5, 9, 9.1, 9.2])], "id long, x double")
    d = cluster.DBSCAN(features=["x"], row_id="id", eps=0.25, min_samples=3)
    fitted = d.fit_transform(df)
    assert [r.cluster for r in fitted.orderBy("id").collect()] == [0, 0, 0, 0, -1, 1, 1, 1]
    new = table(spark, [(10, 0.05), (11, 6.0)], "id long, x double")
    assert {r.id: r.cluster for r in d.predict(fitted, new).collect()} == {10: 0, 11: -1}


def test_connected_paths(spark):
    rng = np.random.default_rng(3)
    names = rng.permutation(300)
    links = [(int(names[i]), int(names[i + 1])) for i in range(299) if i % 50 != 49] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.u: r.l for r in cluster.connected(table(spark, links + [(b, a) for a, b in links], "u long, v long")).collect()}
    want = {int(names[i]): int(min(names[i // 50 * 50 : i // 50 * 50 + 50])) for i in range(300)} | {1000 + i: 1000 for i in range(41)}
    assert got == want
    assert cluster.connected(table(spark, [], "u long, v long")).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_dbscan_against_plain(spark, metric):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(size=(60, 3)), rng.normal(size=(40, 3)) + 4, rng.uniform(-8, 8, (20, 3)), np.ones((15, 3))]
    n, eps, least = len(x), 0.9, 4
    d = np.abs(x[:, None] - x[None])
    d = {"euclidean": np.sqrt((d * d).sum(-1)), "manhattan": d.sum(-1), "chebyshev": d.max(-1)}[metric]
    near = d <= eps
    core = near.sum(1) >= least
    want, number = np.full(n, -1), 0
    for i in range(n):
        if core[i] and want[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if want[j] < 0:
                    want[j] = number
                    if core[j]:
                        todo += np.flatnonzero(near[j] & core).tolist()
            number += 1
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            want[i] = min(want[j] for j in np.flatnonzero(near[i] & core))
    df = table(spark, [(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    out = cluster.DBSCAN(features=["a", "b", "c"], row_id="id", eps=eps, min_samples=least, metric=metric).fit_transform(df)
    assert [r.cluster for r in out.orderBy("id").collect()] == want.tolist() and number > 1


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_trees_and_brute_force_agree(spark, metric, monkeypatch):
    monkeypatch.setattr(neighbors, "TREE_BLOCK", 150)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 30)
    monkeypatch.setattr(neighbors, "LEAF", 8)
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, v)) for i, v in enumerate(np.r_[rng.integers(0, 4, (200, 3)), rng.normal(size=(200, 3))])]
    df = table(spark, rows, "id long, a double, b double, c double")
    ask = df.where("id % 7 = 0")
    found = {how: sorted(map(tuple, neighbors.k_nearest(df, ask, ["a", "b", "c"], "id", "id", 9, metric, algorithm=how).collect())) for how in ("brute", "kd_tree", "ball_tree", "auto")}
    plain = [(q, r, i) for q, r, i, _ in found["brute"]]
    for how in ("kd_tree", "ball_tree", "auto"):
        assert [(q, r, i) for q, r, i, _ in found[how]] == plain and np.allclose([r[3] for r in found[how]], [r[3] for r in found["brute"]])
    with pytest.raises(errors.InvalidParameter):
        neighbors.k_nearest(df, ask, ["a"], "id", "id", 3, "cosine", algorithm="kd_tree")
    with pytest.raises(errors.NonFiniteValue):
        neighbors.k_nearest(df.withColumn("a", F.lit(float("nan"))), ask, ["a"], "id", "id", 3, algorithm="ball_tree")


def test_radius_search_in_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 10)
    rows = [(i, 0.0, float(i % 5)) for i in range(60)] + [(100 + i, float(i), 0.0) for i in range(9)]
    df = table(spark, rows, "id long, a double, b double")
    got = {(r.query_id, r.neighbor_id) for r in neighbors.radius_neighbors(df, df, ["a", "b"], "id", "id", 1.0).collect()}
    assert got == {(p[0], q[0]) for p in rows for q in rows if math.hypot(p[1] - q[1], p[2] - q[2]) <= 1.0}


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(2).normal(size=(40, 4)) @ np.diag([3, 2, 1, 0.5])
    names = list("abcd")
    m = decomposition.PCA(features=names, k=2, whiten=True).fit(table(spark, x.tolist(), "a double, b double, c double, d double"))
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(m.components), np.abs(vt[:2])) and np.allclose(m.variance, s[:2] ** 2 / 39)
    values, vectors = decomposition.randomized_eigh(x.T @ x, 2)
    assert np.allclose(values, np.linalg.eigvalsh(x.T @ x)[::-1][:2])


def test_isolation_forest_finds_far_row(spark):
    df = table(spark, [(i, (i * 7 % 13) / 10, (i * 5 % 11) / 10) for i in range(200)] + [(200, 50.0, 50.0)], "id long, a double, b double")
    out = outlier.IsolationForest(features=["a", "b"], row_id="id", trees=20).fit(df).transform(df)
    assert out.orderBy("score").first().id == 200


def test_weighted_neighbours(spark):
    train = table(spark, [(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 4.0, 90.0)], "id long, x double, y double")
    m = neighbors.KNeighborsRegressor(features=["x"], label="y", row_id="id", k=2, weights="distance").fit(train)
    got = {r.id: r.prediction for r in m.transform(table(spark, [(7, 0.0), (8, 3.0)], "id long, x double")).collect()}
    assert got[7] == 10.0 and abs(got[8] - (20 / 2 + 90 / 1) / 1.5) < 1e-9


def test_distances_of_odd_vectors(spark):
    df = table(spark, [([0.0, 0.0], [1.0, 2.0]), ([1.0, None], [4.0, 7.0])], "x array<double>, y array<double>")
    got = df.select(V.cosine("x", "y").alias("c"), V.nan_euclidean("x", "y").alias("n")).collect()
    assert got[0].c == 1.0 and abs(got[1].n - 3 * math.sqrt(2)) < 1e-12


def test_shuffled_splits(spark):
    df = spark.range(103)
    for n in (1, 5):
        s = model_selection.train_test_split(df.repartition(n), "id")
        assert s.where("is_test").count() == 26
    a = {r.id for r in model_selection.train_test_split(df.repartition(1), "id").where("is_test").collect()}
    b = {r.id for r in model_selection.train_test_split(df.repartition(6), "id").where("is_test").collect()}
    assert a == b
    sizes = sorted(r["count"] for r in model_selection.k_fold(df, "id", 5, shuffle=True).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]


def test_search_and_schedule(spark):
    assert model_selection.halving_schedule(9, 100, 3, 10) == [(10, 9), (30, 3), (90, 1)]
    df = model_selection.k_fold(spark.range(60).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y")), "id", 3)
    s = model_selection.GridSearch(linear.Ridge(features=["x"], label="y"), model_selection.grid(alpha=[1e7, 0.0, 0.0]), "mse", "y").fit(df)
    assert s.best_index_ == 1


def test_saved_model(spark, separable, tmp_path):
    m = preprocessing.StandardScaler(features=["a"]).fit(separable)
    m.save(str(tmp_path / "model"))
    assert base.load(str(tmp_path / "model")).state() == m.state()


def test_files(spark, tmp_path):
    t = pa.table({"a": [1, 2, 3], "b": [0.5, 1.5, 2.5]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert readers.read(spark, str(tmp_path / "t.arrow"), "arrow_file").agg(F.sum("b")).first()[0] == 4.5
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "m.npy"), "npy").collect()] == [(0, 1), (2, 3), (4, 5)]
    np.arange(4, dtype="<i8").tofile(tmp_path / "r.bin")
    raw = readers.read(spark, str(tmp_path / "r.bin"), "raw", descriptor=readers.read_descriptor('{"kind": "i64", "columns": 2}'))
    assert [tuple(r) for r in raw.collect()] == [(0, 1), (2, 3)]
    (tmp_path / "t.csv").write_text("a;b\n1;x\n")
    assert readers.read(spark, str(tmp_path / "t.csv"), "csv", schema="a int, b string", delimiter=";").first().b == "x"
    (tmp_path / "t.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read(spark, str(tmp_path / "t.json"), "ndjson", schema="a int").count() == 2


def test_selection_and_types(spark):
    df = table(spark, [(1, "x", None)], "a int, s string, d double")
    assert readers.select(df, [2, "a"], "s").columns == ["d", "a", "s"]
    with pytest.raises(errors.DuplicateColumn):
        readers.select(df, ["a", 0])
    with pytest.raises(errors.NullValueInColumn):
        readers.missing(df)
    assert math.isnan(readers.missing(df, "nan").first().d)
    with pytest.raises(errors.UnsupportedColumnType):
        readers.kinds(df.withColumn("t", F.current_timestamp()))


def test_graph_checks(spark):
    scaler = preprocessing.StandardScaler(features=["a"])
    with pytest.raises(errors.InvalidParameter):
        Graph().add("x", scaler, "y").add("y", scaler, "x").order()
    with pytest.raises(errors.InvalidParameter):
        Graph().add("x", scaler).add("y", scaler).order()
    assert Graph().add("z", scaler, "b", "a").add("b", scaler).add("a", scaler).order() == ["a", "b", "z"]


def test_stream_equals_batch(spark, separable, tmp_path):
    separable.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(separable.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    e = linear.LinearRegression(features=["a"], label="b")
    streamed, whole = fit_stream(e, stream, str(tmp_path / "cp")), e.fit(separable)
    assert np.allclose([*streamed.coef, streamed.intercept], [*whole.coef, whole.intercept])
    piped = Pipeline(preprocessing.StandardScaler(features=["a"])).fit_stream([separable.where("id < 7"), separable.where("id >= 7")])
    assert np.allclose(piped.models[0].mean, preprocessing.StandardScaler(features=["a"]).fit(separable).mean)


def test_incremental_transformers(spark):
    df = spark.range(1000).select("id", (F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 4 > 0, F.col("id") % 10).cast("double").alias("g"), F.concat(F.lit("c"), F.floor(F.col("id") / 400)).alias("s"))
    a, b = df.where("id < 300"), df.where("id >= 300")
    exact = preprocessing.RobustScaler(features=["x"]).fit(df).quantiles[0]
    merged = preprocessing.RobustScaler(features=["x"], sketch=True).fit(a).update(b).quantiles[0]
    assert np.abs(np.array(exact) - merged).max() <= 2
    with pytest.raises(errors.UnsupportedOperation):
        preprocessing.RobustScaler(features=["x"]).fit(a).update(b)
    e = impute.SimpleImputer(features=["g"])
    assert abs(e.update(e.fit(a), b).fills[0] - e.fit(df).fills[0]) < 1e-9
    hot = preprocessing.OneHotEncoder(features=["s"], row_id="id").fit(a).update(b, "id")
    assert hot.categories == preprocessing.OneHotEncoder(features=["s"], row_id="id").fit(df).categories


def test_tensor_files(spark, separable):
    from loomstat.sources import tensors

    m = preprocessing.StandardScaler(features=["a", "b"]).fit(separable)
    for compress in (False, True):
        data = tensors.model_bytes(m, compress)
        assert tensors.model_from(data).state() == m.state()
    with pytest.raises(errors.SchemaMismatch):
        tensors.decode(b"abc")
    t = {n: np.zeros(k) for n, k in (("a", 2), ("b", 2), ("c", 9), ("d", 1))}
    assert tensors.shards(t, 32) == [["a", "b"], ["c"], ["d"]]


def test_svc_probabilities(spark):
    rng = np.random.default_rng(4)
    truth = np.array([0.5, 0.3, 0.2])
    r = truth[:, None] / (truth[:, None] + truth)
    assert np.allclose(svm.couple(r[None])[0], truth)
    centres = [(0, 0), (4, 0), (0, 4)]
    rows = [(i, float(x), float(y), i % 3) for i in range(90) for x, y in [rng.normal(size=2) * 0.5 + centres[i % 3]]]
    df = table(spark, rows, "id long, a double, b double, y int")
    m = svm.SVC(features=["a", "b"], label="y", row_id="id", probability=True).fit(df)
    got = m.probabilities(df).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 and int(np.argmax(r.probability)) == r.y for r in got)
    assert metrics.accuracy(m.transform(df), "y", "prediction").first()[0] == 1.0


def _not_of_least_hash(spark, n=4100, most=4000):
    """Ids that a sample of the `most` rows of least hash leaves out."""
    return {r.id for r in spark.range(n).orderBy(F.desc(F.xxhash64("id")), F.desc("id")).limit(n - most).collect()}


def test_svr_learns_from_all_rows(spark):
    late = _not_of_least_hash(spark)
    df = table(spark, [(i, 3.0 + i % 7 / 10, 2.0) if i in late else (i, i % 11 / 10, 0.0) for i in range(4100)], "id long, x double, y double")
    out = svm.SVR(features=["x"], label="y", row_id="id").fit(df).transform(df)
    assert out.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.12


def test_svc_learns_from_all_rows(spark):
    late = _not_of_least_hash(spark)
    df = table(spark, [(i, 5.0 + i % 7 / 10, 2) if i in late else (i, i % 2 + i % 11 / 50, i % 2) for i in range(4100)], "id long, x double, y int")
    m = svm.SVC(features=["x"], label="y", row_id="id").fit(df)
    assert m.classes == [0, 1, 2] and abs(m.gamma - V.gamma_scale(df, ["x"])) < 1e-12
    assert metrics.accuracy(m.transform(df), "y", "prediction").first()[0] == 1.0


@pytest.mark.parametrize("kernel, coef0", [("rbf", 0.0), ("polynomial", 1.0), ("sigmoid", 0.0)])
def test_kernel_machines_match_the_dual(spark, kernel, coef0):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 2)) / 2
    y, sign = np.sin(2 * x[:, 0]) + 0.3 * rng.normal(size=150), np.where(x.sum(1) + 0.4 * rng.normal(size=150) > 0, 1.0, -1.0)
    df = table(spark, [(i, *map(float, r), float(v), int(s < 0)) for i, (r, v, s) in enumerate(zip(x, y, sign))], "id long, a double, b double, y double, g int")
    k = svm.kernel_matrix(kernel, x, x, 0.5, coef0, 3)
    args = dict(features=["a", "b"], row_id="id", kernel=kernel, gamma=0.5, coef0=coef0, tol=1e-4)
    tol = 1e-4 if kernel == "sigmoid" else 1e-6
    a, b = svm.smo(k * np.outer(sign, sign), -np.ones(150), sign, 1.0, tol)
    got = [r.decision[0] for r in svm.SVC(label="g", **args).fit(df).decisions(df).orderBy("id").collect()]
    assert np.abs(k @ (a * sign) + b - got).max() < 1e-3
    two = np.r_[np.ones(150), -np.ones(150)]
    a, b = svm.smo(np.tile(k, (2, 2)) * np.outer(two, two), np.r_[0.1 - y, 0.1 + y], two, 1.0, tol)
    got = [r.prediction for r in svm.SVR(label="y", **args).fit(df).transform(df).orderBy("id").collect()]
    # the sigmoid kernel is indefinite: rounding leads to another of the stationary points
    assert np.abs(k @ (a[:150] - a[150:]) + b - got).max() < (2e-2 if kernel == "sigmoid" else 1e-3)


def test_minibatch_kmeans_visits_all_batches(spark):
    df = table(spark, [(i, i % 2 * 100.0 + i % 5) for i in range(40)], "id long, x double")
    args = dict(features=["x"], k=2, init=[[0.0], [100.0]], row_id="id", batch_size=8)
    m = cluster.MiniBatchKMeans(max_iter=1, **args).fit(df)
    assert m.rounds == 5 and sum(m.counts) == 40 and np.allclose(m.centres, [[2.0], [102.0]])
    assert cluster.MiniBatchKMeans(max_iter=2, epochs=3, **args).fit(df).rounds == 10


def pairs_of(rows, queries, measures, monkeypatch, digits=None):
    from loomstat.functions import blocks

    monkeypatch.setattr(neighbors, "PAIR_QUERIES", 2)
    monkeypatch.setattr(neighbors, "PAIR_ROWS", 7)
    monkeypatch.setattr(blocks, "TILE", 5)
    made = {m: blocks.measure(m, gamma=0.5, coef0=1.0) for m in measures}
    found = neighbors.pair_measures(queries, rows, "id", "x", made, digits).collect()
    out = {(r.query_id, r.id): tuple(r[m] for m in measures) for r in found}
    assert len(out) == len(found)
    return out


def test_kernels_of_blocks_equal_plain_ones(spark, monkeypatch):
    """blocks in Arrow, a plan without a join of rows; near pairs of long vectors keep their digits."""
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(20, 3)), 1e8 + rng.normal(size=(10, 3)) * 1e-2]
    x[3] = x[4]
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, 2.0])], "id long, x array<double>")
    names = ["linear", "polynomial", "rbf", "sigmoid"]
    found = pairs_of(df, df.where("id % 4 = 0 or id >= 90"), names, monkeypatch)
    assert len(found) == 11 * 33
    for (i, j), values in found.items():
        if max(i, j) >= 90:
            assert (values[0] is None) == (not (i == j == 92))
            continue
        dot, d = float(x[i] @ x[j]), x[i] - x[j]
        assert values == pytest.approx((dot, (0.5 * dot + 1) ** 3, math.exp(-0.5 * float(d @ d)), math.tanh(0.5 * dot + 1)), rel=1e-9, abs=1e-12)
    plan = neighbors.pair_measures(df, df, "id", "x", {})._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert neighbors.pair_measures(df.where("id = 5"), df.where("id < 0"), "id", "x", {}).count() == 0


def test_rounding_of_blocks():
    from loomstat.functions import blocks

    x = np.array([0.5, -0.5, 1.5, 2.5, -0.2, np.nan, np.inf, 1e308])
    assert [repr(float(v)) for v in blocks.rounded(x, 0)] == ["1.0", "-1.0", "2.0", "3.0", "0.0", "nan", "inf", "1e+308"]


def test_distances_of_blocks_equal_plain_ones(spark, monkeypatch):
    """also of equal vectors, of norm 0, and not finite."""
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=(20, 3)), np.zeros((1, 3)), [[np.inf, 0.0, 1.0], [np.nan, 0.0, 1.0]]]
    x[7] = x[8] = x[9]
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    found = pairs_of(df, df.where("id % 4 = 0 or id > 19"), ["euclidean", "squared_euclidean", "cosine", "manhattan", "chebyshev"], monkeypatch)
    assert len(found) == 8 * 23
    with np.errstate(all="ignore"):
        for (i, j), values in found.items():
            d, n = np.abs(x[i] - x[j]), np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])
            if {i, j} == {20, 21}:  # norms 0 and infinite
                n = np.nan
            want = np.sqrt(d @ d), d @ d, 1.0 if n == 0 else 1 - x[i] @ x[j] / n, d.sum(), d.max()
            assert values == pytest.approx(want, rel=1e-9, abs=1e-12, nan_ok=True), (i, j)
    assert {found[8, j][:2] for j in (7, 8, 9)} == {(0.0, 0.0)}


def test_distances_of_sparse_blocks_equal_dense_ones(spark, monkeypatch):
    """many columns, rows without cells, a null row; columns that no query stores count too."""
    rng = np.random.default_rng(7)
    x = np.where(rng.random((30, 12)) < 0.25, rng.normal(size=(30, 12)), 0.0)
    x[5] = 0.0
    wide = [(i, (1 << 30, [100_000_000 * int(k) // 7 for k in np.flatnonzero(v)], [float(a) for a in v[v != 0]])) for i, v in enumerate(x)]
    df = table(spark, [*wide, (90, None), (91, (3, [1], [1.0]))], f"id long, x {sparse.KIND}")
    names = ["dot", "euclidean", "manhattan", "chebyshev", "cosine"]
    found = pairs_of(df, df.where("id % 5 = 0"), names, monkeypatch)
    assert len(found) == 7 * 32
    for (i, j), values in found.items():
        if max(i, j) >= 90:
            assert (values[0] is None) == (not (i == j == 91))
            continue
        d, n = np.abs(x[i] - x[j]), np.linalg.norm(x[i]) * np.linalg.norm(x[j])
        assert values == pytest.approx((x[i] @ x[j], np.sqrt(d @ d), d.sum(), d.max(), 1 - x[i] @ x[j] / n if n else 1.0), rel=1e-9, abs=1e-12), (i, j)


@pytest.mark.parametrize("p", [2, 20])
def test_silhouettes_of_blocks_equal_plain_ones(spark, monkeypatch, p):
    """several blocks, equal rows far from 0, a cluster of one; a row with a null counts for no other row, as avg() in SQL."""
    monkeypatch.setattr(metrics, "SILHOUETTE_ROWS", 20)
    monkeypatch.setattr(metrics, "SILHOUETTE_OTHERS", 15)
    rng = np.random.default_rng(8)
    c = np.r_[np.arange(40) % 3, 7]
    x = 1e6 + rng.normal(size=(41, p)) + c[:, None]
    x[3] = x[6] = x[9]
    names = [f"f{i}" for i in range(p)]
    rows = [(i, int(k), *v.tolist()) for i, (k, v) in enumerate(zip(c, x))] + [(50, 1, None, *[0.0] * (p - 1)), (51, -1, *[0.0] * p)]
    found = {r.id: r.silhouette for r in metrics.silhouette_samples(table(spark, rows, f"id long, c int, {', '.join(f'{n} double' for n in names)}"), names, "c", "id").collect()}
    assert set(found) == {*range(41), 50} and found[40] == found[50] == 0
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for i in range(40):
        a = d[i, (c == c[i]) & (np.arange(41) != i)].mean()
        b = min(d[i, c == k].mean() for k in {0, 1, 2, 7} - {c[i]})
        assert found[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_minibatch_kmeans_goes_through_stretches_of_batches(spark, monkeypatch):
    """the same centres as batch by batch, restarts of centres with few rows too, in a number of jobs that does not grow with the batches."""
    rng = np.random.default_rng(9)
    df = table(spark, [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(300, 2)))], "id long, x double, y double")
    args = dict(features=["x", "y"], k=3, init=[[0.0, 0.0], [1.0, 1.0], [50.0, 50.0]], row_id="id", batch_size=10, reassign=0.2)
    spark.sparkContext.setJobGroup("minibatch", "")
    m = cluster.MiniBatchKMeans(**args)
    fitted = m.fit(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("minibatch"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs < 15 and fitted.rounds == 30
    model = cluster.KMeansModel(features=["x", "y"], centres=args["init"], inertia=0.0, rounds=0, cluster="cluster", counts=[0.0] * 3)
    for b in range(30):
        model = m.update(model, df.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(30)) == b))
    assert np.allclose(fitted.centres, model.centres, atol=1e-12) and fitted.counts == model.counts and fitted.inertia == pytest.approx(model.inertia)
    monkeypatch.setattr(cluster, "BATCH_CELLS", 140)
    parted = m.fit(df)
    assert parted.centres == fitted.centres and parted.counts == fitted.counts and parted.rounds == 30
    with pytest.raises(errors.NonFiniteValue):
        m.fit(df.unionByName(table(spark, [(999, None, 1.0)], "id long, x double, y double")))


def test_knn_imputer_compares_equal_receivers_once(spark, monkeypatch):
    """many receivers of few values and many ties, in several blocks; the plan joins no receiver with its donors."""
    monkeypatch.setattr(impute, "DONORS", 20)
    monkeypatch.setattr(impute, "RECEIVERS", 3)
    rng = np.random.default_rng(10)
    x = np.c_[rng.integers(0, 4, 200), rng.integers(0, 3, 200), rng.normal(size=200)].astype(float)
    x[rng.random((200, 3)) < 0.2] = np.nan
    x[:3] = np.nan
    df = table(spark, [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double")
    for weights in ("uniform", "distance"):
        out = impute.KNNImputer(features=["a", "b", "c"], row_id="id", k=4, weights=weights).fit_transform(df)
        found = {r.id: (r.a_imputed, r.b_imputed, r.c_imputed) for r in out.collect()}
        assert len(found) == 200 and out.columns == ["id", "a", "b", "c", "a_imputed", "b_imputed", "c_imputed"]
        for i, row in enumerate(x):
            both = ~np.isnan(x) & ~np.isnan(row)
            with np.errstate(all="ignore"):
                d = np.sqrt(np.where(both, (x - row) ** 2, 0).sum(1) * 3 / both.sum(1))
            for j in np.flatnonzero(np.isnan(row)):
                at = sorted((d[t], t) for t in range(200) if both[t].any() and not np.isnan(x[t, j]))[:4]
                w = [1.0] * len(at) if weights == "uniform" else [float(a == 0) for a, _ in at] if at and at[0][0] == 0 else [1 / a for a, _ in at]
                want = np.average([x[t, j] for _, t in at], weights=w) if at else np.nanmean(x[:, j])
                assert found[i][j] == pytest.approx(want), (weights, i, j)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 1  # of the fills with the rows


def test_dbscan_makes_pairs_of_thin_cells_only(spark, monkeypatch):
    """rows of dense cells search nothing; cells that boxes leave open are told by their rows, a row that is not finite is noise."""
    asked, search = [], cluster.radius_neighbors
    monkeypatch.setattr(cluster, "radius_neighbors", lambda train, queries, *rest: asked.append(queries.count()) or search(train, queries, *rest))
    rng = np.random.default_rng(12)
    arc = np.linspace(0, np.pi, 30)
    spots = np.r_[np.c_[np.cos(arc), np.sin(arc)] * 2.5, [[0.0, 0.0], [6.0, 0.0], [6.6, 0.5]]]
    x = np.r_[np.repeat(spots, 6, axis=0) + rng.normal(size=(198, 2)) * 0.02, [[4.0, 4.0], [6.0, 1.0]]]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= 0.8
    core, want, number = d.sum(1) >= 5, np.full(200, -1), 0
    for i in range(200):
        if core[i] and want[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if core[j] and want[j] < 0:
                    want[j] = number
                    todo += np.flatnonzero(d[j]).tolist()
            number += 1
    for i in np.flatnonzero(~core):
        near = d[i] & core
        want[i] = want[near].min() if near.any() else -1
    df = table(spark, [(i, *map(float, v)) for i, v in enumerate(x)] + [(900, math.nan, 0.0), (901, None, 0.0), (902, math.inf, 0.0)], "id long, a double, b double")
    out = cluster.DBSCAN(features=["a", "b"], row_id="id", eps=0.8, min_samples=5).fit_transform(df)
    found = {r.id: r.cluster for r in out.collect()}
    assert [found[i] for i in range(200)] == want.tolist() and number > 2
    assert [found[i] for i in (900, 901, 902)] == [-1] * 3
    assert len(asked) == 2 and max(asked) < 60
