"""Queries of the analytics operators over the driver's tables, and the same in DuckDB's SQL where SQL can say it.

Floating results are rounded on both sides, as sums in another order differ in their last digits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import blocks as B
from loomstat.functions import sparse as S
from loomstat.functions import vectors as V
from loomstat.operators import cluster, decomposition, ensemble, impute, linear, metrics, model_selection, neighbors, outlier, preprocessing, svm, tree
from loomstat.plans.pipeline import FeatureUnion, Graph, Pipeline
from loomstat.sources import readers
from loomstat.streaming.incremental import windowed_counts

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0
    return df.select(*[(F.round(F.col(n), digits) + 0.0).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


# --- preprocessing ---


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS c_acctbal_scaled FROM customer")
def standard_scaler(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(preprocessing.StandardScaler(features=["c_acctbal"]).fit(df).transform(df).drop("c_acctbal"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS c_acctbal_scaled FROM customer")
def standard_scaler_incremental(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    model = preprocessing.StandardScaler(features=["c_acctbal"]).fit(df.where("c_custkey % 3 = 0")).update(df.where("c_custkey % 3 <> 0"))
    return rounded(model.transform(df).drop("c_acctbal"))


@query("SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) * 2 - 1, 6) + 0.0 AS o_totalprice_scaled FROM orders")
def minmax_scaler(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(preprocessing.MinMaxScaler(features=["o_totalprice"], low=-1.0, high=1.0).fit(df).transform(df).drop("o_totalprice"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.5) m, quantile_cont(c_acctbal, 0.75) b FROM customer)
SELECT c_custkey, round((c_acctbal - m) / (b - a), 6) + 0.0 AS c_acctbal_scaled FROM customer, q""")
def robust_scaler(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(preprocessing.RobustScaler(features=["c_acctbal"]).fit(df).transform(df).drop("c_acctbal"))


@query("""WITH c AS (SELECT o_orderpriority p, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) - 1 i FROM orders GROUP BY 1)
SELECT o_orderkey, """ + ", ".join(f"CASE WHEN i = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderpriority_{k}" for k in range(5)) + " FROM orders JOIN c ON p = o_orderpriority")
def one_hot_encoder(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return preprocessing.OneHotEncoder(features=["o_orderpriority"], row_id="o_orderkey").fit(df).transform(df).drop("o_orderpriority")


@query("""SELECT p_partkey, 1.0::DOUBLE AS poly_0, p_size::DOUBLE AS poly_1, p_retailprice AS poly_2, (p_size * p_size)::DOUBLE AS poly_3, round(p_size * p_retailprice, 6) AS poly_4, round(p_retailprice * p_retailprice, 6) AS poly_5 FROM part""")
def polynomial_features(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(preprocessing.PolynomialFeatures(features=["p_size", "p_retailprice"]).transform(df).drop("p_size", "p_retailprice"))


@query("""SELECT row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS idx, o_orderpriority AS label FROM orders GROUP BY o_orderpriority""")
def label_table(spark, d):
    found = preprocessing.label_table(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")
    return spark.createDataFrame([(i, v) for i, v in enumerate(found)], "idx long, label string")


@query("""WITH c AS (SELECT o_orderpriority p, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) - 1 i FROM orders GROUP BY 1)
SELECT o_orderkey, 5 AS size, i::INT AS first_index, 1.0::DOUBLE AS total FROM orders JOIN c ON p = o_orderpriority""")
def one_hot_encoder_sparse(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rows = preprocessing.OneHotEncoder(features=["o_orderpriority"], row_id="o_orderkey", sparse_output="x").fit(df).transform(df)
    return rows.select("o_orderkey", "x.size", F.get("x.indices", F.lit(0)).alias("first_index"), F.aggregate("x.values", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: CASE WHEN abs(v) >= 0.1::DOUBLE THEN v ELSE 0.0::DOUBLE END) x FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, a.x, b.x y FROM e a JOIN e b ON a.vec_id % 20 = 0)
SELECT query_id, vec_id, round(list_inner_product(x, y), 5) + 0.0 AS dot, round(list_distance(x, y), 5) AS euclidean, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))), 5) AS manhattan, round(list_max(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))), 5) AS chebyshev FROM p""")
def sparse_distances(spark, d):
    """Vectors without their components under 0.1, as sparse rows; queries are the ids divisible by 20."""
    cut = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.abs(v) >= 0.1, v).otherwise(0.0))
    e = table(spark, d, "embeddings").select("vec_id", S.sparse(cut).alias("x"))
    return neighbors.pair_measures(e.where("vec_id % 20 = 0"), e, "vec_id", "x", {m: B.measure(m) for m in ("dot", "euclidean", "manhattan", "chebyshev")}, 5)


@query("SELECT l_suppkey AS \"row\", p_size AS \"column\", round(sum(l_quantity * p_retailprice), 2) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def sparse_product(spark, d):
    """Suppliers x parts (quantities) times parts x sizes (prices)."""
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("column"), F.col("l_quantity").alias("value"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").alias("column"), F.col("p_retailprice").alias("value"))
    return rounded(S.product(a, b), 2)


# --- imputation: every seventh balance is taken away ---


def _gaps(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).cast("double").alias("nat"))


_GAPS = "WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey::DOUBLE END AS nat FROM customer)"


def _imputer(strategy, **kw):
    def run(spark, d):
        df = _gaps(spark, d)
        return rounded(impute.SimpleImputer(features=["bal", "nat"], strategy=strategy, **kw).fit(df).transform(df).drop("bal", "nat"))

    return run


for _name, _strategy, _sql in (
    ("mean", "mean", "avg({0})"), ("median", "median", "quantile_cont({0}, 0.5)"), ("constant", "constant", "min(-1.0::DOUBLE)"),
):
    QUERIES[f"simple_imputer_{_name}"] = _imputer(_strategy, fill_value=-1.0)
    ORACLE_SQL[f"simple_imputer_{_name}"] = f"{_GAPS} SELECT c_custkey, round(coalesce(bal, (SELECT {_sql.format('bal')} FROM g)), 6) AS bal_imputed, round(coalesce(nat, (SELECT {_sql.format('nat')} FROM g)), 6) AS nat_imputed FROM g"

QUERIES["simple_imputer_most_frequent"] = _imputer("most_frequent", add_indicator=True)
ORACLE_SQL["simple_imputer_most_frequent"] = _GAPS + """ SELECT c_custkey, round(coalesce(bal, (SELECT bal FROM g WHERE bal IS NOT NULL GROUP BY bal ORDER BY count(*) DESC, bal LIMIT 1)), 6) AS bal_imputed,
coalesce(nat, (SELECT nat FROM g WHERE nat IS NOT NULL GROUP BY nat ORDER BY count(*) DESC, nat LIMIT 1)) AS nat_imputed, (bal IS NULL)::INT::DOUBLE AS bal_missing, (nat IS NULL)::INT::DOUBLE AS nat_missing FROM g"""


@query(_GAPS + " SELECT c_custkey, (bal IS NULL)::INT::DOUBLE AS bal_missing, (nat IS NULL)::INT::DOUBLE AS nat_missing FROM g")
def missing_indicator(spark, d):
    df = _gaps(spark, d)
    return impute.MissingIndicator(features=["bal", "nat"]).fit(df).transform(df).drop("bal", "nat")


_FILL = "(SELECT avg({0}) FROM (SELECT t.{0}, row_number() OVER (ORDER BY {1}, t.c_custkey) r FROM g t WHERE t.{0} IS NOT NULL AND {2}) WHERE r <= 5)"


@query("""WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 50 <> 0 THEN c_acctbal END AS bal, c_nationkey::DOUBLE AS nat FROM customer),
p AS (SELECT r.c_custkey, t.bal, row_number() OVER (PARTITION BY r.c_custkey ORDER BY abs(r.nat - t.nat) * sqrt(2.0), t.c_custkey) k FROM g r JOIN g t ON r.bal IS NULL AND t.bal IS NOT NULL),
f AS (SELECT c_custkey, avg(bal) AS v FROM p WHERE k <= 5 GROUP BY 1)
SELECT c_custkey, round(coalesce(bal, v), 6) AS bal_imputed, nat AS nat_imputed FROM g LEFT JOIN f USING (c_custkey)""")
def knn_imputer(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").cast("double").alias("nat"))
    return rounded(impute.KNNImputer(features=["bal", "nat"], row_id="c_custkey").fit_transform(df).select("c_custkey", "bal_imputed", "nat_imputed"))


# --- linear models ---


def _coefficients(spark, model) -> DataFrame:
    rows = [(n, round(c, 5) + 0.0) for n, c in zip(model.features, model.coef)] + [("intercept", round(model.intercept, 5) + 0.0)]
    return spark.createDataFrame(rows, "name string, value double")


_PART = "WITH s AS (SELECT count(*) n, avg(p_size) mx, avg(p_retailprice) my, var_pop(p_size) * count(*) sxx, covar_pop(p_retailprice, p_size) * count(*) sxy FROM part)"


@query("SELECT 'p_size' AS name, round(regr_slope(p_retailprice, p_size), 5) AS value FROM part UNION ALL SELECT 'intercept', round(regr_intercept(p_retailprice, p_size), 5) FROM part")
def linear_regression(spark, d):
    return _coefficients(spark, linear.LinearRegression(features=["p_size"], label="p_retailprice").fit(table(spark, d, "part")))


@query("""WITH s AS (SELECT var_pop(l_quantity) a, covar_pop(l_quantity, l_discount) b, var_pop(l_discount) c, covar_pop(l_extendedprice, l_quantity) p, covar_pop(l_extendedprice, l_discount) q, avg(l_quantity) mx, avg(l_discount) mz, avg(l_extendedprice) my FROM lineitem),
w AS (SELECT (p * c - q * b) / (a * c - b * b) u, (q * a - p * b) / (a * c - b * b) v, mx, mz, my FROM s)
SELECT 'l_quantity' AS name, round(u, 5) AS value FROM w UNION ALL SELECT 'l_discount', round(v, 5) FROM w UNION ALL SELECT 'intercept', round(my - u * mx - v * mz, 5) FROM w""")
def linear_regression_two(spark, d):
    return _coefficients(spark, linear.LinearRegression(features=["l_quantity", "l_discount"], label="l_extendedprice").fit(table(spark, d, "lineitem")))


@query("SELECT 'p_size' AS name, round(regr_slope(p_retailprice, p_size), 5) AS value FROM part UNION ALL SELECT 'intercept', round(regr_intercept(p_retailprice, p_size), 5) FROM part")
def linear_regression_incremental(spark, d):
    df, e = table(spark, d, "part"), linear.LinearRegression(features=["p_size"], label="p_retailprice")
    return _coefficients(spark, e.update(e.fit(df.where("p_partkey % 2 = 0")), df.where("p_partkey % 2 = 1")))


@query(_PART + " SELECT 'p_size' AS name, round(sxy / (sxx + 1000), 5) AS value FROM s UNION ALL SELECT 'intercept', round(my - mx * sxy / (sxx + 1000), 5) FROM s")
def ridge(spark, d):
    return _coefficients(spark, linear.Ridge(features=["p_size"], label="p_retailprice", alpha=1000.0).fit(table(spark, d, "part")))


@query(_PART + ", w AS (SELECT sign(sxy) * greatest(0, abs(sxy) - n * 2.0) / sxx AS b, mx, my FROM s) SELECT 'p_size' AS name, round(b, 5) + 0.0 AS value FROM w UNION ALL SELECT 'intercept', round(my - mx * b, 5) + 0.0 FROM w")
def lasso(spark, d):
    return _coefficients(spark, linear.Lasso(features=["p_size"], label="p_retailprice", alpha=2.0).fit(table(spark, d, "part")))


@query(_PART + ", w AS (SELECT sign(sxy) * greatest(0, abs(sxy) - n * 1.0) / (sxx + n * 1.0) AS b, mx, my FROM s) SELECT 'p_size' AS name, round(b, 5) + 0.0 AS value FROM w UNION ALL SELECT 'intercept', round(my - mx * b, 5) + 0.0 FROM w")
def elastic_net(spark, d):
    return _coefficients(spark, linear.ElasticNet(features=["p_size"], label="p_retailprice", alpha=2.0).fit(table(spark, d, "part")))


@query("SELECT l_returnflag AS label, round((SELECT count(*) FROM lineitem)::DOUBLE / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)), 6) AS weight FROM lineitem GROUP BY 1")
def class_weights(spark, d):
    w = linear.class_weights(table(spark, d, "lineitem"), "l_returnflag")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(w.items())], "label string, weight double")


def _classified(spark, d):
    """Customers with a made-up class of two scaled features."""
    x = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 10_000).alias("a"), (F.col("c_nationkey") / 25.0).alias("b"))
    return x.withColumn("y", (F.col("a") + F.col("b") > 0.9).cast("int"))


@query()
def logistic_regression(spark, d):
    df = _classified(spark, d)
    return linear.LogisticRegression(features=["a", "b"], label="y", c=1000.0, max_iter=30).fit(df).transform(df).select("c_custkey", "y", "prediction", "probability")


@query()
def sgd_classifier(spark, d):
    df = _classified(spark, d)
    return linear.SGDClassifier(features=["a", "b"], label="y", row_id="c_custkey", loss="log_loss", max_epochs=5).fit(df).transform(df).select("c_custkey", "y", "prediction")


@query()
def sgd_regressor(spark, d):
    df = _classified(spark, d)
    return linear.SGDRegressor(features=["b"], label="a", row_id="c_custkey", max_epochs=5).fit(df).transform(df).select("c_custkey", "a", "prediction")


@query()
def low_rank_adapter(spark, d):
    df = table(spark, d, "part").select((F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    base = linear.Ridge(features=["x"], label="y", alpha=1e6).fit(df)
    return _coefficients(spark, linear.LowRankAdapter(features=["x"], label="y", rank=1).fit(base, df))


@query()
def linear_svc(spark, d):
    df = _classified(spark, d)
    return svm.LinearSVC(features=["a", "b"], label="y", max_iter=20).fit(df).transform(df).select("c_custkey", "y", "prediction")


@query()
def svc(spark, d):
    df = _classified(spark, d)
    return svm.SVC(features=["a", "b"], label="y", row_id="c_custkey").fit(df).transform(df).select("c_custkey", "y", "prediction")


@query()
def svr(spark, d):
    df = _classified(spark, d)
    return svm.SVR(features=["a"], label="b", row_id="c_custkey").fit(df).transform(df).select("c_custkey", "b", "prediction")


# --- neighbours, distances, kernels ---

_E4 = ", ".join(f"embedding[{i}]::DOUBLE AS e{i}" for i in range(1, 5))
_D4 = "sqrt(" + " + ".join(f"(q.e{i} - t.e{i}) * (q.e{i} - t.e{i})" for i in range(1, 5)) + ")"


def _e4(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i - 1].cast("double").alias(f"e{i}") for i in range(1, 5)])


def _every(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


_FOUR = ["e1", "e2", "e3", "e4"]
_NEAR = f"WITH e AS (SELECT vec_id, label, {_E4} FROM embeddings), n AS (SELECT q.vec_id AS query_id, t.vec_id AS neighbor_id, t.label, {_D4} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D4}, t.vec_id) AS rank FROM e q, e t)"


@query(_NEAR + " SELECT query_id, rank::INT AS rank, neighbor_id, round(distance, 6) AS distance FROM n WHERE rank <= 5")
def k_nearest(spark, d):
    e = _e4(spark, d)
    return rounded(neighbors.k_nearest(e, e, _FOUR, "vec_id", "vec_id", 5))


@query(_NEAR + " SELECT query_id, neighbor_id, round(distance, 6) AS distance FROM n WHERE distance <= 0.1")
def radius_neighbors(spark, d):
    e = _e4(spark, d)
    return rounded(neighbors.radius_neighbors(e, e, _FOUR, "vec_id", "vec_id", 0.1))


@query(_NEAR + ", v AS (SELECT query_id, label, count(*) w FROM n WHERE rank <= 5 GROUP BY 1, 2) SELECT query_id AS vec_id, first(label ORDER BY w DESC, label)::INT AS prediction FROM v GROUP BY 1")
def knn_classifier(spark, d):
    e = _e4(spark, d)
    return neighbors.KNeighborsClassifier(features=_FOUR, label="label", row_id="vec_id").fit(e).transform(e.drop("label")).select("vec_id", "prediction")


@query(_NEAR + " SELECT query_id AS vec_id, round(avg(label), 6) AS prediction FROM n WHERE rank <= 5 GROUP BY 1")
def knn_regressor(spark, d):
    e = _e4(spark, d)
    return rounded(neighbors.KNeighborsRegressor(features=_FOUR, label="label", row_id="vec_id").fit(e).transform(e.drop("label")).select("vec_id", "prediction"))


_STATED = "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, a.embedding::DOUBLE[] x, b.embedding::DOUBLE[] y FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0)"


@query(_STATED + """ SELECT query_id, vec_id, round(list_distance(x, y), 5) AS euclidean, round(list_distance(x, y) ^ 2, 5) AS squared_euclidean, round(1 - list_cosine_similarity(x, y), 5) + 0.0 AS cosine,
round(list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))), 5) AS manhattan, round(list_max(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))), 5) AS chebyshev FROM p""")
def pairwise_distances(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return neighbors.pair_measures(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", {m: B.measure(m) for m in ("euclidean", "squared_euclidean", "cosine", "manhattan", "chebyshev")}, 5)


@query(_STATED + """ SELECT query_id, vec_id, round(list_inner_product(x, y), 5) + 0.0 AS linear, round((0.5 * list_inner_product(x, y) + 1) ^ 3, 5) + 0.0 AS polynomial, round(exp(-0.5 * list_distance(x, y) ^ 2), 5) AS rbf, round(tanh(0.5 * list_inner_product(x, y) + 1), 5) + 0.0 AS sigmoid FROM p""")
def kernels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return neighbors.pair_measures(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", {k: B.measure(k, gamma=0.5, coef0=1.0) for k in ("linear", "polynomial", "rbf", "sigmoid")}, 5)


@query("WITH c AS (SELECT unnest([l_quantity, l_extendedprice]) x FROM lineitem) SELECT round(1 / (2 * var_pop(x)), 15) AS gamma FROM c")
def gamma_scale(spark, d):
    return spark.createDataFrame([(round(V.gamma_scale(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 15),)], "gamma double")


@query("SELECT 'l_quantity' AS a, 'l_quantity' AS b, round(sum(l_quantity * l_quantity), 2) AS value FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(sum(l_quantity * l_discount), 2) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', round(sum(l_discount * l_discount), 2) FROM lineitem")
def gram_matrix(spark, d):
    names = ["l_quantity", "l_discount"]
    g = V.gram(table(spark, d, "lineitem"), names)["xx"]
    return spark.createDataFrame([(names[i], names[j], round(float(g[i, j]), 2)) for i in range(2) for j in range(i, 2)], "a string, b string, value double")


# --- trees and ensembles ---


_STUMP = """WITH v AS (SELECT p_size v, count(*) n, sum(p_retailprice) y FROM part GROUP BY 1),
c AS (SELECT v, sum(n) OVER (ORDER BY v) ln, sum(y) OVER (ORDER BY v) ly, sum(n) OVER () tn, sum(y) OVER () ty, lead(v) OVER (ORDER BY v) nx FROM v),
b AS (SELECT v + (nx - v) / 2.0 AS cut, ly / ln AS l, (ty - ly) / (tn - ln) AS r FROM c WHERE nx IS NOT NULL ORDER BY round(ly * ly / ln + (ty - ly) * (ty - ly) / (tn - ln) - ty * ty / tn, 6) DESC, v LIMIT 1)"""


@query(_STUMP + " SELECT p_partkey, round(CASE WHEN p_size <= cut THEN l ELSE r END, 6) AS prediction FROM part, b")
def decision_tree_regressor(spark, d):
    df = table(spark, d, "part")
    return rounded(tree.DecisionTreeRegressor(features=["p_size"], label="p_retailprice", max_depth=1).fit(df).transform(df).select("p_partkey", "prediction"))


@query()
def decision_tree_classifier(spark, d):
    df = _classified(spark, d)
    return tree.DecisionTreeClassifier(features=["a", "b"], label="y", max_depth=4).fit(df).transform(df).select("c_custkey", "y", "prediction")


@query(_STUMP + " SELECT p_partkey, round(CASE WHEN p_size <= cut THEN l ELSE r END, 6) AS prediction FROM part, b")
def random_forest_whole(spark, d):
    """Without bootstraps and with all features each tree is the same."""
    df = table(spark, d, "part")
    f = ensemble.RandomForestRegressor(features=["p_size"], label="p_retailprice", row_id="p_partkey", trees=2, max_depth=1, max_features="all", bootstrap=False, max_bins=None)
    return rounded(f.fit(df).transform(df).select("p_partkey", "prediction"))


@query(_STUMP + " SELECT p_partkey, round(m + 0.1 * (CASE WHEN p_size <= cut THEN l ELSE r END - m), 6) AS prediction FROM part, b, (SELECT avg(p_retailprice) m FROM part)")
def gradient_boosting_stage(spark, d):
    df = table(spark, d, "part")
    return rounded(ensemble.GradientBoosting(features=["p_size"], label="p_retailprice", row_id="p_partkey", stages=1, max_depth=1).fit(df).transform(df).select("p_partkey", "prediction"))


@query("""WITH t AS (SELECT c_custkey, c_acctbal / 10000 AS a, (c_acctbal / 10000 + c_nationkey / 25.0::DOUBLE > 0.9::DOUBLE)::INT AS y FROM customer),
v AS (SELECT a v, count(*) n, sum(y) y FROM t GROUP BY 1),
c AS (SELECT v, sum(n) OVER w ln, sum(y) OVER w ly, sum(n) OVER () tn, sum(y) OVER () ty, lead(v) OVER (ORDER BY v) nx FROM v WINDOW w AS (ORDER BY v)),
b AS (SELECT v + (nx - v) / 2 AS cut, 2 * ly > ln AS l, 2 * (ty - ly) > tn - ln AS r FROM c WHERE nx IS NOT NULL
ORDER BY round((ly * ly + (ln - ly) * (ln - ly)) / ln + ((ty - ly) * (ty - ly) + (tn - ln - ty + ly) * (tn - ln - ty + ly)) / (tn - ln), 9) DESC, v LIMIT 1)
SELECT c_custkey, y, (CASE WHEN a <= cut THEN l ELSE r END)::INT AS prediction FROM t, b""")
def decision_stump_classifier(spark, d):
    df = _classified(spark, d)
    return tree.DecisionTreeClassifier(features=["a"], label="y", max_depth=1).fit(df).transform(df).select("c_custkey", "y", "prediction")


@query()
def random_forest(spark, d):
    df = _classified(spark, d)
    return ensemble.RandomForestClassifier(features=["a", "b"], label="y", row_id="c_custkey", trees=3, max_depth=3).fit(df).transform(df).select("c_custkey", "y", "prediction")


@query()
def bagging(spark, d):
    df = _classified(spark, d)
    base = tree.DecisionTreeRegressor(features=["b"], label="a", max_depth=2)
    return ensemble.Bagging(estimator=base, row_id="c_custkey", members=3).fit(df).transform(df).select("c_custkey", "prediction")


@query()
def gradient_boosting(spark, d):
    df = _classified(spark, d)
    return ensemble.GradientBoosting(features=["a", "b"], label="y", row_id="c_custkey", loss="log_loss", stages=3).fit(df).transform(df).select("c_custkey", "y", "prediction")


@query()
def gradient_boosting_stopped(spark, d):
    df = _classified(spark, d)
    m = ensemble.GradientBoosting(features=["a", "b"], label="y", row_id="c_custkey", loss="log_loss", stages=8, rate=0.5, max_depth=1, patience=2, tol=0.02, probability="probability").fit(df)
    return m.transform(df).select("c_custkey", "y", "prediction", "probability")


@query()
def hist_gradient_boosting(spark, d):
    df = _classified(spark, d)
    return ensemble.HistGradientBoosting(features=["a", "b"], label="y", row_id="c_custkey", loss="log_loss", stages=2, max_leaves=4).fit(df).transform(df).select("c_custkey", "y", "prediction")


@query()
def isolation_forest(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return outlier.IsolationForest(features=["value"], row_id="event_id", contamination=0.05).fit(df).transform(df).select("event_id", "score", "outlier")


# --- clustering and decomposition ---


@query("""WITH c AS (SELECT CASE WHEN abs(c_acctbal) <= abs(c_acctbal - 4000) AND abs(c_acctbal) <= abs(c_acctbal - 8000) THEN 0 WHEN abs(c_acctbal - 4000) <= abs(c_acctbal - 8000) THEN 1 ELSE 2 END AS k, c_acctbal FROM customer),
m AS (SELECT max(CASE WHEN k = 0 THEN a END) m0, max(CASE WHEN k = 1 THEN a END) m1, max(CASE WHEN k = 2 THEN a END) m2 FROM (SELECT k, avg(c_acctbal) a FROM c GROUP BY k))
SELECT c_custkey, (CASE WHEN abs(c_acctbal - m0) <= abs(c_acctbal - m1) AND abs(c_acctbal - m0) <= abs(c_acctbal - m2) THEN 0 WHEN abs(c_acctbal - m1) <= abs(c_acctbal - m2) THEN 1 ELSE 2 END)::INT AS cluster FROM customer, m""")
def kmeans_round(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cluster.KMeans(features=["c_acctbal"], k=3, init=[[0.0], [4000.0], [8000.0]], max_iter=1).fit(df).transform(df).select("c_custkey", "cluster")


@query()
def kmeans(spark, d):
    df = _every(spark, d)
    return cluster.KMeans(features=df.columns[1:], k=4, row_id="vec_id", max_iter=10).fit(df).transform(df).select("vec_id", "cluster")


@query()
def minibatch_kmeans(spark, d):
    df = _every(spark, d)
    return cluster.MiniBatchKMeans(features=df.columns[1:], k=4, row_id="vec_id", batch_size=256, n_init=1).fit(df).transform(df).select("vec_id", "cluster")


@query("""WITH n AS (SELECT c_custkey, c_acctbal v, count(*) OVER (ORDER BY c_acctbal RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) k FROM customer),
c AS (SELECT *, CASE WHEN v - lag(v) OVER (ORDER BY v, c_custkey) <= 5 THEN 0 ELSE 1 END g FROM n WHERE k >= 5),
i AS (SELECT *, sum(g) OVER (ORDER BY v, c_custkey) s FROM c), f AS (SELECT *, min(c_custkey) OVER (PARTITION BY s) seed FROM i),
l AS (SELECT c_custkey, v, dense_rank() OVER (ORDER BY seed) - 1 AS cl FROM f),
b AS (SELECT n.c_custkey, min(l.cl) cl FROM n JOIN l ON abs(n.v - l.v) <= 5 WHERE n.k < 5 GROUP BY 1)
SELECT c_custkey, coalesce(l.cl, b.cl, -1)::INT AS cluster FROM n LEFT JOIN l USING (c_custkey) LEFT JOIN b USING (c_custkey)""")
def dbscan(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cluster.DBSCAN(features=["c_acctbal"], row_id="c_custkey", eps=5.0, min_samples=5).fit_transform(df).select("c_custkey", "cluster")


_COV = "WITH s AS (SELECT var_samp(l_quantity) a, covar_samp(l_quantity, l_tax * 100) b, var_samp(l_tax * 100) c FROM lineitem), e AS (SELECT (a + c) / 2 m, sqrt(((a - c) / 2) ^ 2 + b * b) r FROM s)"
_PCA_SQL = _COV + " SELECT 0 AS component, round(m + r, 6) AS variance, round((m + r) / (2 * m), 6) AS ratio FROM e UNION ALL SELECT 1, round(m - r, 6), round((m - r) / (2 * m), 6) FROM e"


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", (F.col("l_tax") * 100).alias("tax"), "l_linenumber")


def _variances(spark, m):
    return spark.createDataFrame([(i, round(v, 6), round(r, 6)) for i, (v, r) in enumerate(zip(m.variance, m.ratio))], "component int, variance double, ratio double")


@query(_PCA_SQL)
def pca(spark, d):
    return _variances(spark, decomposition.PCA(features=["l_quantity", "tax"]).fit(_lines(spark, d)))


@query(_PCA_SQL)
def incremental_pca(spark, d):
    e, df = decomposition.IncrementalPCA(features=["l_quantity", "tax"]), _lines(spark, d)
    return _variances(spark, e.update(e.fit(df.where("l_linenumber <= 3")), df.where("l_linenumber > 3")))


@query("""WITH s AS (SELECT sum(l_quantity * l_quantity) a, sum(l_quantity * l_tax * 100) b, sum(l_tax * l_tax * 10000) c FROM lineitem), e AS (SELECT (a + c) / 2 m, sqrt(((a - c) / 2) ^ 2 + b * b) r FROM s)
SELECT 0 AS component, round(sqrt(m + r), 4) AS singular FROM e UNION ALL SELECT 1, round(sqrt(m - r), 4) FROM e""")
def truncated_svd(spark, d):
    m = decomposition.TruncatedSVD(features=["l_quantity", "tax"]).fit(_lines(spark, d))
    return spark.createDataFrame([(i, round(v, 4)) for i, v in enumerate(m.singular)], "component int, singular double")


# --- metrics ---

_LP = "WITH t AS (SELECT l_returnflag y, CASE WHEN l_quantity < 13 THEN 'A' WHEN l_quantity < 38 THEN 'N' ELSE 'R' END p FROM lineitem)"


def _lp(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(q < 13, "A").when(q < 38, "N").otherwise("R").alias("p"))


_PC = _LP + ", k AS (SELECT l, count(*) FILTER (y = l) s, count(*) FILTER (p = l) q, count(*) FILTER (y = l AND p = l) h FROM t, (SELECT DISTINCT y l FROM t UNION SELECT DISTINCT p FROM t) GROUP BY l), m AS (SELECT l, s, q, h, CASE WHEN q > 0 THEN h / q ELSE 0.0 END pr, CASE WHEN s > 0 THEN h / s ELSE 0.0 END re, CASE WHEN s + q > 0 THEN 2 * h / (s + q) ELSE 0.0 END f FROM k)"


@query(_LP + " SELECT round(avg((y = p)::INT), 6) AS accuracy FROM t")
def metric_accuracy(spark, d):
    return rounded(metrics.accuracy(_lp(spark, d), "y", "p"))


@query(_LP + ", l AS (SELECT DISTINCT y l FROM t UNION SELECT DISTINCT p FROM t), c AS (SELECT y, p, count(*) n FROM t GROUP BY 1, 2) SELECT a.l AS label, b.l AS prediction, coalesce(n, 0)::BIGINT AS n FROM l a, l b LEFT JOIN c ON c.y = a.l AND c.p = b.l")
def metric_confusion_matrix(spark, d):
    return metrics.confusion_matrix(_lp(spark, d), "y", "p")


@query(_PC + " SELECT l AS label, s AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM m")
def metric_per_class(spark, d):
    return rounded(metrics.per_class(_lp(spark, d), "y", "p").drop("predicted", "hit"))


@query(_PC + """ SELECT 'macro' AS average, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f), 6) AS f1 FROM m
UNION ALL SELECT 'weighted', round(sum(pr * s) / sum(s), 6), round(sum(re * s) / sum(s), 6), round(sum(f * s) / sum(s), 6) FROM m UNION ALL SELECT 'micro', round(sum(h) / sum(s), 6), round(sum(h) / sum(s), 6), round(sum(h) / sum(s), 6) FROM m""")
def metric_precision_recall_f1(spark, d):
    df, out = _lp(spark, d), None
    for a in ("macro", "weighted", "micro"):
        one = metrics.precision_recall_f1(df, "y", "p", a).withColumn("average", F.lit(a))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(_PC + " SELECT round(avg(re), 6) AS balanced_accuracy FROM m WHERE s > 0")
def metric_balanced_accuracy(spark, d):
    return rounded(metrics.balanced_accuracy(_lp(spark, d), "y", "p"))


@query(_PC + ", z AS (SELECT sum(h)::DOUBLE h, sum(s)::DOUBLE s, sum(s::DOUBLE * q) tp, sum(s::DOUBLE * s) tt, sum(q::DOUBLE * q) pp FROM m) SELECT round((h * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc FROM z")
def metric_matthews(spark, d):
    return rounded(metrics.matthews(_lp(spark, d), "y", "p"))


@query("""WITH t AS (SELECT l_extendedprice y, l_quantity * 1000.0 p FROM lineitem)
SELECT round(avg((y - p) ^ 2), 2) AS mse, round(sqrt(avg((y - p) ^ 2)), 2) AS rmse, round(avg(abs(y - p)), 2) AS mae, round(1 - avg((y - p) ^ 2) / var_pop(y), 2) AS r2 FROM t""")
def metric_regression(spark, d):
    return rounded(metrics.regression(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000.0).alias("p")), "y", "p"), 2)


_SC = "WITH t AS (SELECT (l_linestatus = 'O')::INT y, l_discount s FROM lineitem), c AS (SELECT s, sum(y) p, sum(1 - y) n FROM t GROUP BY s), u AS (SELECT s, p, n, sum(p) OVER w tp, sum(n) OVER w fp, sum(p) OVER () tot, sum(n) OVER () neg FROM c WINDOW w AS (ORDER BY s DESC))"


def _sc(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("y"), F.col("l_discount").alias("s"))


@query(_SC + " SELECT s AS threshold, round(fp / neg, 6) AS fpr, round(tp / tot, 6) AS tpr FROM u")
def metric_roc_curve(spark, d):
    return rounded(metrics.roc_curve(_sc(spark, d), "y", "s"))


@query(_SC + " SELECT round(sum(p::DOUBLE * (neg - fp + n / 2.0)) / first(tot::DOUBLE * neg), 6) AS auc FROM u")
def metric_auc(spark, d):
    return rounded(metrics.auc(_sc(spark, d), "y", "s"))


@query(_SC + " SELECT s AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / tot, 6) AS recall FROM u")
def metric_precision_recall_curve(spark, d):
    return rounded(metrics.precision_recall_curve(_sc(spark, d), "y", "s"))


@query(_SC + " SELECT round(sum(p / tot * tp / (tp + fp)), 6) AS average_precision FROM u")
def metric_average_precision(spark, d):
    return rounded(metrics.average_precision(_sc(spark, d), "y", "s"))


@query("WITH t AS (SELECT (l_linestatus = 'O')::INT y, l_quantity / 51 p FROM lineitem) SELECT round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM t")
def metric_log_loss(spark, d):
    return rounded(metrics.log_loss(table(spark, d, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_quantity") / 51).alias("p")), "y", "p"))


_SIL = f"WITH e AS (SELECT vec_id, label, {_E4} FROM embeddings), m AS (SELECT q.vec_id, q.label c, t.label o, avg({_D4}) a FROM e q JOIN e t ON q.vec_id <> t.vec_id GROUP BY 1, 2, 3), s AS (SELECT vec_id, c, max(a) FILTER (c = o) a, min(a) FILTER (c <> o) b FROM m GROUP BY 1, 2)"


@query(_SIL + " SELECT vec_id, c AS cluster, round(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM s")
def metric_silhouette(spark, d):
    return rounded(metrics.silhouette_samples(_e4(spark, d), _FOUR, "label", "vec_id"))


@query(f"""WITH e AS (SELECT vec_id, label, {_E4} FROM embeddings), g AS (SELECT avg(e1) a1, avg(e2) a2, count(*) n, count(DISTINCT label) k FROM e), c AS (SELECT label, count(*) m, avg(e1) b1, avg(e2) b2, (var_pop(e1) + var_pop(e2)) * count(*) w FROM e GROUP BY 1)
SELECT round(sum(m * ((b1 - a1) ^ 2 + (b2 - a2) ^ 2)) / (first(k) - 1) / (sum(w) / (first(n) - first(k))), 6) AS calinski_harabasz FROM c, g""")
def metric_calinski_harabasz(spark, d):
    return rounded(metrics.calinski_harabasz(_e4(spark, d), ["e1", "e2"], "label"))


@query(f"""WITH e AS (SELECT vec_id, label, {_E4} FROM embeddings), c AS (SELECT label, avg(e1) b1, avg(e2) b2 FROM e GROUP BY 1), s AS (SELECT label, b1, b2, avg(sqrt((e1 - b1) ^ 2 + (e2 - b2) ^ 2)) s FROM e JOIN c USING (label) GROUP BY 1, 2, 3)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT x.label, max((x.s + y.s) / sqrt((x.b1 - y.b1) ^ 2 + (x.b2 - y.b2) ^ 2)) r FROM s x JOIN s y ON x.label <> y.label GROUP BY 1)""")
def metric_davies_bouldin(spark, d):
    return rounded(metrics.davies_bouldin(_e4(spark, d), ["e1", "e2"], "label"))


_CT = _LP + ", c AS (SELECT y, p, count(*)::DOUBLE n, sum(count(*)) OVER (PARTITION BY y)::DOUBLE r, sum(count(*)) OVER (PARTITION BY p)::DOUBLE q, sum(count(*)) OVER ()::DOUBLE t FROM t GROUP BY 1, 2)"


@query(_CT + ", x AS (SELECT sum(n * (n - 1) / 2) i, (SELECT sum(r * (r - 1) / 2) FROM (SELECT DISTINCT y, r FROM c)) a, (SELECT sum(q * (q - 1) / 2) FROM (SELECT DISTINCT p, q FROM c)) b, first(t * (t - 1) / 2) z FROM c) SELECT round((i - a * b / z) / ((a + b) / 2 - a * b / z), 6) + 0.0 AS adjusted_rand FROM x")
def metric_adjusted_rand(spark, d):
    return rounded(metrics.adjusted_rand(_lp(spark, d), "y", "p"))


@query(_CT + ", x AS (SELECT sum(n / t * ln(n * t / (r * q))) mi, sum(-n / t * ln(r / t)) ha, sum(-n / t * ln(q / t)) hb FROM c) SELECT round(mi, 8) AS mutual_information, round(mi / ha, 8) AS homogeneity, round(mi / hb, 8) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 8) AS v_measure, round(2 * mi / (ha + hb), 8) AS nmi FROM x")
def metric_information(spark, d):
    return rounded(metrics.information(_lp(spark, d), "y", "p"), 8)


# --- splits and search ---


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 < ceil(count(*) OVER () * 0.25) AS is_test FROM orders")
def train_test_split(spark, d):
    return model_selection.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", shuffle=False)


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 < ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.25) AS is_test FROM orders")
def train_test_split_stratified(spark, d):
    return model_selection.train_test_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", shuffle=False, stratify="o_orderpriority").select("o_orderkey", "o_orderpriority", "is_test")


@query("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS fold FROM orders")
def k_fold(spark, d):
    return model_selection.k_fold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def stratified_k_fold(spark, d):
    return model_selection.stratified_k_fold(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority").select("o_orderkey", "fold")


@query("SELECT c_custkey, ((dense_rank() OVER (ORDER BY c_nationkey) - 1) % 4)::INT AS fold FROM customer")
def group_k_fold(spark, d):
    return model_selection.group_k_fold(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 4, shuffle=False).select("c_custkey", "fold")


@query()
def grid_search(spark, d):
    df = model_selection.k_fold(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 3)
    s = model_selection.GridSearch(linear.Ridge(features=["p_size"], label="p_retailprice"), model_selection.grid(alpha=[0.1, 1e6]), "r2", "p_retailprice").fit(df)
    return spark.createDataFrame([(float(r["params"]["alpha"]), r["mean"], i == s.best_index_) for i, r in enumerate(s.results_)], "alpha double, mean double, best boolean")


@query("WITH e AS (SELECT l_extendedprice y, l_quantity * 1500 - l_extendedprice e FROM lineitem) SELECT round(sqrt(avg(e * e)), 5) AS rmse, round(avg(abs(e)), 5) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 8) AS r2 FROM e")
def metric_state_regression(spark, d):
    """States of the parts of a table, merged."""
    df, state = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500), metrics.RegressionState()
    for k in range(2):
        state = state.merge(metrics.RegressionState().observe(df.where(F.col("l_linenumber") % 2 == k), "l_extendedprice", "p"))
    r = state.result()
    return spark.createDataFrame([(round(r["rmse"], 5), round(r["mae"], 5), round(r["r2"], 8))], "rmse double, mae double, r2 double")


@query(_LP + """, k AS (SELECT DISTINCT y FROM t UNION SELECT DISTINCT p FROM t),
c AS (SELECT k.y, count(*) FILTER (t.y = k.y) s, count(*) FILTER (t.p = k.y) q, count(*) FILTER (t.y = k.y AND t.p = k.y) h FROM t, k GROUP BY 1)
SELECT round((SELECT avg((y = p)::INT) FROM t), 6) AS accuracy, round(avg(CASE WHEN q > 0 THEN h / q ELSE 0 END), 6) AS precision, round(avg(CASE WHEN s > 0 THEN h / s ELSE 0 END), 6) AS recall, round(avg(CASE WHEN s + q > 0 THEN 2 * h / (s + q) ELSE 0 END), 6) AS f1 FROM c""")
def metric_state_classification(spark, d):
    p = F.when(F.col("l_quantity") < 13, "A").when(F.col("l_quantity") < 38, "N").otherwise("R")
    df, state = table(spark, d, "lineitem").select("l_linenumber", F.col("l_returnflag").alias("y"), p.alias("p")), metrics.ClassificationState()
    for k in range(2):
        state = state.observe(df.where(F.col("l_linenumber") % 2 == k), "y", "p")
    return spark.createDataFrame([tuple(round(state.result()[n], 6) for n in ("accuracy", "precision", "recall", "f1"))], "accuracy double, precision double, recall double, f1 double")


# --- plans, sources, streams ---


def _round_trip(format):
    def run(spark, d):
        """The table written in that format to the shared folder and read back."""
        df = table(spark, d, "customer")
        path = f"{cluster.shared_folder(spark)}/customer-{uuid.uuid4().hex}"
        df.write.format("json" if format == "ndjson" else format).options(**({"header": True, "sep": "|"} if format == "csv" else {})).save(path)
        return readers.read(spark, path, format, None if format == "parquet" else df.schema, delimiter="|")

    return run


for _format in ("parquet", "csv", "ndjson"):
    QUERIES[f"read_{_format}"] = _round_trip(_format)
    ORACLE_SQL[f"read_{_format}"] = "SELECT * FROM customer"


@query("""WITH s AS (SELECT *, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () z FROM customer) SELECT c_custkey, round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()), 6) AS z FROM s""")
def pipeline_of_scalers(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    p = Pipeline(preprocessing.StandardScaler(features=["c_acctbal"]), preprocessing.MinMaxScaler(features=["c_acctbal_scaled"], suffix="_unit"))
    return rounded(p.fit(df).transform(df).select("c_custkey", F.col("c_acctbal_scaled_unit").alias("z")))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS c_acctbal_s, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal_m FROM customer")
def feature_union(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    u = FeatureUnion(preprocessing.StandardScaler(features=["c_acctbal"], suffix="_s"), preprocessing.MinMaxScaler(features=["c_acctbal"], suffix="_m"))
    return rounded(u.fit(df).transform(df).drop("c_acctbal"))


@query("""WITH s AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () a, c_nationkey / 24.0 b FROM customer) SELECT c_custkey, round(a * b, 6) + 0.0 AS product FROM s""")
def stage_graph(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    g = Graph().add("z", preprocessing.StandardScaler(features=["c_acctbal"])).add("unit", preprocessing.MinMaxScaler(features=["c_nationkey"]))
    g.add("poly", preprocessing.PolynomialFeatures(features=["c_acctbal_scaled", "c_nationkey_scaled"], interaction_only=True, include_bias=False), "z", "unit")
    # PolynomialFeatures has no state of its own: its fit gives itself
    return rounded(g.fit(df).transform(df).select("c_custkey", F.col("poly_2").alias("product")))


@query("SELECT l_discount, l_tax, l_quantity FROM lineitem")
def column_selection(spark, d):
    return readers.select(table(spark, d, "lineitem"), ["l_discount", "l_tax"], "l_quantity")


@query(_GAPS + " SELECT c_custkey::DOUBLE AS c_custkey, coalesce(bal, 0.5) AS bal, coalesce(nat, 0.5) AS nat FROM g")
def missing_value_policy(spark, d):
    return readers.missing(_gaps(spark, d), "fill", 0.5)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type")
