import pytest

from loomstat.queries import ORACLE_SQL, QUERIES

from oracle import SF, same

SLOW = {"logistic_regression", "linear_svc", "gradient_boosting", "hist_gradient_boosting", "random_forest", "bagging", "kmeans", "sgd_classifier"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
