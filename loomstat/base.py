"""Estimators, models and their saved form.

An estimator holds parameters; fit() returns a model, whose state is plain Python
(numbers, strings, lists), so that it can be written as JSON and its transform can be
column expressions."""

from __future__ import annotations

import importlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.errors import DuplicateColumn, EmptyInput, InvalidParameter, NonFiniteValue, SchemaMismatch, UnknownColumn, UnsupportedColumnType

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)


class Params:
    """Keyword parameters with defaults; unknown ones are refused."""

    defaults: dict = {}

    def __init__(self, **params):
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise InvalidParameter(f"{type(self).__name__} has no parameter {sorted(unknown)[0]}")
        for name, value in {**self.defaults, **params}.items():
            setattr(self, name, value)
        self.check()

    def check(self) -> None:
        pass

    def params(self) -> dict:
        return {name: getattr(self, name) for name in self.defaults}

    def copy(self, **changes):
        return type(self)(**{**self.params(), **changes})


class Model:
    """A fitted state, a dict of plain values."""

    def __init__(self, **state):
        self.__dict__.update(state)

    def state(self) -> dict:
        return dict(self.__dict__)

    def save(self, path: str) -> None:
        """Write the state as JSON to a folder that Spark's file systems or the local one reach."""
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        spark.createDataFrame([(type(self).__module__, type(self).__name__, json.dumps(self.state()))], "module string, name string, state string").coalesce(1).write.mode("overwrite").json(path)


def load(path: str) -> Model:
    from pyspark.sql import SparkSession

    row = SparkSession.active().read.schema("module string, name string, state string").json(path).first()
    if row is None or not row.module.startswith("loomstat."):
        raise SchemaMismatch(f"{path} holds no model of this engine")
    kind = getattr(importlib.import_module(row.module), row.name)
    if not issubclass(kind, Model):
        raise SchemaMismatch(f"{row.name} is not a model")
    return kind(**json.loads(row.state))


def number(name: str | Column) -> Column:
    """A numeric column as double, NaN as null."""
    c = (F.col(name) if isinstance(name, str) else name).cast("double")
    return F.when(~F.isnan(c), c)


def check_features(df: DataFrame, names: list[str], numeric: bool = True) -> None:
    if not names:
        raise EmptyInput("no feature columns")
    if len(set(names)) != len(names):
        raise DuplicateColumn(f"a column is named twice: {names}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in names:
        if name not in kinds:
            raise UnknownColumn(name)
        if numeric and not isinstance(kinds[name], NUMERIC):
            raise UnsupportedColumnType(f"{name}: {kinds[name].simpleString()}; cast it to double or encode it first")


def finite_guard(names: list[str]) -> list[Column]:
    """Aggregates that count missing or non-finite values, to put in the fit's own aggregate."""
    bad = [F.sum(F.when(F.col(n).isNull() | F.isnan(F.col(n).cast("double")) | (F.abs(F.col(n).cast("double")) == math.inf), 1).otherwise(0)).alias(f"_bad_{i}") for i, n in enumerate(names)]
    return [F.count(F.lit(1)).alias("_rows"), *bad]


def check_guard(row, names: list[str]) -> None:
    if not row["_rows"]:
        raise EmptyInput("no rows")
    for i, n in enumerate(names):
        if row[f"_bad_{i}"]:
            raise NonFiniteValue(f"{n} has {row[f'_bad_{i}']} missing or non-finite values")


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    return df.withColumns(outputs)
