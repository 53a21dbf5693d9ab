"""Tables from files and memory, column selection, roles and missing-value policies."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.base import NUMERIC
from loomstat.errors import DuplicateColumn, EmptyInput, InvalidParameter, NullValueInColumn, SchemaMismatch, UnknownColumn, UnsupportedColumnType

FORMATS = ("parquet", "csv", "json", "ndjson", "arrow_file", "arrow_stream", "npy", "raw")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | T.StructType | None = None, header: bool = True, delimiter: str = ",", descriptor: dict | None = None) -> DataFrame:
    """A table from files of one format. JSON and CSV take a schema; without one it is inferred by a pass over the data."""
    if format not in FORMATS:
        raise InvalidParameter(f"format {format}")
    r = spark.read.schema(schema) if schema is not None else spark.read
    if format == "parquet":
        return r.parquet(path)
    if format == "csv":
        return r.csv(path, header=header, sep=delimiter, inferSchema=schema is None)
    if format in ("json", "ndjson"):
        return r.json(path, multiLine=format == "json")
    files = spark.read.format("binaryFile").load(path)
    if format.startswith("arrow"):
        return _arrow(spark, files, format)
    return _array(spark, files, format, descriptor)


def _spark_schema(schema: pa.Schema) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _open(data: bytes, format: str):
    return pa.ipc.open_file(data) if format == "arrow_file" else pa.ipc.open_stream(data)


def _first(spark: SparkSession, files: DataFrame) -> bytes:
    """The content of the file with the smallest path; the others' are not read for it."""
    path = files.agg(F.min("path")).first()[0]
    if path is None:
        raise EmptyInput("no file")
    return spark.read.format("binaryFile").load(path).first().content


def _arrow(spark: SparkSession, files: DataFrame, format: str) -> DataFrame:
    """Each file is decoded where it is read, batch by batch; the schema is that of the first file."""
    schema = _open(_first(spark, files), format).schema

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                opened = _open(data.as_buffer(), format)
                if opened.schema.names != schema.names:
                    raise SchemaMismatch(f"{opened.schema.names} against {schema.names}")
                yield from ((opened.get_batch(i) for i in range(opened.num_record_batches)) if format == "arrow_file" else opened)

    return files.select("content").mapInArrow(run, _spark_schema(schema))


_KINDS = {"f32": "<f4", "f64": "<f8", "i64": "<i8"}


def _array(spark: SparkSession, files: DataFrame, format: str, descriptor: dict | None) -> DataFrame:
    """Two-dimensional arrays as columns x0, x1, …: NumPy files in C order, or raw little-endian values with a descriptor (kind, columns)."""
    if format == "raw" and (not descriptor or descriptor.get("kind") not in _KINDS or descriptor.get("columns", 0) < 1):
        raise InvalidParameter("raw files need a descriptor with kind f32, f64 or i64 and columns")

    def matrix(data: bytes) -> np.ndarray:
        if format == "raw":
            return np.frombuffer(data, _KINDS[descriptor["kind"]]).reshape(-1, descriptor["columns"])
        import io

        m = np.load(io.BytesIO(data), allow_pickle=False)
        if m.dtype.str not in _KINDS.values() or not m.flags.c_contiguous:
            raise UnsupportedColumnType(f"{m.dtype.str}; C order of f4, f8 or i8")
        return m.reshape(len(m), -1)

    head = matrix(_first(spark, files))
    kind = "bigint" if head.dtype.kind == "i" else "double"
    width = head.shape[1]

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                m = matrix(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(m[:, i], pa.int64() if kind == "bigint" else pa.float64()) for i in range(width)], names=[f"x{i}" for i in range(width)])

    return files.select("content").mapInArrow(run, ", ".join(f"x{i} {kind}" for i in range(width)))


def read_descriptor(text: str) -> dict:
    """The JSON that stands beside a raw file."""
    d = json.loads(text)
    if d.get("endian", "little") != "little":
        raise InvalidParameter("little-endian files only")
    return {"kind": d["kind"], "columns": int(d["columns"])}


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def select(df: DataFrame, features: list, target: str | int | None = None) -> DataFrame:
    """Columns by name or position, in the order given; one target at most, last."""
    wanted = [*features, *([] if target is None else [target])]
    names = []
    for w in wanted:
        if isinstance(w, int):
            if not 0 <= w < len(df.columns):
                raise UnknownColumn(str(w))
            w = df.columns[w]
        if w not in df.columns:
            raise UnknownColumn(w)
        if w in names:
            raise DuplicateColumn(w)
        names.append(w)
    if not features:
        raise EmptyInput("no feature is selected")
    return df.select(*names)


def kinds(df: DataFrame) -> dict[str, str]:
    """numeric, boolean, categorical or vector for each column; other types are refused."""
    out = {}
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.BooleanType):
            out[f.name] = "boolean"
        elif isinstance(t, NUMERIC):
            out[f.name] = "numeric"
        elif isinstance(t, T.StringType):
            out[f.name] = "categorical"
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, NUMERIC):
            out[f.name] = "vector"
        else:
            hint = {T.TimestampType: "convert it to a numeric epoch", T.DateType: "convert it to a numeric epoch", T.DecimalType: "cast it to double"}.get(type(t), "flatten or drop it")
            raise UnsupportedColumnType(f"{f.name}: {t.simpleString()}; {hint}")
    return out


def missing(df: DataFrame, policy: str = "reject", fill: float | str | None = None) -> DataFrame:
    """reject, nan (numeric nulls become NaN), code (null categories become a label of their own) or fill (a finite constant)."""
    k = kinds(df)
    numeric = [c for c, x in k.items() if x in ("numeric", "boolean")]
    text = [c for c, x in k.items() if x == "categorical"]
    if policy == "reject":
        row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in k]).first()
        for c in k:
            if row[c]:
                raise NullValueInColumn(f"{c}: {row[c]}")
        return df
    if policy == "nan":
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric})
    if policy == "code":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit("<missing>" if fill is None else str(fill))) for c in text})
    if policy == "fill":
        if not isinstance(fill, (int, float)) or not np.isfinite(fill):
            raise InvalidParameter("fill is a finite number")
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill))) for c in numeric})
    raise InvalidParameter(f"policy {policy}")
