"""Column classes by type, column roles by name, and load-time normalisation."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def name(column: str) -> Column:
    """Reference a column by its literal name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, or a longer name if there is a column of that name."""
    while wanted in columns:
        wanted += "_"
    return wanted


def _of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.NumericType)


def string_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.StringType)


def temporal_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.TimestampType, T.TimestampNTZType, T.DateType)


def atomic_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be compared and cast to text."""
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]


def type_of(df: DataFrame, column: str) -> T.DataType:
    """The column's type; raises on an unknown column with the names that exist."""
    for f in df.schema.fields:
        if f.name == column:
            return f.dataType
    raise ValueError(f"column {column!r} not found; available: {df.columns}")


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def columns_named(names: Iterable[str], words: Iterable[str], match: str = "substring") -> list[str]:
    """Names holding one of ``words``: anywhere, or as a whole word with ``match='word'``."""
    words = [w.lower() for w in words]
    if match == "word":
        def hit(n):
            return not set(words).isdisjoint(re.split(r"[^a-z0-9]+", n.lower()))
    else:
        def hit(n):
            return any(w in n.lower() for w in words)
    return [n for n in names if hit(n)]


def snake_name(column: str) -> str:
    return re.sub(r"\W+", "_", column).strip("_").lower()


def normalise(df: DataFrame) -> DataFrame:
    """Turn float NaN into NULL, so that one test covers every missing value."""
    floats = _of_type(df, T.FloatType, T.DoubleType)
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(name(c)), name(c)) for c in floats})
