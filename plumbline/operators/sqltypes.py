"""SQL types sized by the data, primary-key detection and ``CREATE TABLE`` text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.functions.columns import columns_named, name, type_class, type_of
from plumbline.operators.metrics import per_column
from plumbline.operators.profile import distinct_counts
from plumbline.session import local_table

DIALECTS = ("postgresql", "mysql", "sqlserver")


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "integer"
    return "fraction" if type_class(dtype) == "numeric" else type_class(dtype)


def sql_types(df: DataFrame, dialect: str = "postgresql") -> DataFrame:
    """``(column, position, sql_type, nulls, rows)``; integers by their range, text by its longest value."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; known: {DIALECTS}")
    sizes = per_column(df, df.columns, {
        "largest": ("decimal(38,0)", lambda c, t: F.max(F.abs(c.cast("decimal(20,0)"))) if _kind(t) == "integer" else None),
        "longest": ("bigint", lambda c, t: F.max(F.length(c.cast("string"))) if _kind(t) == "string" else
                    F.max(F.length(F.to_json(F.struct(c)))) if _kind(t) == "other" and not isinstance(t, T.BinaryType) else None),
        "rows": ("bigint", lambda c, t: F.count(F.lit(1))),
        "nulls": ("bigint", lambda c, t: F.count_if(c.isNull()))})
    largest = F.coalesce("largest", F.lit(0))
    tiny = "SMALLINT" if dialect == "postgresql" else "TINYINT"
    integer = (F.when(largest <= 127, tiny).when(largest <= 32767, "SMALLINT")
               .when(largest <= 2147483647, "INT").otherwise("BIGINT"))
    padded = F.greatest(F.lit(50), F.floor(F.coalesce("longest", F.lit(50)) * 1.25))
    rounded = (F.ceil(padded / 50) * 50).cast("bigint")
    varchar = F.when(rounded > 4000, "NVARCHAR(MAX)" if dialect == "sqlserver" else "TEXT").otherwise(
        F.concat(F.lit("VARCHAR("), rounded.cast("string"), F.lit(")")))
    kind = _kinds(df)
    sql_type = (F.when(kind == "boolean", "BIT" if dialect == "sqlserver" else "BOOLEAN")
                .when(kind == "datetime", "DATETIME" if dialect == "sqlserver" else "TIMESTAMP")
                .when(kind == "integer", integer).when(kind == "fraction", "DECIMAL(18,2)").otherwise(varchar))
    return sizes.select("column", "position", sql_type.alias("sql_type"), "nulls", "rows")


def _kinds(df: DataFrame) -> Column:
    kinds = F.when(F.lit(False), "")
    for c in df.columns:
        kinds = kinds.when(F.col("column") == c, _kind(type_of(df, c)))
    return kinds


def primary_key(df: DataFrame) -> str | None:
    """First key-named column, in schema order, with neither nulls nor repeated values."""
    candidates = columns_named(df.columns, fixed.KEY_WORDS)
    stats = per_column(df, candidates, ["nulls"]).collect()
    likely = [c for c in candidates if not next(r["nulls"] for r in stats if r["column"] == c)]
    for c in likely:
        counted = df.groupBy(name(c)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most")).first()
        if counted["most"] is None or counted["most"] == 1:
            return c
    return None


def type_map(df: DataFrame, dialect: str = "postgresql", key: str | None = None) -> DataFrame:
    """``(column, position, dtype, sql_type, nulls, distinct_values, not_null, is_key)``."""
    key = key or primary_key(df)
    kinds = local_table(df.sparkSession, [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                            "column string, dtype string")
    distinct = distinct_counts(df)
    return (sql_types(df, dialect).join(kinds, "column").join(distinct, "column", "left")
            .select("column", "position", "dtype", "sql_type", "nulls", "distinct_values",
                    (F.col("nulls") == 0).alias("not_null"), (F.col("column") == F.lit(key)).alias("is_key")
                    if key else F.lit(False).alias("is_key")))


def create_table(df: DataFrame, table: str = "cleaned_data", dialect: str = "postgresql", schema: str = "",
                 key: str | None = None) -> str:
    """``CREATE TABLE`` text for the table as it is."""
    key = key or primary_key(df)
    quote = (lambda c: f"[{c}]") if dialect == "sqlserver" else (lambda c: c)
    rows = sql_types(df, dialect).orderBy("position").collect()
    lines = []
    for r in rows:
        constraint = ("" if r["nulls"] else " NOT NULL") + (" PRIMARY KEY" if r["column"] == key else "")
        lines.append(f"    {quote(r['column'])} {r['sql_type']}{constraint}")
    return f"CREATE TABLE {schema + '.' if schema else ''}{table} (\n" + ",\n".join(lines) + "\n);"


def type_notes(types: DataFrame) -> DataFrame:
    """How many columns got a sized text, a tiny integer or a decimal type."""
    family = (F.when(F.col("sql_type").contains("VARCHAR"), "VARCHAR")
              .when(F.col("sql_type") == "TINYINT", "TINYINT")
              .when(F.col("sql_type").contains("DECIMAL"), "DECIMAL"))
    return types.select(family.alias("family")).where("family is not null").groupBy("family").agg(
        F.count(F.lit(1)).alias("columns"))
