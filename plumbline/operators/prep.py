"""Preparation for modelling: scaling, encoding, date parts and derived features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed, text
from plumbline.functions.columns import columns_named, name, numeric_columns, string_columns, type_of, unused
from plumbline.operators.clean import text_number_columns
from plumbline.operators.metrics import per_column
from plumbline.operators.ordering import dense_index, global_index
from plumbline.operators.profile import distinct_counts
from plumbline.operators.quantiles import quantiles
from plumbline.operators.similarity import value_counts
from plumbline.session import local_table, materialize



# -- scaling ----------------------------------------------------------------------

def normalize_columns(df: DataFrame, method: str = "minmax", columns: Sequence[str] | None = None) -> DataFrame:
    """``minmax`` to 0..1 or ``zscore`` by the sample deviation; constant columns stay as they are."""
    columns = numeric_columns(df) if columns is None else list(columns)
    changes = {}
    for r in per_column(df, columns, ["min", "max", "mean", "std"]).collect():
        c = name(r["column"]).cast("double")
        if method == "minmax" and r["max"] is not None and r["max"] != r["min"]:
            changes[r["column"]] = (c - r["min"]) / (r["max"] - r["min"])
        elif method == "zscore" and r["std"]:
            changes[r["column"]] = (c - r["mean"]) / r["std"]
    return df.withColumns(changes) if changes else df


# -- encoding -----------------------------------------------------------------------

def _lookup(df: DataFrame, column: str, table: DataFrame, value: str, alias: str) -> DataFrame:
    """Left join of a dictionary ``(column, value)`` with one row per distinct value.

    The dictionary's size follows the data, so nothing is forced: AQE broadcasts it when
    it turns out small and splits a hot value's rows when it does not.
    """
    key, found = unused(df.columns, "_key"), unused(df.columns, "_found")
    joined = df.join(table.select(name(column).alias(key), name(value).alias(found)), name(column) == F.col(key), "left")
    return joined.select(*[F.col(found).alias(c) if c == alias else name(c) for c in df.columns],
                         *([] if alias in df.columns else [F.col(found).alias(alias)]))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, code)``: rank of each distinct value, from 0."""
    return dense_index(df, [column]).select(F.col("value").alias(column), "code")


def _counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(name(column).isNotNull()).groupBy(name(column)).agg(F.count(F.lit(1)).alias("n"))


def encode_categoricals(df: DataFrame, method: str = "label", columns: Sequence[str] | None = None,
                        limit: int | None = None) -> DataFrame:
    """``label``: rank of the value, null stays null. ``frequency``: share of the non-null rows.
    ``onehot``: one boolean per value, the source column goes; a ``limit`` refuses columns of more values."""
    columns = string_columns(df) if columns is None else list(columns)
    for c in columns:
        type_of(df, c)
    if method == "label":
        for c in columns:
            df = _lookup(df, c, label_codes(df, c), "code", c)
        return df
    if method == "frequency":
        for c in columns:
            counts = _counts(df, c)
            total = df.agg(F.count(name(c))).first()[0]
            df = _lookup(df, c, counts.withColumn("share", F.col("n") / F.lit(total)), "share", c)
        return df
    if method == "onehot":
        return _one_hot(df, columns, limit)
    raise ValueError(f"unknown method {method!r}")


def sparse_one_hot(df: DataFrame, columns: Sequence[str] | None = None, alias: str = "features") -> tuple[DataFrame, DataFrame]:
    """The table with ``alias``, the sorted positions that are one, in place of ``columns``; and the dictionary.

    The dictionary ``(column, value, position)`` numbers all values of all columns from 0, by column and value, as the
    wide form orders them. It stays a table: any number of values costs one join per column. Null has no position.
    """
    columns = string_columns(df) if columns is None else list(columns)
    counted = value_counts(df, columns).select("column", "value")
    dictionary = materialize(global_index(counted, ["column", "value"], "position"), "dictionary")
    places = []
    out = df
    for c in columns:
        places.append(unused(out.columns, "_position"))
        text = unused(out.columns, "_text")
        own = dictionary.where(F.col("column") == c).select("value", "position")
        out = _lookup(out.withColumn(text, name(c).cast("string")), text, own.withColumnRenamed("value", text), "position", places[-1]).drop(text)
    kept = [name(c) for c in df.columns if c not in columns and c != alias]
    return out.select(*kept, F.array_sort(F.array_compact(F.array(*[F.col(p) for p in places]).cast("array<bigint>"))).alias(alias)), dictionary


def _one_hot(df: DataFrame, columns: Sequence[str], limit: int | None) -> DataFrame:
    counted = value_counts(df, columns).select("column", "value")
    if limit is not None:
        wide = counted.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()
        if wide:
            raise ValueError(f"more than {limit} distinct values; use label or frequency encoding: {[r['column'] for r in wide]}")
    values: dict[str, list[str]] = {c: [] for c in columns}
    for r in counted.orderBy("column", "value").toLocalIterator():  # one output column each
        values[r["column"]].append(r["value"])
    kept = [name(c) for c in df.columns if c not in columns]
    flags = [F.coalesce(name(c).cast("string") == v, F.lit(False)).alias(f"{c}_{v}")
             for c in columns for v in values[c]]
    return df.select(*kept, *flags)


# -- dates ---------------------------------------------------------------------------

def add_datetime_features(df: DataFrame, column: str) -> DataFrame:
    """Parse the column and add year, month, day, weekday name and quarter; all null for a column
    that cannot hold dates, such as a number, which stays as it is."""
    c = _timestamp(df, column)
    if text.may_hold_dates(type_of(df, column)):
        df, c = df.withColumn(column, c), name(column)
    return df.withColumns({
        f"{column}_year": F.year(c), f"{column}_month": F.month(c), f"{column}_day": F.dayofmonth(c),
        f"{column}_weekday": F.date_format(c, "EEEE"), f"{column}_quarter": F.quarter(c)})


# -- derived features -----------------------------------------------------------------

def suggest_features(df: DataFrame) -> DataFrame:
    """``(position, feature, kind, source)``: features worth deriving, from names, types and cardinality."""
    numeric = set(numeric_columns(df)) | set(text_number_columns(df))
    numbers = [c for c in df.columns if c in numeric]
    texts = [c for c in string_columns(df) if c not in numeric]
    rows: list[tuple[str, str, str]] = []
    for c in columns_named(df.columns, fixed.FEATURE_DATE_WORDS):
        if not text.may_hold_dates(type_of(df, c)):
            continue
        rows += [(f"{c}_{part}", "date", c) for part in ("year", "month", "is_weekend", "quarter")]
    prices, quantities = columns_named(numbers, fixed.PRICE_WORDS), columns_named(numbers, fixed.QUANTITY_WORDS)
    if prices and quantities:
        rows += [("avg_unit_price", "math", f"{prices[0]},{quantities[0]}"), ("total_value_flag", "math", prices[0])]
    if len(numbers) >= 2:
        rows.append((f"{numbers[0]}_to_{numbers[1]}_ratio", "math", f"{numbers[0]},{numbers[1]}"))
    distinct = {r["column"]: r["distinct_values"] for r in distinct_counts(df, texts).collect()}
    for c in texts:
        if 2 <= distinct[c] <= 30:
            rows.append((f"{c}_encoded", "category", c))
        if distinct[c] <= 10:
            rows.append((f"{c}_freq", "category", c))
    return local_table(df.sparkSession, [(i, *r) for i, r in enumerate(rows)], "position int, feature string, kind string, source string")


def _timestamp(df: DataFrame, column: str) -> Column:
    return text.parse_timestamp(name(column), type_of(df, column), text.date_formats(df, [column]).get(column))


def add_date_parts(df: DataFrame, column: str, parts: Sequence[str] = ("year", "month", "quarter", "is_weekend")) -> DataFrame:
    ts = _timestamp(df, column)
    build = {"year": F.year(ts), "month": F.month(ts), "quarter": F.quarter(ts),
             "is_weekend": F.coalesce(F.weekday(ts).isin(5, 6), F.lit(False)).cast("int")}
    return df.withColumns({f"{column}_{p}": build[p] for p in parts})


def add_encoded(df: DataFrame, column: str) -> DataFrame:
    """``<column>_encoded``: category code, -1 for null."""
    alias = f"{column}_encoded"
    return _lookup(df, column, label_codes(df, column), "code", alias).withColumn(
        alias, F.coalesce(name(alias), F.lit(-1)))


def add_frequency(df: DataFrame, column: str) -> DataFrame:
    """``<column>_freq``: how many rows hold the same value; null for null."""
    return _lookup(df, column, _counts(df, column), "n", f"{column}_freq")


def add_unit_price(df: DataFrame) -> DataFrame:
    """``avg_unit_price``: first price-named column over first quantity-named one, 0 meaning unknown."""
    prices = columns_named(numeric_columns(df), fixed.UNIT_PRICE_WORDS)
    quantities = columns_named(numeric_columns(df), fixed.UNIT_QUANTITY_WORDS)
    if not prices or not quantities:
        return df
    return df.withColumn("avg_unit_price", F.try_divide(name(prices[0]).cast("double"), name(quantities[0]).cast("double")))


def add_value_flag(df: DataFrame, column: str | None = None) -> DataFrame:
    """``total_value_flag``: 1 above the column's median, else 0."""
    column = column or columns_named(numeric_columns(df), fixed.PRICE_WORDS)[0]
    median = quantiles(df, [column], [0.5])[column][0]
    return df.withColumn("total_value_flag", F.coalesce(name(column) > F.lit(median), F.lit(False)).cast("int"))


def add_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn(f"{a}_to_{b}_ratio", F.try_divide(name(a).cast("double"), name(b).cast("double") + F.lit(1e-9)))


def add_features(df: DataFrame, approved: Sequence[str]) -> DataFrame:
    """Create the approved features out of those ``suggest_features`` offers."""
    offered = {r["feature"]: r for r in suggest_features(df).collect()}
    for feature in approved:
        if feature not in offered:
            raise ValueError(f"unknown feature {feature!r}; offered: {sorted(offered)}")
        kind, source = offered[feature]["kind"], offered[feature]["source"]
        if kind == "date":
            df = add_date_parts(df, source, [feature[len(source) + 1:]])
        elif feature == "avg_unit_price":
            df = add_unit_price(df)
        elif feature == "total_value_flag":
            df = add_value_flag(df, source)
        elif kind == "math":
            df = add_ratio(df, *source.split(",", 1))
        elif feature.endswith("_encoded"):
            df = add_encoded(df, source)
        else:
            df = add_frequency(df, source)
    return df
