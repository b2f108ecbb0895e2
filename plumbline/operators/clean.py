"""Row, column, null, type and text fixes. Every fix takes and returns a DataFrame.

Row-local fixes are plain projections and also accept streaming DataFrames. Fixes
that need statistics read them with one small aggregate and come back as literals.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed, text
from plumbline.functions.columns import (
    atomic_columns, name, numeric_columns, snake_name, string_columns, temporal_columns,
    type_class, type_of)
from plumbline.operators import checks, ordering
from plumbline.operators.correlation import high_pairs
from plumbline.operators.metrics import only_boolean_words, per_column, text_profile
from plumbline.operators.quantiles import quantiles
from plumbline.session import local_table, materialize


# -- rows -----------------------------------------------------------------------

def _dedup_keys(df: DataFrame, subset: Sequence[str] | None, exclude_temporal: bool) -> list[str]:
    if subset is not None:
        for c in subset:
            type_of(df, c)
        return list(subset)
    dated = set(temporal_columns(df)) if exclude_temporal else set()
    return [c for c in df.columns if c not in dated] or df.columns


_NUMBER = "_row_number"


def _content(df: DataFrame) -> list[Column]:
    """The row's cells as something that can be compared: maps cannot, wherever they are nested."""
    return [F.to_json(F.struct(name(c))).alias(c) if "map<" in type_of(df, c).simpleString() else name(c) for c in df.columns]


def _grouped(df: DataFrame, subset: Sequence[str], order_by, keep: str | bool) -> DataFrame:
    """One row per group of equal keys: ``n`` rows, and the kept row.

    A plain grouped minimum over ``(order, row)``: it combines map-side, so a group that
    holds a third of the table is reduced before the shuffle and never sorted in one task.
    """
    order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by or [])
    keys = checks.row_keys(df, list(subset))
    rank = [name(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)]
    # Ties on the order key are settled by the row's content; maps cannot be compared.
    rank.append(F.struct(*_content(df)).alias("o_row"))
    pick = F.max_by if keep == "last" else F.min_by
    row = F.struct(*[name(c) for c in df.columns])
    return (df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
            .agg(F.count(F.lit(1)).alias("n"), pick(row, F.struct(*rank)).alias("row")))


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first",
                      order_by=None, exclude_temporal: bool = True) -> DataFrame:
    """Keep the first, the last or (``keep=False``) none of the rows that agree on ``subset``.

    The default subset is every column that is not a date or timestamp; nulls are equal. Tables
    have no order of their own: without ``order_by`` rows are ordered by their content.
    """
    subset = _dedup_keys(df, subset, exclude_temporal)
    if keep == "first" and order_by is None and len(subset) == len(df.columns):
        return df.dropDuplicates() if not _has_map(df) else _grouped(df, subset, order_by, keep).select("row.*")
    groups = _grouped(df, subset, order_by, keep)
    return (groups.where("n = 1") if keep is False else groups).select("row.*")


def _has_map(df: DataFrame) -> bool:
    return any("map<" in f.dataType.simpleString() for f in df.schema.fields)


def dropped_duplicates(df: DataFrame, row_id: str, subset: Sequence[str] | None = None,
                       exclude_temporal: bool = True) -> DataFrame:
    """The trail of rows that ``remove_duplicates(..., keep='first', order_by=row_id)`` drops.

    ``row_id`` must be unique and is not compared. Only groups with more than one row are
    joined back, and only their keys travel; AQE splits a hot group's side of the join.
    """
    subset = [c for c in _dedup_keys(df, subset, exclude_temporal) if c != row_id]
    keys = [k.alias(f"k{i}") for i, k in enumerate(checks.row_keys(df, subset))]
    names = [f"k{i}" for i in range(len(keys))]
    kept = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(name(row_id)).alias("kept_id"))
            .where("n > 1").select(F.xxhash64(*names).alias("h"), *names, "kept_id"))
    tagged = df.select(*[name(c) for c in df.columns], *keys).withColumn("h", F.xxhash64(*names))
    same = reduce(lambda a, b: a & b, [tagged[k].eqNullSafe(kept[k]) for k in names], tagged["h"] == kept["h"])
    joined = tagged.join(kept, same & (tagged[row_id] != kept["kept_id"]))
    return joined.select(*[tagged["`" + c.replace("`", "``") + "`"] for c in df.columns], kept["kept_id"])


def duplicate_trail(df: DataFrame, order_by=None, exclude_temporal: bool = True) -> DataFrame:
    """The rows that ``remove_duplicates(keep='first', order_by=order_by)`` drops, all columns.

    Rows get a number in one written copy of the table, so that of rows equal in every column all
    but one are named; AQE splits a hot group's side of the join.
    """
    numbered = materialize(df.withColumn(_NUMBER, F.monotonically_increasing_id()), "numbered")
    order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by or [])
    subset = _dedup_keys(df, None, exclude_temporal)
    keys = [k.alias(f"k{i}") for i, k in enumerate(checks.row_keys(df, subset))]
    names = [f"k{i}" for i in range(len(keys))]
    rank = F.struct(*[name(o) if isinstance(o, str) else o for o in order], *_content(df), name(_NUMBER))
    kept = (numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(name(_NUMBER), rank).alias("kept"))
            .where("n > 1").select(F.xxhash64(*names).alias("h"), *names, "kept"))
    tagged = numbered.select("*", *keys).withColumn("h", F.xxhash64(*names))
    same = reduce(lambda a, b: a & b, [tagged[k].eqNullSafe(kept[k]) for k in names], tagged["h"] == kept["h"])
    dropped = tagged.join(kept, same & (tagged[_NUMBER] != kept["kept"]))
    return dropped.select(*[tagged["`" + c.replace("`", "``") + "`"] for c in df.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Whitespace-only text becomes null everywhere, then rows without any value go."""
    blanked = df.withColumns({
        c: F.when(~text.is_blank(name(c)), name(c)) for c in string_columns(df)}) if string_columns(df) else df
    return blanked.na.drop("all")


# -- columns --------------------------------------------------------------------

def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    found = checks.check_sparse_columns(df, threshold=threshold).select("column").collect()
    return df.drop(*[name(r["column"]) for r in found])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    found = checks.check_constant_columns(df).select("column").distinct().collect()
    return df.drop(*[name(r["column"]) for r in found])


def drop_highly_correlated(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Drop every column that correlates with an earlier one beyond the threshold."""
    found = high_pairs(df, threshold).select("col_b").distinct().collect()
    return df.drop(*[name(r["col_b"]) for r in found])


def clean_column_names(df: DataFrame) -> DataFrame:
    names = [snake_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes or "" in names:
        raise ValueError(f"column names collide or vanish after cleaning: {clashes or ['']}")
    return df.toDF(*names)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.select(*[name(c) for c in order], *[name(c) for c in df.columns if c not in order])


def split_column(df: DataFrame, column: str, delimiter: str, new_columns: Sequence[str]) -> DataFrame:
    """Split into columns; a one-character delimiter is literal, a longer one a pattern."""
    type_of(df, column)
    pattern = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", delimiter) if len(delimiter) == 1 else delimiter
    parts = F.split(name(column).cast("string"), pattern, -1)
    return df.withColumns({c: F.get(parts, F.lit(i)) for i, c in enumerate(new_columns)})


def merge_columns(df: DataFrame, columns: Sequence[str], new_column: str, separator: str = " ") -> DataFrame:
    for c in columns:
        type_of(df, c)
    return df.withColumn(new_column, F.concat_ws(separator, *[name(c).cast("string") for c in columns]))


def replace_values(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    type_of(df, column)
    return df.replace(dict(mapping), subset=[column])


# -- nulls ----------------------------------------------------------------------

def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value of each column, the lowest one on ties.

    Counts are grouped (combined map-side) rather than buffered per column, so a column
    of mostly distinct values is safe. Values keep their type: one grouping per type.
    """
    found: dict[str, object] = {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(type_of(df, c).simpleString(), []).append(c)
    for group in by_type.values():
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), name(c).alias("value")) for c in group]))
        counts = (df.select(cells).where(F.col("value").isNotNull())
                  .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
        found.update({r["column"]: r["value"] for r in best.collect()})
    return found


def _fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls by literals; an integer column filled with a fraction becomes double."""
    changes = {}
    for c, v in values.items():
        if v is None:
            continue
        column = name(c)
        if isinstance(v, float) and not v.is_integer() and isinstance(type_of(df, c), T.IntegralType):
            column = column.cast("double")
        elif isinstance(type_of(df, c), (T.IntegralType, T.DecimalType)):
            v = F.lit(v).cast(type_of(df, c))
        changes[c] = F.coalesce(column, v if isinstance(v, Column) else F.lit(v))
    return df.withColumns(changes) if changes else df


def handle_nulls(df: DataFrame, strategy: str = "median", fill_value=None, columns: Sequence[str] | None = None,
                 order_by=None) -> DataFrame:
    """Fill gaps: mean, median, mode, constant, ffill, bfill or interpolate.

    Without ``columns`` the numeric columns are filled and text gaps become "Unknown".
    An unknown strategy means median. The three ordered strategies need ``order_by``.
    """
    targets = [c for c in (columns if columns is not None else numeric_columns(df)) if c in df.columns]
    if strategy in ("ffill", "bfill", "interpolate"):
        fill = {"ffill": ordering.fill_forward, "bfill": ordering.fill_backward,
                "interpolate": ordering.interpolate}[strategy]
        out = fill(df, targets, order_by) if targets else df
    elif strategy == "constant":
        out = _fill(df, {c: 0 if fill_value is None else fill_value for c in targets})
    elif strategy == "mode":
        out = _fill(df, most_frequent(df, targets))
    elif strategy == "mean":
        stats = per_column(df, targets, ["mean"]).collect()
        out = _fill(df, {r["column"]: r["mean"] for r in stats})
    else:
        out = _fill(df, {c: q[0] for c, q in quantiles(df, targets, [0.5]).items()})
    if columns is None and string_columns(df):
        out = out.fillna("Unknown", subset=string_columns(df))
    return out


def impute_choices(df: DataFrame, skew_threshold: float = 1.0, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column with gaps: mean, median, skewness and which of the two to use."""
    columns = numeric_columns(df) if columns is None else list(columns)
    stats = [r for r in per_column(df, columns, ["rows", "nulls", "mean", "skewness"]).collect()
             if 0 < r["nulls"] < r["rows"]]
    medians = quantiles(df, [r["column"] for r in stats], [0.5])
    rows = []
    for r in stats:
        use_mean = r["skewness"] is not None and abs(r["skewness"]) <= skew_threshold
        median = medians[r["column"]][0]
        rows.append((r["column"], r["nulls"], r["mean"], median, r["skewness"], "mean" if use_mean else "median",
                     r["mean"] if use_mean else median))
    return local_table(df.sparkSession, rows, "column string, nulls bigint, mean double, median double, skewness double, choice string, fill double")


def smart_impute(df: DataFrame, skew_threshold: float = 1.0) -> DataFrame:
    """Numbers: mean when the skew is small, else median. Others: most frequent value,
    or "Unknown" for a text column without any value."""
    gaps = {r["column"]: r for r in per_column(df, atomic_columns(df), ["rows", "nulls"]).where("nulls > 0").collect()}
    if not gaps:
        return df
    numeric = [c for c in numeric_columns(df) if c in gaps]
    others = [c for c in gaps if c not in numeric]
    values: dict[str, object] = {r["column"]: r["fill"] for r in impute_choices(df, skew_threshold, numeric).collect()}
    values.update(most_frequent(df, others))
    for c in others:
        if values.get(c) is None and type_class(type_of(df, c)) == "string":
            values[c] = "Unknown"
    return _fill(df, values)


def junk_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = string_columns(df) if columns is None else list(columns)
    return df.withColumns({c: F.when(~text.is_junk(name(c)), name(c)) for c in columns}) if columns else df


def text_number_columns(df: DataFrame, minimum: float = 0.7) -> list[str]:
    """Text columns of which at least ``minimum`` of the real (non-junk) cells are numbers."""
    m = text_profile(df, None, ["real_number_share"])
    return [r["column"] for r in m.where(F.col("real_number_share") >= minimum).collect()]


def coerce_numeric_text(df: DataFrame) -> DataFrame:
    """Text columns with gaps that are really numeric become double; other cells become null."""
    gaps = {r["column"] for r in per_column(df, string_columns(df), ["nulls"]).where("nulls > 0").collect()}
    targets = [c for c in text_number_columns(df) if c in gaps]
    return df.withColumns({c: text.parse_number(name(c)) for c in targets}) if targets else df


def fill_columns(df: DataFrame, choices: Mapping[str, str]) -> DataFrame:
    """Per-column choice: mean, median, mode for numbers; for text a value, ``custom:<text>`` or
    ``unknown_label``. "leave blank" and "leave empty" do nothing."""
    active = {c: s for c, s in choices.items() if c in df.columns and s not in ("leave blank", "leave empty")}
    numeric = {c: s for c, s in active.items() if c in numeric_columns(df)}
    values: dict[str, object] = {}
    means = [c for c, s in numeric.items() if s == "mean"]
    if means:
        values.update({r["column"]: r["mean"] for r in per_column(df, means, ["mean"]).collect()})
    values.update({c: q[0] for c, q in quantiles(df, [c for c, s in numeric.items() if s == "median"], [0.5]).items()})
    modes = [c for c, s in numeric.items() if s == "mode"]
    if modes:
        values.update(most_frequent(df, modes))
    for c, s in active.items():
        if c not in numeric:
            values[c] = s[len("custom:"):] if s.startswith("custom:") else "Unknown" if s == "unknown_label" else s
    return _fill(df, {c: v for c, v in values.items() if v != ""})


# -- types ----------------------------------------------------------------------

def enforce_dtypes(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Cast the columns that cast without losing a value; leave the others unchanged."""
    return df.withColumns({
        r["column"]: name(r["column"]).try_cast(schema[r["column"]])
        for r in cast_report(df, schema).where("adopted").collect()})


def cast_report(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """``(column, failures, adopted)``: cells each asked cast would lose."""
    asked = [c for c in schema if c in df.columns]
    if not asked:
        return local_table(df.sparkSession, [], "column string, failures bigint, adopted boolean")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(
        name(c).isNotNull() & name(c).try_cast(schema[c]).isNull()).alias("failures")) for c in asked])
    return (df.agg(entries.alias("e")).select(F.inline("e"))
            .withColumn("adopted", F.col("failures") == 0))


def fix_numeric_strings(df: DataFrame, columns: Sequence[str] | None = None, minimum: float = 0.85) -> DataFrame:
    """Text columns become numbers when more than ``minimum`` of all rows parse without ``$ , % € £``."""
    columns = string_columns(df) if columns is None else [c for c in columns if c in string_columns(df)]
    parsed = lambda c: text.parse_number(text.strip_currency(c))
    m = per_column(df, columns, {"share": ("double", lambda c, t: F.avg(parsed(c).isNotNull().cast("int")))})
    targets = [r["column"] for r in m.where(F.col("share") > minimum).collect()]
    return df.withColumns({c: parsed(name(c)) for c in targets}) if targets else df


def fix_date_formats(df: DataFrame, columns: Sequence[str] | None = None,
                     formats: Sequence[str] | None = None) -> DataFrame:
    """Date-named columns become timestamps; cells no format parses become null.

    A column is read in one order of day and month, the one that parses more cells. Columns that
    cannot hold dates, such as numbers, stay as they are.
    """
    columns = checks.date_columns(df) if columns is None else [c for c in columns if text.may_hold_dates(type_of(df, c))]
    chosen = text.date_formats(df, columns, formats)
    return df.withColumns({
        c: text.parse_timestamp(name(c), type_of(df, c), chosen.get(c, formats)) for c in columns}) if columns else df


def convert_booleans(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns that hold nothing but boolean words become booleans."""
    columns = string_columns(df) if columns is None else list(columns)
    masks = text_profile(df, columns, ["boolean_words"]).where(only_boolean_words(F.col("boolean_words"))).collect()
    truths = [pair[0] for pair in fixed.BOOLEAN_PAIRS]
    return df.withColumns({r["column"]: F.lower(name(r["column"]).cast("string")).isin(truths)
                           for r in masks}) if masks else df


# -- text -----------------------------------------------------------------------

def _on_text(df: DataFrame, columns: Sequence[str] | None, change) -> DataFrame:
    columns = string_columns(df) if columns is None else list(columns)
    return df.withColumns({c: change(name(c).cast("string")) for c in columns}) if columns else df


def standardize_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trim, collapse whitespace, drop HTML tags, drop quotes and backslashes, capitalise."""
    def change(c: Column) -> Column:
        c = F.regexp_replace(text.collapse_whitespace(text.strip(c)), fixed.HTML_TAG_PATTERN, "")
        return text.capitalize(F.regexp_replace(c, fixed.SQL_BREAKING_PATTERN, ""))
    return _on_text(df, columns, change)


def normalize_text_case(df: DataFrame, columns: Sequence[str] | None = None, case: str = "lower") -> DataFrame:
    return _on_text(df, columns, {"lower": F.lower, "upper": F.upper, "title": text.title}[case])


def strip_html_tags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _on_text(df, columns, lambda c: text.strip(F.regexp_replace(c, fixed.HTML_TAG_PATTERN, "")))


def remove_special_characters(df: DataFrame, columns: Sequence[str] | None = None, keep_spaces: bool = True) -> DataFrame:
    pattern = r"(?U)[^a-zA-Z0-9\s]" if keep_spaces else "[^a-zA-Z0-9]"
    return _on_text(df, columns, lambda c: text.strip(F.regexp_replace(c, pattern, "")))


def cap_string_length(df: DataFrame, max_length: int = 255, columns: Sequence[str] | None = None) -> DataFrame:
    return _on_text(df, columns, lambda c: F.substring(c, 1, max_length))


def remove_extra_whitespace(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _on_text(df, columns, lambda c: text.strip(text.collapse_whitespace(c)))


# -- outliers -------------------------------------------------------------------

def handle_outliers(df: DataFrame, method: str = "iqr", threshold: float = 3,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """``iqr`` clips to the 1.5 IQR fences, ``zscore`` to mean +/- threshold deviations, ``drop``
    removes the rows where any column lies threshold or more deviations out."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df
    if method == "drop":
        return _drop_outliers(df, columns, threshold)
    limits = {}
    if method == "iqr":
        for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75]).items():
            if q1 is not None and q3 != q1:
                limits[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    elif method == "zscore":
        for r in per_column(df, columns, ["mean", "std"]).collect():
            if r["std"]:
                limits[r["column"]] = (r["mean"] - threshold * r["std"], r["mean"] + threshold * r["std"])
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumns({
        c: F.when(name(c).isNotNull(), F.greatest(F.least(name(c).cast("double"), F.lit(hi)), F.lit(lo)))
        for c, (lo, hi) in limits.items()}) if limits else df


def _drop_outliers(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    # A null counts as the mean, so its own score is 0 and it only widens n: the
    # deviation over the filled column is the known one scaled by sqrt(known / all).
    stats = per_column(df, columns, ["rows", "nulls", "mean", "std_pop"]).collect()
    keep = F.lit(True)
    for r in stats:
        if not r["std_pop"]:
            continue
        spread = r["std_pop"] * ((r["rows"] - r["nulls"]) / r["rows"]) ** 0.5
        score = F.abs((name(r["column"]).cast("double") - r["mean"]) / spread)
        keep = keep & (F.coalesce(score, F.lit(0.0)) < threshold)
    return df.where(keep)


