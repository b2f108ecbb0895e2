"""The 17 audit checks. Each returns long findings ``(check, column, metric, value)``.

A check is a projection of the per-column metrics table, so an audit computes that
table once and every check reads it; called alone, a check asks for its own measures
only. Row-level checks (duplicates, empty rows, test rows) are one aggregate each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed, text
from plumbline.functions.columns import (
    atomic_columns, columns_named, name, numeric_columns, string_columns, type_of)
from plumbline.operators import correlation, similarity
from plumbline.operators.metrics import boolean_pair, per_column, text_profile, unpivot
from plumbline.operators.quantiles import quantiles
from plumbline.session import local_table

FINDINGS = "check string, column string, metric string, value double"
SKIPPED = "skipped"  # the metric of a column that a check has not looked at; it is no issue


def _empty(df: DataFrame) -> DataFrame:
    return local_table(df.sparkSession, [], FINDINGS)


def _metrics(df: DataFrame, metrics: DataFrame | None, measures: list[str]) -> DataFrame:
    return per_column(df, None, measures) if metrics is None else metrics


def _text_metrics(df: DataFrame, metrics: DataFrame | None, measures: list[str]) -> DataFrame:
    return text_profile(df, None, measures) if metrics is None else metrics


def _typed_metrics(df: DataFrame, metrics: DataFrame | None, measures: list[str]) -> DataFrame:
    """Text measures of the text columns beside ``boolean_pair`` of whole numbers and booleans."""
    if metrics is not None:
        return metrics
    others = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
    return text_profile(df, None, measures).drop("position").unionByName(
        per_column(df, others, ["boolean_pair"]).drop("position"), allowMissingColumns=True)


def _boolean() -> Column:
    return F.coalesce(boolean_pair(F.col("boolean_words")), F.col("boolean_pair"))


def _flags(metrics: DataFrame, check: str, flags: dict[str, Column]) -> DataFrame:
    """One finding per column and raised flag."""
    raised = F.array(*[F.struct(F.lit(label).alias("metric"), F.coalesce(cond, F.lit(False)).alias("on"))
                       for label, cond in flags.items()])
    return (metrics.select("column", F.inline(raised)).where(F.col("on"))
            .select(F.lit(check).alias("check"), "column", "metric", F.lit(1.0).alias("value")))


# -- rows ---------------------------------------------------------------------

def row_keys(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Grouping keys that are equal exactly when the rows are equal.

    Text of 32 bytes or more is replaced by its SHA-256 digest, so that a whole-row shuffle moves at most 32 bytes
    per text cell; nested values are compared through their JSON form.
    """
    keys = []
    for c in df.columns if columns is None else columns:
        dtype, key = type_of(df, c), _flat(df, c)
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.StringType)):
            key = F.when(F.octet_length(key) < 32, key.cast("binary")).otherwise(F.unhex(F.sha2(key, 256)))
        keys.append(key)
    return keys


def _flat(df: DataFrame, column: str) -> Column:
    """The column, nested values in their JSON form."""
    dtype, key = type_of(df, column), name(column)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(key.isNotNull(), F.to_json(key if isinstance(dtype, T.StructType) else F.struct(key)))
    return key


def row_hash(df: DataFrame) -> Column:
    """64 bits that are equal for equal rows: hashes leave nulls out and tell zeros apart, so both are settled first."""
    cells = [_flat(df, c) + F.lit(0.0) if isinstance(type_of(df, c), (T.FloatType, T.DoubleType)) else _flat(df, c) for c in df.columns]
    return F.xxhash64(*cells, *[c.isNull() for c in cells])


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: rows, and rows beyond the first of each group of equal rows.

    Rows of different hashes differ, so where no two rows share one there is nothing to compare; otherwise all rows are.
    """
    if not df.columns:  # every column has been dropped: nothing left to compare
        return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("duplicates"))
    hashes = df.select(row_hash(df).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if found["most"] <= 1:
        return local_table(df.sparkSession, [(found["rows"], 0)], "rows bigint, duplicates bigint")
    keys = [k.alias(f"k{i}") for i, k in enumerate(row_keys(df))]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def check_duplicates(df: DataFrame) -> DataFrame:
    pct = F.when(F.col("rows") > 0, F.round(F.col("duplicates") / F.col("rows") * 100, 2)).otherwise(0.0)
    counts = duplicate_counts(df).select(F.lit(None).cast("string").alias("column"),
                                         F.col("duplicates").alias("count"), pct.alias("pct"))
    return unpivot(counts, ["count", "pct"], "duplicates")


def blank_row(df: DataFrame) -> Column:
    """Every cell null or whitespace-only."""
    if not df.columns:
        return F.lit(False)
    atomic = set(atomic_columns(df))
    return reduce(lambda a, b: a & b, [
        text.is_blank(name(c)) if c in atomic else name(c).isNull() for c in df.columns])


def test_row(df: DataFrame) -> Column:
    """Some text cell holds a test word."""
    return reduce(lambda a, b: a | b,
                  [F.coalesce(text.has_test_word(name(c)), F.lit(False)) for c in string_columns(df)], F.lit(False))


def row_counts(df: DataFrame) -> DataFrame:
    """One row: rows, empty rows, test rows; a single scan."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(blank_row(df)).alias("empty_rows"),
                  F.count_if(test_row(df)).alias("test_rows"))


def _count_finding(counts: DataFrame, column: str, check: str) -> DataFrame:
    return unpivot(counts.select(F.lit(None).cast("string").alias("column"), F.col(column).alias("count")),
                   ["count"], check)


def check_empty_rows(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    counts = df.agg(F.count_if(blank_row(df)).alias("empty_rows")) if counts is None else counts
    return _count_finding(counts, "empty_rows", "empty_rows")


def check_test_data(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    counts = df.agg(F.count_if(test_row(df)).alias("test_rows")) if counts is None else counts
    return _count_finding(counts, "test_rows", "test_data")


# -- columns, from the metrics table --------------------------------------------

def check_nulls(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    m = _metrics(df, metrics, ["rows", "nulls"]).where("nulls > 0").select(
        "column", F.col("nulls").alias("null_count"), F.round(F.col("nulls") / F.col("rows") * 100, 2).alias("null_pct"))
    return unpivot(m, ["null_count", "null_pct"], "nulls")


def check_outliers(df: DataFrame, metrics: DataFrame | None = None, z: float = 3.0) -> DataFrame:
    """Values more than ``z`` population deviations from the mean, with IQR fences."""
    numeric = numeric_columns(df)
    measures = ["rows", "nulls", "mean", "std_pop"]
    stats = (per_column(df, numeric, measures) if metrics is None else metrics).collect()
    stats = {r["column"]: r for r in stats if r["column"] in numeric
             and r["rows"] - r["nulls"] >= 4 and r["std_pop"]}
    if not stats:
        return _empty(df)

    def far(column: str) -> Column:
        s = stats[column]
        return F.count_if(F.abs((name(column).cast("double") - s["mean"]) / s["std_pop"]) > z)

    counted = df.agg(*[far(c).alias(c) for c in stats]).first()
    hit = [c for c in stats if counted[c]]
    if not hit:
        return _empty(df)
    fences = quantiles(df, hit, [0.25, 0.75])
    rows = []
    for c in hit:
        q1, q3 = fences[c]
        n = stats[c]["rows"] - stats[c]["nulls"]
        std = stats[c]["std_pop"] * (n / (n - 1)) ** 0.5
        for metric, value in [("zscore_outliers", counted[c]), ("iqr_lower", q1 - 1.5 * (q3 - q1)),
                              ("iqr_upper", q3 + 1.5 * (q3 - q1)), ("mean", stats[c]["mean"]), ("std", std)]:
            rows.append(("outliers", c, metric, float(value)))
    return local_table(df.sparkSession, rows, FINDINGS)


def check_column_names(df: DataFrame) -> DataFrame:
    """Names that are empty, padded, hold other than letters, digits and ``_``, or start upper-case."""
    names = local_table(df.sparkSession, [(c,) for c in df.columns], "column string")
    c = F.col("column")
    bad = (c == "") | F.lower(c).rlike("[^a-z0-9_]") | c.rlike(r"^\p{Lu}")
    return names.where(bad).select(F.lit("column_names").alias("check"), "column",
                                   F.lit("bad_name").alias("metric"), F.lit(1.0).alias("value"))


def check_string_quality(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    m = _text_metrics(df, metrics, ["edge_space", "inner_space", "sql_breaking", "html_tags",
                                    "lettered", "lower_share", "upper_share", "title_share"])
    mixed = ((F.col("lettered") >= 10) & (F.col("lower_share") < 0.8)
             & (F.col("upper_share") < 0.8) & (F.col("title_share") < 0.8))
    return _flags(m, "string_quality", {
        "edge_space": F.col("edge_space"), "inner_space": F.col("inner_space"),
        "sql_breaking": F.col("sql_breaking"), "html_tags": F.col("html_tags"), "inconsistent_casing": mixed})


def date_columns(df: DataFrame) -> list[str]:
    """Date-named columns of a type that can hold dates; ``lead_time INT`` is a number."""
    return [c for c in columns_named(atomic_columns(df), fixed.DATE_WORDS) if text.may_hold_dates(type_of(df, c))]


def check_date_formats(df: DataFrame, as_of: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Unparseable and future values of the date-named columns; ``as_of`` fixes "now"."""
    columns = date_columns(df) if columns is None else columns
    formats = text.date_formats(df, columns)
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    parsed = {c: text.parse_timestamp(name(c), type_of(df, c), formats.get(c)) for c in columns}
    dated = df.select(*[F.struct(name(c).isNotNull().alias("given"), p.alias("ts")).alias(c) for c, p in parsed.items()])
    m = per_column(dated, columns, {
        "unparseable": ("bigint", lambda c, t: F.count_if(c["given"] & c["ts"].isNull())),
        "future_dates": ("bigint", lambda c, t: F.count_if(c["ts"] > now))})
    m = m.where((F.col("unparseable") > 0) | (F.col("future_dates") > 0))
    return unpivot(m, ["unparseable", "future_dates"], "date_formats")


def check_data_types(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    m = _typed_metrics(df, metrics, ["money_share", "boolean_words"])
    return _flags(m, "data_types", {"numeric_as_text": F.col("money_share") > 0.85,
                                    "boolean_as_other": _boolean()})


def schema_issues(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Unscored: text columns that are really numbers or dates, any column that is a boolean pair."""
    m = _typed_metrics(df, metrics, ["money_share", "date_share", "boolean_words"])
    return _flags(m, "schema_issues", {
        "numeric_as_text": F.col("money_share") > 0.85, "date_as_text": F.col("date_share") > 0.85,
        "boolean_as_other": _boolean()})


def check_sparse_columns(df: DataFrame, metrics: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    m = _metrics(df, metrics, ["rows", "nulls"]).where(F.col("nulls") / F.nullif("rows", F.lit(0)) > threshold)
    m = m.select("column", F.round(F.col("nulls") / F.col("rows") * 100, 1).alias("null_pct"))
    return unpivot(m, ["null_pct"], "sparse_columns")


def check_constant_columns(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """At most one distinct value. A deviation, or a sketch that has seen two values, rules a
    column out; the remaining candidates are compared exactly by their extremes."""
    columns = atomic_columns(df)
    if metrics is not None:
        varied = {r["column"] for r in metrics.where("std_pop > 0 or distinct_estimate > 1").collect()}
        columns = [c for c in columns if c not in varied]
    m = per_column(df, columns, ["rows", "nulls", "constant"])
    m = m.where("constant").select("column", F.when(F.col("nulls") < F.col("rows"), 1).otherwise(0).alias("distinct"))
    return unpivot(m, ["distinct"], "constant_columns")


def check_high_correlation(df: DataFrame, threshold: float = 0.95, metrics: DataFrame | None = None) -> DataFrame:
    pairs = correlation.high_pairs(df, threshold, metrics=metrics)
    return pairs.select(F.lit("high_correlation").alias("check"), F.col("col_a").alias("column"),
                        F.col("col_b").alias("metric"), F.round(F.abs("r"), 4).alias("value"))


def check_mixed_types(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    m = _text_metrics(df, metrics, ["number_share"]).where("number_share > 0.1 and number_share < 0.9")
    m = m.select("column", F.round(F.col("number_share") * 100, 1).alias("numeric_pct"))
    return unpivot(m, ["numeric_pct"], "mixed_types")


def _format_check(df: DataFrame, check: str, words: list[str], pattern: str) -> DataFrame:
    columns = columns_named(atomic_columns(df), words)
    m = per_column(df, columns, {"invalid": ("bigint", lambda c, t: F.count_if(~c.cast("string").rlike(pattern)))})
    return unpivot(m.where("invalid > 0"), ["invalid"], check)


def check_email_format(df: DataFrame) -> DataFrame:
    return _format_check(df, "email_format", fixed.EMAIL_WORDS, fixed.EMAIL_PATTERN)


def check_phone_format(df: DataFrame) -> DataFrame:
    return _format_check(df, "phone_format", fixed.PHONE_WORDS, fixed.PHONE_PATTERN)


def check_typos(df: DataFrame, threshold: float = 85, limit: int | None = None,
                columns: list[str] | None = None, estimates: dict[str, int] | None = None) -> DataFrame:
    """Per column: values that have a near-duplicate, and the near-duplicate pairs. A column of more
    than ``limit`` distinct values is not compared, and named by a ``skipped`` finding."""
    values, wide = similarity.limited_values(df, columns, limit, estimates)
    pairs = similarity.similar_pairs(values.drop("freq"), threshold)
    ends = pairs.select("column", F.explode(F.array("value_a", "value_b")).alias("value"), F.lit(0.5).alias("half"))
    m = ends.groupBy("column").agg(F.countDistinct("value").alias("similar_values"), F.sum("half").alias("similar_pairs"))
    skipped = local_table(df.sparkSession, [("typos", c, SKIPPED, 1.0) for c in wide], FINDINGS)
    return unpivot(m, ["similar_values", "similar_pairs"], "typos").unionByName(skipped)


def check_pii(df: DataFrame, match: str = "substring") -> DataFrame:
    rows = [("pii", c, "pii_name", 1.0) for c in columns_named(df.columns, fixed.PII_WORDS, match)]
    return local_table(df.sparkSession, rows, FINDINGS)
