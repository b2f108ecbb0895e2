"""Profiles, distributions and grouped summaries.

Everything aggregates the whole table first and only then ranks or cuts the small
result; chart-sized outputs (top N, bins, buckets) are features, not caps on input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed, text
from plumbline.functions.columns import (
    atomic_columns, name, numeric_columns, string_columns, temporal_columns, type_of)
from plumbline.operators import checks
from plumbline.operators.clean import impute_choices
from plumbline.operators.metrics import per_column, text_profile
from plumbline.operators.quantiles import grouped_quantiles, picked_quantiles, quantiles, ranked_values
from plumbline.operators.similarity import value_counts
from plumbline.session import local_table, materialize


def _pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100, whole), digits)


# -- values ----------------------------------------------------------------------

def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """``(value, count, share_pct)`` of the most frequent values; the share is of all rows."""
    total = df.count()
    counts = (df.where(name(column).isNotNull()).groupBy(name(column).cast("string").alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    return (counts.orderBy(F.desc("count"), "value").limit(n)
            .withColumn("share_pct", _pct(F.col("count"), F.lit(total), 1)))


def top_values_by_column(df: DataFrame, columns: Sequence[str], n: int, skip_junk: bool = False) -> DataFrame:
    """Most frequent values of several columns in one pass: ``(column, rank, value, count)``.

    The rank filter is pushed below the shuffle (a per-task group limit), so a column with
    very many distinct values sends only its leaders.
    """
    cells = df
    if skip_junk:
        cells = df.select(*[F.when(~text.is_junk(name(c)), text.strip(name(c))).alias(c) for c in columns])
    counts = value_counts(cells, columns).withColumnRenamed("freq", "count")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("column", "rank", "value", "count")


def fill_candidates(df: DataFrame, n: int = 6) -> DataFrame:
    """Most common real values of each text column that has gaps."""
    gaps = [r["column"] for r in per_column(df, string_columns(df), ["nulls"]).where("nulls > 0").collect()]
    if not gaps:
        return local_table(df.sparkSession, [], "column string, rank int, value string, count bigint")
    return top_values_by_column(df, gaps, n, skip_junk=True)


def sample_values(df: DataFrame, column: str, n: int = 8, seed: int = 42) -> DataFrame:
    """A repeatable sample: the ``n`` distinct non-null values with the smallest seeded hash."""
    cells = df.select(name(column).alias("value")).where("value is not null").withColumn("_hash", F.xxhash64("value", F.lit(seed)))
    # The hashes of so many distinct values lie below a bound; only those cells are shuffled. Rarely that is too few.
    some = df.agg(F.approx_count_distinct(name(column))).first()[0]
    below = min(1.0, (8 * n + 64) / max(some, 1))
    few = materialize(cells.where(F.col("_hash") <= int((below * 2 - 1) * ((1 << 63) - 1))).distinct(), "smallest") if below < 1 else cells.distinct()
    found = few if below == 1 or few.limit(n).count() == n else cells.distinct()
    return found.orderBy("_hash", "value").limit(n).select("value")


def pie_shares(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    """Top values with their share of the shown total."""
    top = top_values(df, column, n).drop("share_pct")
    shown = top.agg(F.sum("count")).first()[0]
    return top.withColumn("share_pct", _pct(F.col("count"), F.lit(shown)))


# -- columns ---------------------------------------------------------------------

def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact ``(column, distinct_values)`` without the row expansion of many
    ``count(DISTINCT)``: one grouped pass over ``(column, value)`` cells."""
    columns = atomic_columns(df) if columns is None else list(columns)
    if not columns:
        return local_table(df.sparkSession, [], "column string, distinct_values bigint")
    names = local_table(df.sparkSession, [(c,) for c in columns], "column string")
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(type_of(df, c).simpleString(), []).append(c)
    counted = None
    for group in by_type.values():  # cells keep their type: no cast to text, and each scan reads its columns only
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), name(c).alias("value")) for c in group]))
        part = (df.select(cells).where("value is not null").distinct()
                .groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")))
        counted = part if counted is None else counted.unionAll(part)
    return names.join(F.broadcast(counted), "column", "left").withColumn(
        "distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint")))


def profile_column(df: DataFrame, column: str) -> DataFrame:
    """One row: type, rows, nulls, distinct values, top five and, for numbers, the moments."""
    dtype = type_of(df, column)
    stats = per_column(df, [column], ["rows", "nulls", "min", "max", "mean", "std", "skewness"])
    top = top_values_by_column(df, [column], 5).groupBy("column").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "value", "count"))),
        lambda t: F.concat(t["value"], F.lit("="), t["count"].cast("string"))), ";").alias("top_5"))
    return (stats.join(distinct_counts(df, [column]), "column").join(top, "column", "left")
            .select("column", F.lit(dtype.simpleString()).alias("dtype"), "rows", "nulls",
                    _pct(F.col("nulls"), F.col("rows")).alias("null_pct"), "distinct_values", "top_5", "min", "max",
                    F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                    F.round("skewness", 4).alias("skewness")))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: fill rate, min, max, mean, median, std, skew, excess kurtosis, Q1, Q3, IQR."""
    columns = numeric_columns(df) if columns is None else list(columns)
    measures = ["rows", "nulls", "min", "max", "mean", "std", "skewness", "kurtosis"]
    profile = per_column(df, columns, measures)
    stats = profile.collect()
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    quartiles = local_table(df.sparkSession, [(c, *v) for c, v in q.items()],
                                                "column string, q1 double, median double, q3 double")
    stats = local_table(df.sparkSession, stats, profile.schema)
    return stats.join(quartiles, "column").select(
        "column", (100 - _pct(F.col("nulls"), F.col("rows"))).alias("fill_pct"), "min", "max", "mean", "median", "std",
        "skewness", "kurtosis", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def distribution_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, std, skewness and nulls of one column."""
    median = quantiles(df, [column], [0.5])[column][0]
    return per_column(df, [column], ["mean", "std", "skewness", "nulls"]).select(
        "column", "mean", F.lit(median).cast("double").alias("median"), "std", "skewness", "nulls")


def table_kpis(df: DataFrame) -> DataFrame:
    """One row: rows, columns, nulls over all cells, duplicate rows."""
    nulls = per_column(df, None, ["nulls"]).agg(F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls")).first()["nulls"]
    return checks.duplicate_counts(df).select("rows", F.lit(len(df.columns)).alias("cols"),
                                              F.lit(nulls).cast("bigint").alias("nulls"), "duplicates")


def missing_summary(df: DataFrame) -> DataFrame:
    return per_column(df, None, ["rows", "nulls"]).select(
        "column", F.col("nulls").alias("missing"), _pct(F.col("nulls"), F.col("rows")).alias("missing_pct"),
        (F.col("rows") - F.col("nulls")).alias("present")).orderBy(F.desc("missing_pct"), "column")


def outlier_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: min, max, mean, std, IQR and the values outside the 1.5 IQR fences."""
    columns = numeric_columns(df) if columns is None else list(columns)
    q = {c: v for c, v in quantiles(df, columns, [0.25, 0.75]).items() if v[0] is not None}
    if not q:
        return local_table(df.sparkSession, [], "column string, min double, max double, mean double, std double, iqr double, outliers bigint")

    def outside(column: str):
        q1, q3 = q[column]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        return F.count_if((name(column) < lo) | (name(column) > hi))

    entries = [F.struct(F.lit(c).alias("column"), F.min(name(c)).cast("double").alias("min"),
                        F.max(name(c)).cast("double").alias("max"), F.avg(name(c)).cast("double").alias("mean"),
                        F.stddev(name(c)).alias("std"), F.lit(q[c][1] - q[c][0]).alias("iqr"),
                        outside(c).alias("outliers")) for c in q]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def column_stats(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Type, nulls, distinct values, mean and std of all columns, or of the first ``limit``."""
    columns = df.columns[:limit]
    kinds = local_table(df.sparkSession, [(c, type_of(df, c).simpleString()) for c in columns], "column string, dtype string")
    stats = per_column(df, columns, ["nulls", "mean", "std"])
    distinct = distinct_counts(df, [c for c in columns if c in atomic_columns(df)])
    return kinds.join(stats, "column").join(distinct, "column", "left").select(
        "column", "dtype", "nulls", "distinct_values", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Compact description ``(section, column, metric, value)``: shape, null shares, cardinality of
    text columns, range, mean and skew of numbers, and sample values."""
    nums, texts = numeric_columns(df), string_columns(df)
    stats = per_column(df, df.columns, ["rows", "nulls", "min", "max", "mean", "skewness"])

    def section(table: DataFrame, label: str, values: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in values.items()])
        return table.select(F.lit(label).alias("section"), "column", F.inline(pairs)).where("value is not null")

    null_pct = {"null_pct": _pct(F.col("nulls"), F.col("rows"), 1)}
    shape = stats.limit(1).select(F.lit(None).cast("string").alias("column"), "rows")
    out = section(shape, "shape", {"rows": F.col("rows"), "cols": F.lit(len(df.columns))})
    out = out.unionAll(section(stats, "nulls", null_pct))
    out = out.unionAll(section(distinct_counts(df, texts), "cardinality", {"distinct": F.col("distinct_values")})) if texts else out
    out = out.unionAll(section(stats.where(F.col("column").isin(nums)), "numbers", {
        "min": F.round("min", 4), "max": F.round("max", 4), "mean": F.round("mean", 4), "skew": F.round("skewness", 3)}))
    if texts:
        seeded = F.xxhash64("value", F.lit(1))
        rank = F.row_number().over(Window.partitionBy("column").orderBy(seeded, "value"))
        samples = value_counts(df, texts).withColumn("rank", rank).where("rank <= 5")
        out = out.unionAll(samples.select(F.lit("samples").alias("section"), "column",
                                          F.concat(F.lit("sample_"), F.col("rank").cast("string")).alias("metric"), "value"))
    return out


def real_types(df: DataFrame, minimum: float = 0.7) -> DataFrame:
    """``(column, real_type)``: numeric by type, or text whose real cells mostly parse as numbers."""
    texts = text_profile(df, None, ["real_number_share"])
    others = [(c, "numeric" if c in numeric_columns(df) else "text") for c in atomic_columns(df) if c not in string_columns(df)]
    kind = F.when(F.col("real_number_share") >= minimum, "numeric").otherwise("text")
    return texts.select("column", kind.alias("real_type")).unionAll(
        local_table(df.sparkSession, others, "column string, real_type string"))


def junk_scan(df: DataFrame) -> DataFrame:
    """``(column, word, count)``: cells of text columns that are a "no data" word."""
    columns = string_columns(df)
    if not columns:
        return local_table(df.sparkSession, [], "column string, word string, count bigint")
    word = lambda c: F.lower(text.strip(name(c)))
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), word(c).alias("word")) for c in columns]))
    return (df.select(cells).where(F.col("word").isin(fixed.JUNK_WORDS))
            .groupBy("column", "word").agg(F.count(F.lit(1)).alias("count")))


def impute_recommendations(df: DataFrame) -> DataFrame:
    """Per numeric column with gaps: mean, median, skewness, and the better fill of the two."""
    return impute_choices(df, 1.0)


# -- distributions ------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """``([group,] bin, low, high, count)`` over equal-width bins of the whole range."""
    bounds = df.agg(F.min(name(column)).cast("double").alias("lo"), F.max(name(column)).cast("double").alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        group = f"`group` {type_of(df, by).simpleString()}, " if by else ""
        return local_table(df.sparkSession, [], group + "bin bigint, low double, high double, count bigint")
    width = (hi - lo) / bins or 1.0
    bucket = F.least(F.floor((name(column).cast("double") - lo) / width), F.lit(bins - 1))
    keys = ([name(by).alias("group")] if by else []) + [bucket.alias("bin")]
    return (df.where(name(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
            .select(*(["group"] if by else []), "bin", (F.lit(lo) + F.col("bin") * width).alias("low"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "count"))


def density(df: DataFrame, column: str, by: str | None = None, grid: int = 50) -> DataFrame:
    """Shape of the distribution per group: a Gaussian kernel laid over the counts of ``grid`` equal bins.

    Each value counts at the middle of its bin. The bandwidth is ``1.06 * std * n ** -0.2`` of the group's values, at least
    half a bin; the density is told at the middle of every bin of the whole range.
    """
    binned = histogram(df, column, grid, by)
    groups = ["group"] if by else []
    key, v = [name(by).alias("group")] if by else [F.lit(1).alias("one")], name(column).cast("double")
    spread = df.where(name(column).isNotNull()).groupBy(*key).agg(F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("_std"))
    # At most ``grid`` bins meet in a group.
    held = binned.groupBy(*groups or [F.lit(1).alias("one")]).agg(
        F.sum("count").alias("_n"), F.collect_list(F.struct(((F.col("low") + F.col("high")) / 2).alias("at"), F.col("count").cast("double").alias("n"))).alias("_bins"),
        F.min("low").alias("_some"), F.min("bin").alias("_bin"), F.max(F.col("high") - F.col("low")).alias("_width"))
    width, origin = F.col("_width"), F.col("_some") - F.col("_bin") * F.col("_width")
    band = F.greatest(F.lit(1.06) * F.col("_std") * F.pow(F.col("_n"), F.lit(-0.2)), width / 2)
    on = F.col("h.group").eqNullSafe(F.col("s.group")) if by else F.col("h.one") == F.col("s.one")
    both = held.alias("h").join(spread.alias("s"), on).select(
        *[F.col(f"h.{c}") for c in groups], "_bins", "_n", "_width", "_some", "_bin", band.alias("_band"))
    rows = both.select(*groups, "_bins", "_n", "_band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid - 1).cast("bigint"))).alias("bin"), origin.alias("_origin"), "_width")
    rows = rows.withColumns({"low": F.col("_origin") + F.col("bin") * F.col("_width"), "high": F.col("_origin") + (F.col("bin") + 1) * F.col("_width")})
    middle = (F.col("low") + F.col("high")) / 2
    heap = F.aggregate("_bins", F.lit(0.0), lambda total, b: total + b["n"] * F.exp(-F.pow((middle - b["at"]) / F.col("_band"), F.lit(2.0)) / 2))
    return rows.select(*groups, "bin", "low", "high", (heap / (F.col("_n") * F.col("_band") * math.sqrt(2 * math.pi))).alias("density"))


def group_aggregate(df: DataFrame, x: str, y: str | None = None, fn: str = "count", n: int = 15) -> DataFrame:
    """``(x, value)``: the ``n`` largest groups; null groups are left out, ``count`` counts non-null ``y``."""
    rows = df.where(name(x).isNotNull())
    if fn == "median":
        grouped = grouped_quantiles(rows, [x], y, [0.5]).withColumnRenamed("q0", "value")
    else:
        build = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[fn]
        grouped = rows.groupBy(name(x)).agg(build(F.lit(1) if y is None else name(y)).alias("value"))
    return grouped.where("value is not null").orderBy(F.desc("value"), name(x)).limit(n)


def two_way_counts(df: DataFrame, a: str, b: str, n: int = 15) -> DataFrame:
    """Counts by ``(a, b)`` for the ``n`` most frequent values of ``a``."""
    counts = (df.where(name(a).isNotNull() & name(b).isNotNull()).groupBy(name(a), name(b))
              .agg(F.count(F.lit(1)).alias("count")))
    leaders = (df.where(name(a).isNotNull()).groupBy(name(a)).agg(F.count(F.lit(1)).alias("_n"))
               .orderBy(F.desc("_n"), name(a)).limit(n).drop("_n"))  # n rows
    return counts.join(F.broadcast(leaders), a, "left_semi")


def box_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Min, quartiles, max, mean, std, and whiskers: the extreme values inside the 1.5 IQR fences.

    Everything comes from the distinct values of each group and their counts.
    """
    key = name(by).cast("string") if by else F.lit("all")
    cells = df.select(key.alias("column"), name(column).cast("double").alias("value")).where("value is not null and `column` is not null")
    values = ranked_values(cells)
    means = values.groupBy("column").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    told = materialize(picked_quantiles(values, [0.25, 0.5, 0.75]).join(means, "column"), "quartiles")
    v, n, spread = F.col("value"), F.col("n"), 1.5 * (F.col("q2") - F.col("q0"))
    inside = F.when(v.between(F.col("q0") - spread, F.col("q2") + spread), v)
    return values.join(told, "column").groupBy(F.col("column").alias("group"), "q0", "q1", "q2", "mean").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.sqrt(F.sum(n * F.pow(v - F.col("mean"), F.lit(2))) / F.nullif(F.sum("n") - 1, F.lit(0))).alias("std"),
        F.min(inside).alias("low_whisker"), F.max(inside).alias("high_whisker"),
        F.coalesce(F.sum(F.when(inside.isNull(), n)), F.lit(0)).alias("outliers")).select(
        "group", "min", "low_whisker", F.col("q0").alias("q1"), F.col("q1").alias("median"),
        F.col("q2").alias("q3"), "high_whisker", "max", "mean", "std", "outliers")


def series(df: DataFrame, x: str, y: str, color: str | None = None, fn: str = "mean", grain: str = "month") -> DataFrame:
    """Line or area series: ``y`` aggregated per calendar ``grain`` (or exact ``x`` when it is not a date)."""
    point = F.date_trunc(grain, name(x)).cast("timestamp_ntz") if x in temporal_columns(df) else name(x)
    build = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[fn]
    keys = [point.alias("x")] + ([name(color).alias("color")] if color else [])
    out = df.where(name(x).isNotNull()).groupBy(*keys).agg(build(name(y)).alias("y"))
    return out.orderBy("x", *(["color"] if color else []))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over all rows: slope, intercept, r2, n."""
    a, b = name(x).cast("double"), name(y).cast("double")
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
                  F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def scatter_points(df: DataFrame, x: str, y: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """A sample of points to draw, the same for one layout of the table; the trend line uses all rows.

    Every row has a hash of its own, so points that repeat are drawn as often as they occur.
    """
    rows = df.where(name(x).isNotNull() & name(y).isNotNull()).select(name(x), name(y), F.monotonically_increasing_id().alias("_row"))
    return rows.orderBy(F.xxhash64("_row", F.lit(seed)), "_row").limit(n).drop("_row")


# -- rows -------------------------------------------------------------------------

def filter_rows(df: DataFrame, column: str, op: str, value, literal: bool = False) -> DataFrame:
    """``== != contains`` compare as text (``contains`` is a case-insensitive pattern, or plain text
    with ``literal``); ``> < >= <=`` compare as numbers and drop what is not a number."""
    c = name(column)
    dtype = type_of(df, column)
    words = c if isinstance(dtype, T.StringType) else c.cast("string")
    if op == "==":
        return df.where(words == str(value))
    if op == "!=":
        return df.where(~words.eqNullSafe(F.lit(str(value))))
    if op == "contains":
        if literal:
            return df.where(F.contains(F.lower(c.cast("string")), F.lit(str(value).lower())))
        return df.where(c.cast("string").rlike("(?i)" + str(value)))
    v = float(value)
    if isinstance(dtype, T.StringType):
        c = text.parse_number(c)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        df = df.where(~F.isnan(c))  # NaN counts as missing
    elif isinstance(dtype, T.NumericType):
        v = int(v) if v.is_integer() else v  # a whole number compares without a cast, so the scan can use it
    else:
        c = c.try_cast("double")
    return df.where({">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op])


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] | None = None) -> DataFrame:
    return (df.orderBy(*[name(c) for c in order_by]) if order_by else df).limit(n)


def compare_columns(df: DataFrame, column: str, change: Column, order_by: str, n: int = 8) -> DataFrame:
    """The first ``n`` values of a column beside what ``change`` makes of them."""
    return (df.orderBy(name(order_by)).limit(n)
            .select(name(order_by), name(column).cast("string").alias("original"), change.cast("string").alias("changed")))
