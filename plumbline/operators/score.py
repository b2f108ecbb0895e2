"""From findings to severities, a health score, a fix plan and readable insights."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.columns import atomic_columns, numeric_columns
from plumbline.operators import checks, similarity
from plumbline.operators.metrics import TEXT_MEASURES, per_column, text_profile
from plumbline.session import local_table

AUDIT_THREADS = 4  # checks whose jobs may run side by side

# Checks whose severity rests on the sum of one metric; the others count columns.
_SUMMED = {"duplicates": "count", "empty_rows": "count", "nulls": "null_count", "outliers": "zscore_outliers",
           "email_format": "invalid", "phone_format": "invalid", "test_data": "count"}


def check_totals(findings: DataFrame) -> DataFrame:
    """``(check, total, columns)``: what each check found."""
    summed = reduce(lambda a, b: a | b, [(F.col("check") == k) & (F.col("metric") == m) for k, m in _SUMMED.items()])
    counted = ~F.col("check").isin(list(_SUMMED)) & (F.col("check") != "high_correlation")
    # One row per column and metric: one partition, no shuffle.
    return findings.where(F.col("metric") != checks.SKIPPED).coalesce(1).groupBy("check").agg(
        F.when(F.first("check").isin(list(_SUMMED)), F.coalesce(F.sum(F.when(summed, F.col("value"))), F.lit(0.0)))
        .when(F.first("check") == "high_correlation", F.count(F.lit(1)))
        .otherwise(F.countDistinct(F.when(counted, F.col("column")))).cast("bigint").alias("total"),
        F.countDistinct("column").alias("columns"))


def severity(check: Column, total: Column, rows: Column, cells: Column) -> Column:
    ratio = total / F.greatest(cells, F.lit(1))
    graded = (F.when(check == "nulls", F.when(ratio >= 0.15, "HIGH").when(ratio >= 0.05, "MEDIUM").otherwise("OK"))
              .when(total <= 0, "OK")
              .when((check == "duplicates") & (total >= rows * 0.1), "HIGH")
              .when((check == "empty_rows") & (total >= 10), "HIGH")
              .when((check == "outliers") & (total >= 50), "HIGH")
              .when(check.isin("sparse_columns", "email_format", "pii"), "HIGH")
              .otherwise("MEDIUM"))
    return graded


def summarise(findings: DataFrame, rows: int, n_columns: int) -> DataFrame:
    """One row per check: found, total, severity, the points it costs and its fix."""
    rules = local_table(findings.sparkSession, [(i, *c) for i, c in enumerate(fixed.CHECKS)],
        "position int, check string, label string, category string, fix_key string, high int, medium int")
    totals = check_totals(findings)
    graded = (rules.join(totals, "check", "left")
              .withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
              .withColumn("severity", severity(F.col("check"), F.col("total"), F.lit(rows), F.lit(rows * n_columns))))
    points = F.when(F.col("severity") == "HIGH", F.col("high")).when(F.col("severity") == "MEDIUM", F.col("medium"))
    return graded.select("position", "check", "label", "category", (F.col("total") > 0).alias("found"), "total",
                         F.coalesce("columns", F.lit(0).cast("bigint")).alias("columns"),
                         "severity", F.coalesce(points, F.lit(0)).alias("points"), "fix_key")


def grade(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for letter, lowest in fixed.GRADES:
        out = out.when(score >= lowest, letter)
    return out.otherwise("D")


def health(summary: DataFrame) -> DataFrame:
    """One row: health_score 0..100, grade, issues_found."""
    return (summary.agg(F.greatest(F.lit(0), F.lit(100) - F.sum("points")).cast("int").alias("health_score"),
                        F.count_if("found").alias("issues_found"))
            .withColumn("health_grade", grade(F.col("health_score"))))


@dataclass(frozen=True)
class Audit:
    """Result of an audit. The DataFrames are small: their size follows the schema."""

    rows: int
    columns: list[str]
    findings: DataFrame
    summary: DataFrame
    health_score: int
    health_grade: str
    issues_found: int
    corr_threshold: float


def audit(df: DataFrame, corr_threshold: float = 0.95, as_of: str | None = None, typo_threshold: float = 85,
          typo_limit: int | None = similarity.AUDIT_LIMIT) -> Audit:
    """Run all 17 checks in a fixed number of scans, whatever the number of columns.

    The per-column metrics are kept as a small local table (one row per column), so most
    of the 17 checks do not scan the input at all.
    """
    spark = df.sparkSession
    table = checks.row_counts(df)
    counts = local_table(spark, table.collect(), table.schema)
    plain = per_column(df, None, ["rows", "nulls", "mean", "std_pop", "boolean_pair"])
    # Numbers need no sketch: their deviation already tells constant columns apart.
    sketched = per_column(df, [c for c in atomic_columns(df) if c not in numeric_columns(df)], ["distinct_estimate"])
    sketched = local_table(spark, sketched.collect(), sketched.schema)
    estimates = {r["column"]: r["distinct_estimate"] for r in sketched.collect()}
    texts = text_profile(df, None, [m for m in TEXT_MEASURES if m not in ("date_share", "real_number_share")], estimates)
    profile = (plain.join(F.broadcast(texts.drop("position")), "column", "left")
               .join(F.broadcast(sketched.drop("position")), "column", "left"))
    metrics = local_table(spark, profile.collect(), profile.schema)
    parts = [
        checks.check_duplicates(df),
        checks.check_empty_rows(df, counts),
        checks.check_nulls(df, metrics),
        checks.check_outliers(df, metrics),
        checks.check_column_names(df),
        checks.check_string_quality(df, metrics),
        checks.check_date_formats(df, as_of),
        checks.check_data_types(df, metrics),
        checks.check_sparse_columns(df, metrics),
        checks.check_constant_columns(df, metrics),
        checks.check_high_correlation(df, corr_threshold, metrics),
        checks.check_mixed_types(df, metrics),
        checks.check_email_format(df),
        checks.check_phone_format(df),
        checks.check_test_data(df, counts),
        checks.check_typos(df, typo_threshold, typo_limit, estimates=estimates),
        checks.check_pii(df),
    ]
    # Independent small results: overlap their jobs. One row per column and metric in all.
    with ThreadPoolExecutor(AUDIT_THREADS) as pool:
        collected = list(pool.map(DataFrame.collect, parts))
    findings = local_table(spark, [row for part in collected for row in part], checks.FINDINGS)
    rows = counts.first()["rows"]
    summary = summarise(findings, rows, len(df.columns))
    summary = local_table(spark, summary.orderBy("position").collect(), summary.schema)
    score = health(summary).first()
    return Audit(rows, df.columns, findings, summary, score["health_score"], score["health_grade"],
                 score["issues_found"], corr_threshold)


# -- plans ----------------------------------------------------------------------

def fix_plan(summary: DataFrame, mode: str = "auto_all") -> DataFrame:
    """``(check, fix_key, approved)``: ``auto_all`` approves every automatic fix of something
    found, ``auto_high`` only the HIGH ones."""
    approved = (F.col("category") == "A") & F.col("found") & F.col("fix_key").isNotNull()
    if mode == "auto_high":
        approved = approved & (F.col("severity") == "HIGH")
    elif mode != "auto_all":
        raise ValueError(f"unknown mode {mode!r}")
    return summary.select("position", "check", "fix_key", approved.alias("approved"))


def default_plan(summary: DataFrame) -> DataFrame:
    """The cautious plan: what was found and is HIGH, manual checks left out."""
    manual = F.col("check").isin("pii", "mixed_types", "schema_issues")
    return summary.where(~manual).select(
        "position", "check", "fix_key", (F.col("found") & (F.col("severity") == "HIGH")).alias("approved"))


def approved_checks(plan: DataFrame) -> set[str]:
    return {r["check"] for r in plan.where("approved").collect()}


# -- reading the findings -------------------------------------------------------

def impact_class(column: Column) -> Column:
    """Which business area a gap in this column hurts, from the words in its name."""
    out = F.when(F.lit(False), "")
    for area, words in fixed.IMPACT_CLASSES:
        out = out.when(F.lower(column).rlike("|".join(words)), area)
    return out.otherwise("other")


def _position(columns: list[str], column: str) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(column))


def insights(findings: DataFrame, columns: list[str], outliers: int | None = None, pairs: int | None = None) -> DataFrame:
    """Plain recommendations, most severe first: ``(severity, rule, column, value, impact)``.

    All outlier columns and correlated pairs are reported, or the first ``outliers`` and ``pairs``
    in the order of ``columns``, the schema.
    """
    def first(rows: DataFrame, n: int | None, *order: Column) -> DataFrame:
        return rows if n is None else rows.orderBy(*order).limit(n)

    f = findings
    value = F.col("value")

    def rule(condition: Column, label: str, level: Column, impact: Column) -> DataFrame:
        return f.where(condition).select(level.alias("severity"), F.lit(label).alias("rule"), "column",
                                         value.alias("value"), impact.alias("impact"))

    is_ = lambda check, metric: (F.col("check") == check) & (F.col("metric") == metric)
    parts = [
        rule(is_("nulls", "null_pct") & (value >= 10), "gap",
             F.when(value >= 30, "HIGH").otherwise("MEDIUM"),
             F.when(value >= 30, impact_class(F.col("column"))).otherwise("averages")),
        rule(is_("duplicates", "pct") & (value > 0), "duplicates",
             F.when(value > 5, "HIGH").otherwise("MEDIUM"), F.lit("totals")),
    ]
    single = [("sparse_columns", "null_pct", "sparse", "MEDIUM", "noise"),
              ("typos", "similar_values", "typos", "MEDIUM", "segments"),
              ("pii", "pii_name", "pii", "HIGH", "privacy")]
    for check, metric, label, level, impact in single:
        hit = f.where(is_(check, metric)).agg(F.count(F.lit(1)).cast("double").alias("value")).where(value > 0)
        parts.append(hit.select(F.lit(level).alias("severity"), F.lit(label).alias("rule"),
                                F.lit(None).cast("string").alias("column"), "value", F.lit(impact).alias("impact")))
    far = first(f.where(is_("outliers", "zscore_outliers")), outliers, _position(columns, "column"))
    parts.append(far.select(F.lit("MEDIUM").alias("severity"), F.lit("outliers").alias("rule"), "column",
                                 "value", F.lit("anomalies").alias("impact")))
    pair = first(f.where(F.col("check") == "high_correlation"), pairs,
                 _position(columns, "column"), _position(columns, "metric"))
    parts.append(pair.select(F.lit("LOW").alias("severity"), F.lit("correlated").alias("rule"),
                             F.concat_ws(" ~ ", "column", "metric").alias("column"), "value",
                             F.lit("multicollinearity").alias("impact")))
    found = reduce(DataFrame.unionByName, parts)
    none = (found.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
            .select(F.lit("LOW").alias("severity"), F.lit("none").alias("rule"),
                    F.lit(None).cast("string").alias("column"), F.lit(0.0).alias("value"),
                    F.lit("ready").alias("impact")))
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return found.unionByName(none).orderBy(rank, "rule", "column")


def digest(findings: DataFrame, summary: DataFrame, columns: list[str], worst: int | None = None) -> DataFrame:
    """Compact report: per check its total, its affected columns, the emptiest columns and the pairs,
    all or the first ``worst``."""
    detail = findings.where(((F.col("check") == "nulls") & (F.col("metric") == "null_pct"))
                            | (F.col("check") == "high_correlation"))
    first = F.when(F.col("check") == "nulls", -F.col("value")).otherwise(_position(columns, "column"))
    entry = F.struct(first.alias("first"), _position(columns, "metric").alias("second"), "column")
    top = (detail.groupBy("check").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, worst or 2**31 - 1).alias("t"))
        .select("check", F.array_join(F.transform("t", lambda t: t["column"]), ",").alias("worst")))
    return summary.join(top, "check", "left").select(
        "check", "label", "category", "found", "severity", "total", "columns", F.coalesce("worst", F.lit("")).alias("worst"))


def severity_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("severity").agg(F.count(F.lit(1)).alias("checks"))


def issue_table(summary: DataFrame) -> DataFrame:
    kind = F.when(F.col("category") == "A", "Auto-fix").otherwise("Manual")
    return summary.select("label", "severity", "found", kind.alias("category"), "fix_key")
