"""Audit, plan, clean, rescore, write: the whole job over one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.columns import normalise
from plumbline.operators import clean, prep, profile, score, similarity, validate
from plumbline.session import local_table, materialize
from plumbline.sources import files

# Distinct values of a column up to which an automatic plan merges spellings; beyond, values are
# names or codes that differ on purpose. ``similarity.fix_typos`` itself has no limit.
PLAN_TYPO_VALUES = 50
OPERATIONS = "position int, step string, fix string, status string, detail string"


@dataclass(frozen=True)
class Cleaned:
    table: DataFrame
    operations: DataFrame


def _fixes(skew_threshold: float, corr_threshold: float, order_by) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "duplicates": partial(clean.remove_duplicates, order_by=order_by),
        "empty_rows": clean.drop_empty_rows,
        "nulls": partial(clean.smart_impute, skew_threshold=skew_threshold),
        "outliers": clean.handle_outliers,
        "column_names": clean.clean_column_names,
        "string_quality": clean.standardize_strings,
        "date_formats": clean.fix_date_formats,
        "data_types": clean.fix_numeric_strings,
        "sparse_columns": clean.drop_sparse_columns,
        "constant_columns": clean.drop_constant_columns,
        "high_correlation": partial(clean.drop_highly_correlated, threshold=corr_threshold),
        "email_format": validate.validate_emails,
        "phone_format": validate.validate_phones,
        "test_data": validate.flag_test_data,
    }


def apply_plan(df: DataFrame, approved: Iterable[str], skew_threshold: float = 1.0, corr_threshold: float = 0.95,
               order_by=None, order: Sequence[str] = fixed.FIX_ORDER, typo_limit: int | None = PLAN_TYPO_VALUES) -> Cleaned:
    """Apply the approved fixes in their fixed order.

    Spellings are merged in columns of at most ``typo_limit`` distinct values (none: in all); the log names
    the columns that were left out for that.

    Gaps are filled before the sparse check, so a sparse column only goes when filling is
    not approved. Removing duplicates is the one fix that shuffles the table; its result
    is written once, so the statistics of the later fixes scan that table and do not
    repeat the shuffle. Typos join their corrections; all other fixes are row-local projections over literals.
    A fix that cannot apply to this table is logged as failed and skipped.
    """
    approved = set(approved)
    unknown = approved - set(order)
    if unknown:
        raise ValueError(f"no automatic fix for {sorted(unknown)}")
    fixes, log = _fixes(skew_threshold, corr_threshold, order_by), []
    for step in order:
        if step not in approved:
            continue
        fix = fixed_name(step)
        try:
            before, left_out = df.columns, []
            if step == "typos":
                df, left_out = similarity.fix_typos_within(df, typo_limit)
            else:
                df = fixes[step](df)
            if step == "duplicates":
                df = materialize(df, "deduplicated")
            gone = [c for c in before if c not in df.columns]
            new = [c for c in df.columns if c not in before]
            notes = [f"columns dropped {gone}, added {new}"] * bool(gone or new)
            notes += [f"skipped columns of more than {typo_limit} values: {', '.join(left_out)}"] * bool(left_out)
            log.append((len(log), step, fix, "applied", "; ".join(notes)))
        except (ValueError, AnalysisException) as problem:
            log.append((len(log), step, fix, "failed", str(problem)))
    return Cleaned(df, local_table(df.sparkSession, log, OPERATIONS))


def fixed_name(check: str) -> str | None:
    return next((c[3] for c in fixed.CHECKS if c[0] == check), None)


def guided_clean(df: DataFrame, approved: Iterable[str], junk_columns: Sequence[str] = (),
                 fills: Mapping[str, str] | None = None, features: Sequence[str] = (), **options) -> Cleaned:
    """The interactive order: junk words to null, number-like text to numbers, chosen fills,
    the plan with automatic filling off, then the approved features."""
    if junk_columns:
        df = clean.junk_to_null(df, junk_columns)
    df = clean.fill_columns(clean.coerce_numeric_text(df), fills or {})
    cleaned = apply_plan(df, set(approved) - {"nulls"}, **options)
    return Cleaned(prep.add_features(cleaned.table, features) if features else cleaned.table, cleaned.operations)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and columns removed, nulls fixed, duplicates removed, and both sides."""
    sides = [profile.table_kpis(side).select(*[F.col(c).cast("bigint").alias(f"{c}_{label}")
                                               for c in ("rows", "cols", "nulls", "duplicates")], F.lit(1).alias("one"))
             for label, side in (("before", before), ("after", after))]
    both = sides[0].join(sides[1], "one").drop("one")  # two one-row tables
    change = {"rows_removed": "rows", "cols_removed": "cols", "nulls_fixed": "nulls", "duplicates_removed": "duplicates"}
    return both.select(*[(F.col(f"{c}_before") - F.col(f"{c}_after")).alias(a) for a, c in change.items()], *both.columns)


def _sides(before: score.Audit, after: score.Audit) -> DataFrame:
    """What :func:`diff` reports, read from two audits that have counted it already."""
    spark, sides = before.findings.sparkSession, []
    for audit in (before, after):
        found = {(r["check"], r["metric"]): r["v"] for r in audit.findings.groupBy("check", "metric").agg(F.sum("value").alias("v")).collect()}
        sides.append([audit.rows, len(audit.columns), int(found.get(("nulls", "null_count"), 0)), int(found.get(("duplicates", "count"), 0))])
    names = ["rows", "cols", "nulls", "duplicates"]
    schema = [*[f"{c}_removed" if c != "nulls" else "nulls_fixed" for c in names], *[f"{c}_before" for c in names], *[f"{c}_after" for c in names]]
    row = [*[a - b for a, b in zip(*sides)], *sides[0], *sides[1]]
    return local_table(spark, [tuple(row)], ", ".join(f"{c} bigint" for c in schema))


@dataclass(frozen=True)
class Report:
    """``summary`` is one row; ``before`` and ``after`` are the two audits; ``trail`` holds the rows
    that went as duplicates."""

    table: DataFrame
    summary: DataFrame
    before: score.Audit
    after: score.Audit
    plan: DataFrame
    operations: DataFrame
    trail: DataFrame


def audit_and_clean(df: DataFrame, mode: str = "auto_all", corr_threshold: float = 0.95, skew_threshold: float = 1.0,
                    order_by=None, as_of: str | None = None) -> Report:
    """Audit, approve by ``mode``, clean, audit again with the same thresholds, compare.

    The cleaned table is written once; the second audit and the report read that.
    """
    df = normalise(df)
    before = score.audit(df, corr_threshold, as_of)
    plan = score.fix_plan(before.summary, mode)
    approved = score.approved_checks(plan)
    cleaned = apply_plan(df, approved, skew_threshold, before.corr_threshold, order_by)
    trail = clean.duplicate_trail(df, order_by) if "duplicates" in approved else df.limit(0)
    table = materialize(cleaned.table, "cleaned") if cleaned.table.columns else cleaned.table
    after = score.audit(table, before.corr_threshold, as_of)
    summary = _sides(before, after).withColumns({
        "health_before": F.lit(before.health_score), "health_after": F.lit(after.health_score),
        "improvement": F.lit(after.health_score - before.health_score),
        "grade_before": F.lit(before.health_grade), "grade_after": F.lit(after.health_grade)})
    return Report(table, summary, before, after, plan, cleaned.operations, trail)


def write_report(report: Report, path: str) -> dict[str, str]:
    """Write the cleaned table and, beside it as JSON, summary, the findings before and after, the plan,
    the operations, those that failed, and the rows dropped as duplicates."""
    stem = path.rsplit(".", 1)[0]
    written = {"table": files.save(report.table, path)}
    for label, table in (("summary", report.summary), ("findings", report.before.findings),
                         ("findings_after", report.after.findings), ("plan", report.plan),
                         ("operations", report.operations), ("errors", report.operations.where("status = 'failed'")),
                         ("dropped_duplicates", report.trail)):
        written[label] = files.save(table, f"{stem}_{label}.json")
    return written


def run(spark, path_in: str, path_out: str, mode: str = "auto_all", corr_threshold: float = 0.95,
        skew_threshold: float = 1.0, order_by=None, schema=None, read_options: Mapping | None = None) -> Report:
    """Read one file, audit and clean it, write the result and its report.

    ``read_options`` go to the reader: ``{"multi_line": False}`` lets large CSV files split.
    """
    report = audit_and_clean(files.read_table(spark, path_in, schema, **(read_options or {})), mode, corr_threshold, skew_threshold, order_by)
    write_report(report, path_out)
    return report
