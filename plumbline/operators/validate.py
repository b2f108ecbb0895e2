"""Validation: formats, ranges, dates, keys."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed, text
from plumbline.functions.columns import atomic_columns, columns_named, name, type_of
from plumbline.operators import checks


def _flag_or_drop(df: DataFrame, tests: Mapping[str, Column], action: str, suffix: str) -> DataFrame:
    if action == "flag":
        return df.withColumns({f"{c}{suffix}": test for c, test in tests.items()}) if tests else df
    if action == "drop":
        return df.where(reduce(lambda a, b: a & b, tests.values(), F.lit(True)))
    raise ValueError(f"unknown action {action!r}")


def _matching(df: DataFrame, words: list[str], pattern: str) -> dict[str, Column]:
    return {c: F.coalesce(name(c).cast("string").rlike(pattern), F.lit(False))
            for c in columns_named(atomic_columns(df), words)}


def validate_emails(df: DataFrame, action: str = "flag") -> DataFrame:
    """Flag each email column in ``<column>_valid``, or keep only rows with valid ones; null is invalid."""
    return _flag_or_drop(df, _matching(df, fixed.EMAIL_WORDS, fixed.EMAIL_PATTERN), action, "_valid")


def validate_phones(df: DataFrame, action: str = "flag") -> DataFrame:
    return _flag_or_drop(df, _matching(df, fixed.PHONE_WORDS, fixed.PHONE_PATTERN), action, "_valid")


def validate_ranges(df: DataFrame, rules: Mapping[str, tuple]) -> DataFrame:
    """Distinct rows that break any ``{column: (low, high)}`` rule; nulls pass."""
    broken = [(name(c) < lo) | (name(c) > hi) for c, (lo, hi) in rules.items() if c in df.columns]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(b, F.lit(False)) for b in broken], F.lit(False))).distinct()


def validate_no_future_dates(df: DataFrame, column: str, as_of: str | None = None) -> DataFrame:
    """Parse the column and add ``<column>_is_future``; ``as_of`` fixes "now". A column that cannot hold
    dates, such as a number, stays as it is and is never in the future."""
    if not text.may_hold_dates(type_of(df, column)):
        return df.withColumn(f"{column}_is_future", F.lit(False))
    parsed = text.parse_timestamp(name(column), type_of(df, column), text.date_formats(df, [column]).get(column))
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    return (df.withColumn(column, parsed)
            .withColumn(f"{column}_is_future", F.coalesce(name(column) > now, F.lit(False))))


def validate_foreign_keys(df: DataFrame, column: str, valid: DataFrame, action: str = "flag",
                          valid_column: str | None = None) -> DataFrame:
    """Membership of ``column`` in a table of valid values: flag in ``<column>_valid_fk``, or drop the rest.

    The valid values are made distinct first, so the join cannot multiply rows. AQE
    broadcasts them when they are small and splits a hot key when they are not.
    """
    type_of(df, column)
    keys = valid.select(name(valid_column or valid.columns[0]).alias("_fk")).where("_fk is not null").distinct()
    if action == "drop":
        return df.join(keys, name(column) == F.col("_fk"), "left_semi")
    if action != "flag":
        raise ValueError(f"unknown action {action!r}")
    return (df.join(keys, name(column) == F.col("_fk"), "left")
            .withColumn(f"{column}_valid_fk", F.col("_fk").isNotNull()).drop("_fk"))


def check_referential_integrity(referenced: DataFrame, key: str, referencing: DataFrame, foreign_key: str) -> DataFrame:
    """Distinct non-null foreign keys without a matching key. Both sides are made distinct
    before the anti-join, so a hot key is one row by then."""
    known = referenced.select(name(key).alias("_key")).where("_key is not null").distinct()
    used = referencing.select(name(foreign_key).alias("missing")).where("missing is not null").distinct()
    return used.join(known, F.col("missing") == F.col("_key"), "left_anti")


def flag_test_data(df: DataFrame) -> DataFrame:
    return df.withColumn("is_test_data", checks.test_row(df))
