"""Exact quantiles that never hold a whole column, or a whole group, in one task.

Equal values collapse to one row with a count, combined map-side. Those rows are ordered in one
range partitioning over all columns or groups, each learns how many rows come before it, and the
rows that hold the wanted ranks are picked. A value, column or group of any share of the table is
spread over many tasks, and the path is the same for every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.operators.ordering import running_counts
from plumbline.session import materialize


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of numeric columns, as plain numbers."""
    if not columns:
        return {}
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), name(c).cast("double").alias("value")) for c in columns])))
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for r in _ranked(cells, probs).collect():
        found[r["column"]] = [r[f"q{i}"] for i in range(len(probs))]
    return found


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles ``q0, q1, ...`` of ``value`` for every group of ``keys``; null is a group."""
    cells = df.select(F.struct(*[name(k) for k in keys]).alias("column"), name(value).cast("double").alias("value"))
    return _ranked(cells, probs).select("column.*", *[f"q{i}" for i in range(len(probs))])


def ranked_values(cells: DataFrame) -> DataFrame:
    """``column, value, n, before, until``: each distinct value with its rows and those up to it; nulls do not count."""
    counts = cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return materialize(running_counts(counts).withColumn("until", F.col("before") + F.col("n")), "ranks")


def _ranked(cells: DataFrame, probs: Sequence[float]) -> DataFrame:
    return picked_quantiles(ranked_values(cells), probs)


def picked_quantiles(ends: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``column, q0, q1, ...`` of ranked values."""
    totals = ends.groupBy("column").agg(F.max("until").alias("total"))
    picked = []
    for i, p in enumerate(probs):
        position = (F.col("total") - 1) * float(p)
        for end, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picked.append(F.max(F.when((F.col("before") <= rank) & (F.col("until") > rank), F.col("value"))).alias(f"{end}{i}"))
    found = ends.join(totals, "column").groupBy("column", "total").agg(*picked)
    spread = []
    for i, p in enumerate(probs):
        position = (F.col("total") - 1) * float(p)
        spread.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (position - F.floor(position))).alias(f"q{i}"))
    return found.select("column", *spread)
