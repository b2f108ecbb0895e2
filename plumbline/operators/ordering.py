"""Order-dependent operators without a single-partition window.

The rows are range-partitioned on the order key and written once; every slice then
holds one contiguous run of rows. Windows run inside slices, and what must cross
from one slice to the next (a row offset, the last value seen) is one small row per
slice. Rows that tie on the whole order key are ordered by a hash of the row, and
identical rows are spread at random: their order cannot change a result, and a large
group of copies does not end up in one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import name, type_of
from plumbline.session import materialize

_SLICE, _HASH, _TIE, _POS, _OFFSET = "_slice", "_hash", "_tie", "_pos", "_offset"
_HELPERS = (_SLICE, _HASH, _TIE, _POS, _OFFSET)


def _as_columns(order_by: str | Column | Sequence[str | Column]) -> list[Column]:
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    if not keys:
        raise ValueError("an explicit order is required: tables have none of their own")
    return [name(k) if isinstance(k, str) else k for k in keys]


def _comparable(df: DataFrame, column: str) -> Column:
    return F.to_json(F.struct(name(column))) if "map<" in type_of(df, column).simpleString() else name(column)


def _sliced(df: DataFrame, order_by) -> DataFrame:
    """``df`` with a slice number, a position inside the slice and the slice's row offset."""
    order = _as_columns(order_by)
    total = [*order, F.col(_HASH), F.col(_TIE)]
    ranged = (df.withColumns({_HASH: F.xxhash64(*[_comparable(df, c) for c in df.columns]), _TIE: F.rand(7)})
              .repartitionByRange(*total)
              .withColumn(_SLICE, F.spark_partition_id()))
    ranged = materialize(ranged, "slices")
    placed = ranged.withColumn(_POS, F.row_number().over(Window.partitionBy(_SLICE).orderBy(*total)))
    # One row per slice: the running sum over slices is a window on that small table.
    sizes = ranged.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_SLICE, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias(_OFFSET))
    return placed.join(F.broadcast(offsets), _SLICE)


def global_index(df: DataFrame, order_by, alias: str = "row_index") -> DataFrame:
    """Exact 0-based position of every row under ``order_by``."""
    return (_sliced(df, order_by)
            .withColumn(alias, F.col(_OFFSET) + F.col(_POS) - 1)
            .drop(*_HELPERS))


def _seen(c: Column, position: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c.alias("v"), position.alias("p")))


def _neighbours(df: DataFrame, columns: Sequence[str], order_by, previous: bool, following: bool) -> DataFrame:
    """Add, per column, the nearest non-null cell at or before (``_prev_i``) and at or after
    (``_next_i``) each row, as ``struct(v, p)`` with ``p`` the global position."""
    rows = _sliced(df, order_by).withColumn("_at", F.col(_OFFSET) + F.col(_POS))
    cells = {f"_cell_{i}": _seen(name(c), F.col("_at")) for i, c in enumerate(columns)}
    rows = rows.withColumns(cells)
    carried, added = [], {}
    if previous:
        inside = Window.partitionBy(_SLICE).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        for i in range(len(columns)):
            carried.append(F.last(f"_last_{i}", ignorenulls=True).over(before).alias(f"_in_{i}"))
            added[f"_prev_{i}"] = F.coalesce(F.last(f"_cell_{i}", ignorenulls=True).over(inside), F.col(f"_in_{i}"))
    if following:
        inside = Window.partitionBy(_SLICE).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
        after = Window.orderBy(F.desc(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        for i in range(len(columns)):
            carried.append(F.last(f"_first_{i}", ignorenulls=True).over(after).alias(f"_out_{i}"))
            added[f"_next_{i}"] = F.coalesce(F.last(f"_cell_{i}", ignorenulls=True).over(inside), F.col(f"_out_{i}"))
    ends = []
    for i in range(len(columns)):
        ends.append(F.max_by(f"_cell_{i}", F.col(f"_cell_{i}.p")).alias(f"_last_{i}"))
        ends.append(F.min_by(f"_cell_{i}", F.col(f"_cell_{i}.p")).alias(f"_first_{i}"))
    edge = rows.groupBy(_SLICE).agg(*ends).select(_SLICE, *carried)  # one row per slice
    return rows.join(F.broadcast(edge), _SLICE).withColumns(added)


def fill_forward(df: DataFrame, columns: Sequence[str], order_by) -> DataFrame:
    """Carry the last non-null value down; leading gaps stay null."""
    rows = _neighbours(df, columns, order_by, previous=True, following=False)
    return _replace(df, rows, {c: F.col(f"_prev_{i}.v") for i, c in enumerate(columns)})


def fill_backward(df: DataFrame, columns: Sequence[str], order_by) -> DataFrame:
    """Carry the next non-null value up; trailing gaps stay null."""
    rows = _neighbours(df, columns, order_by, previous=False, following=True)
    return _replace(df, rows, {c: F.col(f"_next_{i}.v") for i, c in enumerate(columns)})


def interpolate(df: DataFrame, columns: Sequence[str], order_by) -> DataFrame:
    """Linear by row position between the neighbours; edges take the nearest value."""
    rows = _neighbours(df, columns, order_by, previous=True, following=True)
    values = {}
    for i, c in enumerate(columns):
        a, b = F.col(f"_prev_{i}"), F.col(f"_next_{i}")
        va, vb = a["v"].cast("double"), b["v"].cast("double")
        line = va + (vb - va) * (F.col("_at") - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0))
        values[c] = F.coalesce(name(c).cast("double"), line, va, vb)
    return _replace(df, rows, values)


def _replace(df: DataFrame, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    return rows.select(*[values[c].alias(c) if c in values else name(c) for c in df.columns])


def running_counts(values: DataFrame, alias: str = "before") -> DataFrame:
    """For a table ``(column, value, n)`` with one row per distinct value: the rows of the same
    column that come before each value. All columns are ordered in one range partitioning.

    A column is one run of rows, so only the one that a slice begins with goes on from the slice before: one
    row per slice carries its first and last column and what the last one has so far, however many columns there are.
    """
    ranged = materialize(values.repartitionByRange("column", "value").withColumn(_SLICE, F.spark_partition_id()), "slices")
    parts = ranged.groupBy(_SLICE, "column").agg(F.sum("n").alias("_size"))
    ends = materialize(parts.groupBy(_SLICE).agg(
        F.min("column").alias("_first"), F.max("column").alias("_last"), F.max_by("_size", "column").alias("_size")), "slice-ends")
    run = Window.partitionBy("_last").orderBy(_SLICE)
    previous = Window.orderBy(_SLICE)
    carried = (ends.withColumn("_upto", F.sum("_size").over(run))
               .select(_SLICE, "_first", F.lag("_last").over(previous).alias("_ended"), F.lag("_upto").over(previous).alias("_upto"))
               .select(_SLICE, "_first", F.when(F.col("_ended").eqNullSafe(F.col("_first")), F.col("_upto")).otherwise(0).alias(_OFFSET)))
    inside = Window.partitionBy(_SLICE, "column").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("column").eqNullSafe(F.col("_first")), F.col(_OFFSET)).otherwise(0)
    return (ranged.join(F.broadcast(carried), _SLICE)  # one row per slice
            .withColumn(alias, here + F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .drop(_SLICE, "_first", _OFFSET))


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` of all non-null cells; the columns must share one type."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), name(c).alias("value")) for c in columns])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull())


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, rank)`` for each distinct non-null value; ties share their mean rank.

    Equal values collapse to one row before anything is ordered, so a value that holds
    a third of the table costs no more than any other.
    """
    return counted_ranks(df, columns).drop("n")


def counted_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``average_ranks`` with the number of rows that hold each value, ``(column, value, n, rank)``."""
    counts = _cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return running_counts(counts).select("column", "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def dense_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, code)``: 0-based position of each distinct non-null value in sorted order."""
    values = _cells(df, columns).distinct().withColumn("n", F.lit(1))
    return running_counts(values).select("column", "value", F.col("before").alias("code"))
