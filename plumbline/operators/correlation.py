"""Correlation matrices: Pearson, Spearman and Kendall, pairwise complete."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import name, numeric_columns, unused
from plumbline.operators.metrics import per_column
from plumbline.operators.ordering import counted_ranks, running_counts
from plumbline.session import local_table, materialize

PAIRS_PER_PASS = 400
PAIRS = "col_a string, col_b string, r double"
ROWS_PER_TASK = 250_000  # rows whose cells a task folds back
FREQUENT = 100_000       # cells that share a value; beyond, their rank is broadcast to them,
FREQUENT_VALUES = 10_000 # of which there are no more than this


def _pair_correlations(df: DataFrame, columns: Sequence[str], centre: Mapping[str, float], scale: Mapping[str, float]) -> DataFrame:
    """Correlation of every pair whose columns both have a scale, null for the others.

    One scan unfolds each row to its column pairs, centred and scaled so that plain sums
    stay accurate, and averages their products by pair over the rows where both cells are
    present. It combines map-side to one row a pair.
    """
    pairs = [(i, a, b) for i, (a, b) in enumerate(combinations(columns, 2))]
    names = local_table(df.sparkSession, pairs, "i int, col_a string, col_b string")
    live = [(i, a, b) for i, a, b in pairs if scale.get(a) and scale.get(b)]
    if not live:
        return names.select("col_a", "col_b", F.lit(None).cast("double").alias("r"))
    at = {c: f"s{i}" for i, c in enumerate(columns)}
    used = {c for _, a, b in live for c in (a, b)}
    rows = df.select(*[((name(c).cast("double") - centre[c]) / scale[c]).alias(at[c]) for c in columns if c in used])
    x, y = F.col("x"), F.col("y")
    moments = None
    for start in range(0, len(live), PAIRS_PER_PASS):
        entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(at[a]).alias("x"), F.col(at[b]).alias("y"))
                            for i, a, b in live[start:start + PAIRS_PER_PASS]])
        part = (rows.select(F.inline(entries)).where(x.isNotNull() & y.isNotNull()).groupBy("i")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"),
                     F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))  # one count, where five averages would keep one each
                .select("i", *[(F.col(c) / F.col("n")).alias(c) for c in ("x", "y", "xx", "yy", "xy")]))
        moments = part if moments is None else moments.unionAll(part)
    vx, vy = F.col("xx") - x * x, F.col("yy") - y * y
    varied = (vx > F.col("xx") * 1e-12) & (vy > F.col("yy") * 1e-12)
    r = F.when(varied, (F.col("xy") - x * y) / F.sqrt(vx * vy))
    return names.join(F.broadcast(moments), "i", "left").select("col_a", "col_b", r.alias("r"))  # one row a pair


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """``(col_a, col_b, r)`` for every column pair; null when one side has no variance.
    Means and deviations come from one scan, or from ``metrics`` where it is known."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if len(columns) < 2:
        return local_table(df.sparkSession, [], PAIRS)
    stats = per_column(df, columns, ["mean", "std_pop"]) if metrics is None else metrics
    stats = {r["column"]: r for r in stats.collect()}
    return _pair_correlations(df, columns, {c: stats[c]["mean"] for c in columns}, {c: stats[c]["std_pop"] for c in columns})


def _ranked_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` without nulls, every cell replaced by its average rank.

    All cells fetch their rank in one join and are folded back by row, so the exchanges do not grow with the columns. A
    task folds the same number of rows in tables of any size, and the cells of a frequent value do not meet in one task.
    """
    row = unused(columns, "_row")
    numbers = materialize(df.select(*[name(c).cast("double").alias(c) for c in columns], F.monotonically_increasing_id().alias(row)), "numbers")
    n = numbers.count()
    ranks = materialize(counted_ranks(numbers, columns), "ranks")
    cells = numbers.select(name(row).alias("row"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), name(c).alias("value")) for c in columns])))
    frequent = F.col("n") > max(FREQUENT, n * len(columns) // FREQUENT_VALUES)
    told = cells.join(F.broadcast(ranks.where(frequent).drop("n")), ["column", "value"], "left")  # at most FREQUENT_VALUES
    rest = told.where("rank is null").drop("rank").join(ranks.where(~frequent).drop("n"), ["column", "value"])
    ranked = told.where("rank is not null").unionByName(rest).select("row", "column", "rank")
    return ranked.repartition(1 + n // ROWS_PER_TASK, "row").groupBy("row").agg(
        *[F.max(F.when(F.col("column") == c, F.col("rank"))).alias(c) for c in columns])


def _rank_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson on average ranks of columns without nulls; ranks have a known centre and range."""
    n = df.count()
    return _pair_correlations(_ranked_rows(df, columns), columns, {c: (n + 1) / 2 for c in columns}, {c: float(n) for c in columns})


def _points(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(i, x, y, w)``: how many rows hold both values of pair ``i``, for all pairs at once."""
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        entries = F.array(*[F.struct(F.lit(i).alias("i"), name(a).cast("double").alias("x"), name(b).cast("double").alias("y"))
                            for i, (a, b) in enumerate(pairs[start:start + PAIRS_PER_PASS], start)])
        parts.append(df.select(F.inline(entries)).where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    cells = reduce(DataFrame.unionAll, parts)
    return materialize(cells.groupBy("i", "x", "y").agg(F.count(F.lit(1)).alias("w")), "points")


def _sides(points: DataFrame) -> DataFrame:
    """``(column, value, n)`` of both sides of every pair; ``column`` is the pair and the side."""
    both = F.array(*[F.struct(F.struct("i", F.lit(side).alias("side")).alias("column"), F.col(side).alias("value"), F.col("w").alias("n"))
                     for side in ("x", "y")])
    return points.select(F.inline(both)).groupBy("column", "value").agg(F.sum("n").alias("n"))


def _looked_up(points: DataFrame, values: DataFrame, found: str) -> DataFrame:
    """``points`` with ``found`` of each side's value, as ``<found>_x`` and ``<found>_y``."""
    for side in ("x", "y"):
        of_side = values.where(F.col("column.side") == side).select(
            F.col("column.i").alias("i"), F.col("value").alias(side), F.col(found).alias(f"{found}_{side}"))
        points = points.join(of_side, ["i", side])
    return points


def _pair_rank_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Each pair ranked on the rows where both its cells are present; all pairs in the same jobs."""
    points = _points(df, pairs)
    placed = materialize(running_counts(_sides(points)).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2), "ranks")
    sizes = points.groupBy("i").agg(F.sum("w").alias("m"))
    ranked = _looked_up(points, placed, "rank").join(F.broadcast(sizes), "i")  # one row a pair
    x, y = [(F.col(f"rank_{side}") - (F.col("m") + 1) / 2) / F.col("m") for side in ("x", "y")]
    sums = ranked.groupBy("i").agg(F.sum(F.col("w") * x * x).alias("xx"), F.sum(F.col("w") * y * y).alias("yy"), F.sum(F.col("w") * x * y).alias("xy"))
    r = F.when((F.col("xx") > 1e-12) & (F.col("yy") > 1e-12), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    names = local_table(df.sparkSession, [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, col_a string, col_b string")
    return names.join(F.broadcast(sums), "i", "left").select("col_a", "col_b", r.alias("r"))


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson on average ranks. Columns without nulls are ranked once; a pair with nulls is
    ranked on the rows where both cells are present."""
    columns = numeric_columns(df) if columns is None else list(columns)
    df = df.select(*[name(c) for c in columns])
    holes = {r["column"] for r in per_column(df, columns, ["nulls"]).where("nulls > 0").collect()}
    full = [c for c in columns if c not in holes]
    out = local_table(df.sparkSession, [], PAIRS)
    if len(full) > 1:
        out = out.unionAll(_rank_correlations(df, full))
    gappy = [(a, b) for a, b in combinations(columns, 2) if a in holes or b in holes]
    return out.unionAll(_pair_rank_correlations(df, gappy)) if gappy else out


def kendall_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """tau-b of every pair without comparing row pairs; all pairs in the same jobs.

    Values become dense codes written in base 4. Two points that differ in both codes
    first differ at one digit of each; there they share a cell (digit levels, code
    prefixes). Counting a 4 x 4 table per cell therefore counts every concordant and
    every discordant pair exactly once. The table is a plain grouped sum with map-side
    combine, over rows x digits of a x digits of b.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return local_table(df.sparkSession, [], PAIRS)
    points = _points(df, pairs)
    sides = materialize(_sides(points), "sides")
    codes = materialize(running_counts(sides.select("column", "value", F.lit(1).alias("n")), "code").drop("n"), "codes")
    top = {r["side"]: r["m"] for r in codes.groupBy(F.col("column.side").alias("side")).agg(F.max("code").alias("m")).collect()}
    levels = [max(1, math.ceil(math.log(top.get(side, 0) + 1, 4))) for side in ("x", "y")]
    cells = (_looked_up(points, codes, "code").withColumn("lx", F.explode(F.sequence(F.lit(0), F.lit(levels[0] - 1))))
             .withColumn("ly", F.explode(F.sequence(F.lit(0), F.lit(levels[1] - 1))))
             .select("i", "lx", "ly", "w",
                     F.expr("code_x div cast(power(4, lx + 1) as bigint)").alias("px"),
                     F.expr("code_y div cast(power(4, ly + 1) as bigint)").alias("py"),
                     F.expr("code_x div cast(power(4, lx) as bigint) % 4").alias("dx"),
                     F.expr("code_y div cast(power(4, ly) as bigint) % 4").alias("dy")))
    table = cells.groupBy("i", "lx", "ly", "px", "py").agg(*[
        F.sum(F.when((F.col("dx") == i) & (F.col("dy") == j), F.col("w")).otherwise(0))
        .cast("decimal(19,0)").alias(f"c{i}{j}") for i in range(4) for j in range(4)])

    def crossing(ordered: bool) -> Column:
        total = F.lit(0).cast("decimal(38,0)")
        for i in range(3):
            for j in range(4):
                rest = [F.col(f"c{k}{m}") for k in range(i + 1, 4) for m in range(4)
                        if (m > j if ordered else m < j)]
                if rest:
                    total = total + (F.col(f"c{i}{j}") * sum(rest[1:], rest[0])).cast("decimal(38,0)")
        return total

    crossed = table.groupBy("i").agg(F.sum(crossing(True)).cast("double").alias("concordant"),
                                     F.sum(crossing(False)).cast("double").alias("discordant"))
    n = F.col("n").cast("decimal(19,0)")
    tied = sides.groupBy(F.col("column.i").alias("i")).agg(*[
        (F.sum(F.when(F.col("column.side") == side, (n * (n - 1)).cast("decimal(38,0)"))) / 2).cast("double").alias(f"t{side}")
        for side in ("x", "y")], F.sum(F.when(F.col("column.side") == "x", F.col("n"))).cast("double").alias("n"))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    spread = F.sqrt(n0 - F.col("tx")) * F.sqrt(n0 - F.col("ty"))
    names = local_table(df.sparkSession, [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, col_a string, col_b string")
    # One row a pair.
    return names.join(F.broadcast(crossed), "i", "left").join(F.broadcast(tied), "i", "left").select(
        "col_a", "col_b", F.try_divide(F.col("concordant") - F.col("discordant"), F.nullif(spread, F.lit(0.0))).alias("r"))


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Upper triangle ``(col_a, col_b, r)``; ``method`` is pearson, spearman or kendall."""
    return {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs}[method](df, columns)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """The whole matrix in long form, diagonal included."""
    columns = numeric_columns(df) if columns is None else list(columns)
    upper = correlation_pairs(df, columns, method).select(F.inline(F.array(
        F.struct("col_a", "col_b", "r"),
        F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.col("r")))))
    spread = per_column(df, columns, ["constant"])
    diagonal = spread.select(F.col("column").alias("col_a"), F.col("column").alias("col_b"),
                             F.when(~F.col("constant"), F.lit(1.0)).alias("r"))
    return upper.unionAll(diagonal)


def top_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", n: int = 10) -> DataFrame:
    pairs = correlation_pairs(df, columns, method).where(F.col("r").isNotNull())
    return pairs.orderBy(F.desc(F.abs("r")), "col_a", "col_b").limit(n)


def high_pairs(df: DataFrame, threshold: float = 0.95, columns: Sequence[str] | None = None,
               metrics: DataFrame | None = None) -> DataFrame:
    return pearson_pairs(df, columns, metrics).where(F.abs("r") > threshold)
