"""What the operators share: writing intermediate tables, worker state, connected components."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.session import shared_path

_kept: dict[Hashable, Any] = {}


def stored(df: DataFrame, label: str, partition_by: str | None = None, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read back: later steps survive lost executors."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs started meanwhile send Python workers at most so many rows at once: whole texts are long."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def body(column: str) -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(name(column).cast("string"), F.lit(""))


def unused(df: DataFrame, column: str) -> str:
    """``column``, or a longer name if ``df`` has one of that name."""
    while column in df.columns:
        column += "_"
    return column


def once(key: Hashable, make: Callable[[], Any]) -> Any:
    """A value made once in a Python worker and kept for its later tasks."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` by the links ``a - b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:  # shorten chains
            shorter = new[new]
            if np.array_equal(shorter, new):
                break
            new = shorter
        if np.array_equal(new, root):
            return root
        root = new


def _fixed_point(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node that has an edge: the smallest node it can reach.

    Alternating large and small stars: each round hangs a node's neighbours on its smallest
    neighbour, until every component is one star. Round count grows with the logarithm of the
    component size. Minima are combined map-side, and both sides of each join are stored
    tables, so a hub that holds a third of all edges is split by the adaptive skew join.
    Self-edges, repeated edges and edges with a null end change nothing; no edges, no rows.
    """
    star = stored(edges.select(F.greatest(name(a), name(b)).alias("u"), F.least(name(a), name(b)).alias("v"))
                  .where(name(a).isNotNull() & name(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    seen = _fixed_point(star)
    while seen[0]:
        star = _small_star(_large_star(star))
        now = _fixed_point(star)
        if now == seen:
            break
        seen = now
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _hung(neighbours: DataFrame, label: str) -> DataFrame:
    """Every neighbour of a node beside the smallest of them and the node itself."""
    least = stored(neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{label}-min")
    return neighbours.join(least, "u")


def _large_star(star: DataFrame) -> DataFrame:
    both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = _hung(both, "large").where(F.col("v") > F.col("u"))
    return stored(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")


def _small_star(star: DataFrame) -> DataFrame:
    moved = (_hung(star, "small").where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    kept = star.groupBy("u").agg(F.min("v").alias("v"))
    return stored(moved.unionByName(kept).distinct(), "small")
