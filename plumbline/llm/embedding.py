"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the axis it then
points along, with its sign, is its hash. Two such hashes name a bucket, and a vector also visits
the buckets it was nearest to. Whoever meets in a bucket is compared exactly, in double precision.

Equal vectors are one class with a count. A pair that meets in several buckets is counted in the
first of them only, which both see from the hashes they carry, so no pairs leave a task: it reports
how many links each class has there, and a spanning forest. Buckets too full for one task are cut
into blocks, every block against every other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import name
from plumbline.llm.common import components, roots, stored

TABLES = 4                # independent hashings
HASHES = 2                # cross-polytope hashes that name a bucket
PROBES = 4                # buckets a vector is in per table, its own included
ROUNDS = 3                # of signs and Hadamard transform per rotation
ALTERNATIVES = 4          # axes considered per hash
BLOCK = 4_000             # vectors of one bucket that one task compares with each other
AT_ONCE = 512             # rows of a comparison at once
LARGE = 64                # rows from which a unit is compared by itself
PAIRS_AT_ONCE = 100_000   # pairs of smaller units compared at once
SEED = 17
UNIT = ("label", "dim", "table", "bucket", "low", "high")


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; keeps lengths."""
    n, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Per row and table the own bucket and then the nearest others: shape (rows, tables, probes).

    With fewer buckets than probes, -1 fills up.
    """
    n, dim = x.shape
    size = 1 << max(0, dim - 1).bit_length()
    padded = np.zeros((n, size))
    padded[:, :dim] = x
    random = np.random.default_rng([SEED, dim])
    out = np.full((n, tables, probes), -1, np.int64)
    for t in range(tables):
        codes, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            turned = padded
            for _ in range(ROUNDS):
                turned = _hadamard(turned * random.choice([-1.0, 1.0], size))
            axis = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :ALTERNATIVES]
            value = np.take_along_axis(turned, axis, 1)
            gap = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            codes = (codes[:, :, None] * (2 * size) + (2 * axis + (value < 0))[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + gap[:, None, :]).reshape(n, -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, :order.shape[1]] = np.take_along_axis(codes, order, 1)
    return out


def _unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squaring, so that nothing overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stored_as(classes: DataFrame) -> str:
    """Vectors travel as they are stored, floats in four bytes, and become unit vectors in double precision where they meet."""
    return "<f4" if isinstance(classes.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def _dealt(classes: DataFrame) -> DataFrame:
    """Every class at each of its buckets: ``label, dim, table, bucket, own, class, n, codes, vector``."""
    kind = _stored_as(classes)
    label_type = classes.schema["label"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            offsets = np.asarray(lists.offsets)
            values = lists.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for part in np.array_split(rows, -(-len(rows) // AT_ONCE)):
                    raw = values[(offsets[part][:, None] + np.arange(dim)).reshape(-1)]
                    unit = _unit_rows(raw, dim)
                    codes = buckets(unit)
                    n, tables, probes = codes.shape
                    row, table, probe = (i.reshape(-1) for i in np.indices(codes.shape))
                    there = codes.reshape(-1) >= 0
                    row, table, probe = row[there], table[there], probe[there]
                    carried = codes.astype("<i8")
                    columns = {
                        "label": batch["label"].take(pa.array(part[row])), "dim": pa.array(np.full(len(row), dim), pa.int32()),
                        "table": pa.array(table, pa.int32()), "bucket": pa.array(codes[row, table, probe], pa.int64()),
                        "own": pa.array(probe == 0), "class": batch["class"].take(pa.array(part[row])),
                        "n": batch["n"].take(pa.array(part[row])),
                        "codes": pa.array([carried[i].tobytes() for i in range(n)], pa.binary()).take(pa.array(row)),
                        "vector": pa.array([v.tobytes() for v in raw.reshape(n, dim).astype(kind)], pa.binary()).take(pa.array(row))}
                    yield pa.RecordBatch.from_pydict(columns)

    return classes.select("label", "embedding", "class", "n").mapInArrow(
        deal, f"label {label_type}, dim int, table int, bucket long, own boolean, class long, n long, codes binary, vector binary")


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row belongs to another unit than the row before."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in UNIT:
        codes = table[c].combine_chunks()
        codes = (codes.dictionary_encode().indices if c == "label" else codes).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _near_pairs(x: np.ndarray, own: np.ndarray, begin: np.ndarray, end: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit, the first at home, with a cosine of ``threshold`` or more. Those at
    home come first in a unit, so every pair has one row before the other."""
    size = end - begin
    for k in np.flatnonzero(size >= LARGE).tolist():
        unit = x[begin[k]:end[k]]
        homes = int(own[begin[k]:end[k]].sum())
        for at in range(0, homes, AT_ONCE):
            i, j = np.nonzero(unit[at:min(homes, at + AT_ONCE)] @ unit.T >= threshold)
            real = j > i + at
            yield i[real] + at + begin[k], j[real] + begin[k]
    last = np.repeat(np.where(size < LARGE, end, 0), size)
    first = np.flatnonzero(own & (last > np.arange(len(x)) + 1))
    for some in np.array_split(first, 1 + len(first) * LARGE // PAIRS_AT_ONCE):
        count = last[some] - some - 1
        i = np.repeat(some, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        yield i[near], j[near]


def _links(table: pa.Table, threshold: float, kind: str = "<f8") -> pa.Table:
    """Links found first in these whole units, which follow one another: ``class, links, root``."""
    begin = np.flatnonzero(_changes(table))
    end = np.append(begin[1:], table.num_rows)
    own, ids, n, mine, t = (table[c].to_numpy() for c in ("own", "class", "n", "mine", "table"))
    split = table["low"].to_numpy() != table["high"].to_numpy()
    codes = np.frombuffer(b"".join(table["codes"].to_pylist()), "<i8").reshape(len(ids), TABLES, PROBES)
    vectors, dims = table["vector"].to_pylist(), table["dim"].to_numpy()
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for dim in np.unique(dims).tolist():  # lengths come one after the other within a label
        kept = np.flatnonzero(dims == dim)
        x = _unit_rows(np.frombuffer(b"".join(vectors[k] for k in kept.tolist()), kind), dim)
        place = np.cumsum(dims == dim) - 1
        units = dims[begin] == dim
        for i, j in _near_pairs(x, own[kept], place[begin[units]], place[end[units] - 1] + 1, threshold):
            i, j = kept[i], kept[j]
            real = ~split[i] | (mine[i] != mine[j])   # blocks meet themselves in a unit of their own
            i, j = i[real], j[real]
            if not len(i):
                continue
            a, b, row = codes[i], codes[j], np.arange(len(i))
            meets = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
            first = meets.argmax(axis=1) == t[i]
            twice = (b[row, t[i], :1] == a[row, t[i]]).any(axis=1) & ~own[j]  # they also meet where the other is at home
            counted = first & (~twice | (ids[i] < ids[j]))
            np.add.at(links, i[counted], n[j[counted]])
            np.add.at(links, j[counted], n[i[counted]])
            root = roots(np.concatenate([i, np.arange(len(ids))]), np.concatenate([j, root]), len(ids))
    some = (links > 0) | (root != np.arange(len(ids)))
    return pa.table({"class": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()),
                     "root": pa.array(ids[root[some]], pa.int64())})


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows in tables that end where a unit ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_changes(table))[-1]) if table.num_rows else 0
        if last:
            yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def usable(embedding: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id",
                           vector_column: str = "embedding", label_column: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors are compared if their labels are equal and not null and they have the same length; those
    with a cosine of ``threshold`` or more that meet in a bucket link. Equal vectors always meet.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable,
    itself included, ``kept`` whether that is the row's own. Vectors that are null, empty, all zero
    or hold null or non-finite components link with nothing. Null ids count as larger than any
    other. Rows that repeat whole link like any equal vectors. Other columns are not read.
    """
    rows = stored(vectors.select(name(id_column).alias("vec_id"), name(label_column).alias("label"), name(vector_column).alias("embedding")), "vectors")
    classes = stored(rows.where(F.col("label").isNotNull() & usable(F.col("embedding"))).groupBy("label", "embedding").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    dealt, kind = _dealt(classes), _stored_as(classes)
    place = ["label", "dim", "table", "bucket"]
    full = stored(dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block)
                  .withColumn("blocks", F.ceil(F.col("rows") * 2 / block).cast("int")).drop("rows"), "full")
    units = dealt.join(full, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    units = (units.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("other", "blocks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            yield from _links(table, threshold, kind).to_batches()

    # Units are many and small: a task takes a run of them, whole, in order.
    together = units.repartition(*UNIT).sortWithinPartitions(*UNIT, F.desc("own"))
    found = stored(together.mapInArrow(compare, "class long, links long, root long"), "links")
    degree = found.groupBy("class").agg(F.sum("links").alias("links"))
    member = components(found, "class", "root").withColumnRenamed("node", "class")
    joined = stored(reduce(lambda a, b: a.join(b, "class", "left"), [degree, member], classes.drop("embedding", "label")).select(
        "class", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "class").alias("component")), "members")
    firsts = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = joined.join(firsts, "component").select("class", "n_links", "component_id")
    placed = stored(classes.select("label", "embedding", "class").join(told, "class").drop("class"), "told")
    linked = F.col("n_links").isNotNull()
    return rows.join(placed, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
