"""Shards of nearly equal bytes by sampled splitters; DataFrame functions only.

Keys are drawn with a chance in proportion to their record's size, so equal steps through the
sorted draw are nearly equal steps through the bytes. The draw gives splitters, the splitters
ranges of records, and a range that turns out overfull gets splitters of its own. Inside a range
of bounded size a running sum places each record exactly; a shard is an equal share of the whole
run of bytes, cut at records.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.llm.common import stored

RANGE_ROWS = 50_000       # records a range should hold
RANGES = 16_384           # ranges the driver and a plan hold splitters of; beyond, ranges hold more records and their sorts spill
PER_SHARD = 4             # least number of ranges per shard
DRAWN = 16                # keys drawn per range
FULL = 2                  # times its share beyond which a range is divided further

Key = tuple[int, int, int]


def _key() -> Column:
    """Null ids first; rows that share an id are told apart, so any range can be divided."""
    return F.struct(F.col("_key").isNotNull().cast("int").alias("known"), F.coalesce("_key", F.lit(0)).cast("long").alias("id"), F.col("_row").alias("row"))


def _literal(keys: list[Key]) -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('known', {a}, 'id', {b}L, 'row', {c}L)" for a, b, c in keys) + ")")


def _numbers(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def _range(splitters: list[Key]) -> Column:
    """How many splitters are at or below the key, by a search over every n-th and then the next n."""
    if not splitters:
        return F.lit(0)
    step = math.isqrt(len(splitters)) + 1
    every, key = splitters[step::step], F.col("_at")
    block = F.size(F.filter(_literal(every), lambda s: s <= key)) if every else F.lit(0)
    return block * step + F.size(F.filter(F.slice(_literal(splitters), block * step + 1, F.lit(step)), lambda s: s <= key))


def _draw(rows: DataFrame, step: float, salt: int) -> list[tuple[Key, float]]:
    """Keys drawn about once per ``step`` bytes, sorted, each with the bytes it stands for."""
    luck = F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(luck * step < F.col("_size")).select(_key().alias("k"), "_size").collect()
    return sorted(((r["k"]["known"], r["k"]["id"], r["k"]["row"]), max(float(r["_size"]), step)) for r in drawn)


def _quantiles(drawn: list[tuple[Key, float]], parts: int) -> list[Key]:
    share, upto, out = sum(w for _, w in drawn) / max(parts, 1), 0.0, []
    for key, weight in drawn:
        if upto >= share * (len(out) + 1) and len(out) < parts - 1:
            out.append(key)
        upto += weight
    return out


def shard(records: DataFrame, shards: int, key_column: str, size_column: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``records`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (from 0 without a gap in its shard).

    Records follow ascending key, which must be an integer; null keys come first, rows with one key
    in no fixed order. A record is in the shard in whose equal share of all bytes it begins, so
    shards differ by less than two records. A null or negative size counts as 0; if all are 0,
    records count instead. Fewer records than shards leave some empty; no records, no rows. Columns
    ``shard`` and ``slot`` of the input are replaced.
    """
    kept = [c for c in records.columns if c not in ("shard", "slot")]
    rows = stored(records.select(
        F.struct(*[name(c) for c in kept]).alias("record"), F.monotonically_increasing_id().alias("_row"),
        name(key_column).cast("long").alias("_key"),
        F.greatest(F.coalesce(name(size_column).cast("long"), F.lit(0)), F.lit(0)).alias("_size")), "records")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    if not total:
        rows, total = rows.withColumn("_size", F.lit(1).cast("long")), n
    ranges = max(PER_SHARD * shards, min(RANGES, -(-n // range_rows)))
    splitters, stats = _splitters(rows, n, total, ranges)
    ranged = rows.withColumn("_at", _key()).withColumn("_range", _range(splitters))
    bytes_before, rows_before, b, r = [], [], 0, 0
    for k in range(len(splitters) + 1):
        bytes_before.append(b)
        rows_before.append(r)
        size, count, _ = stats.get(k, (0, 0, 0))
        b, r = b + size, r + count
    before = Window.partitionBy("_range").orderBy("_at")
    begins = F.element_at(_numbers(bytes_before), F.col("_range") + 1) + F.sum("_size").over(before) - F.col("_size")
    index = F.element_at(_numbers(rows_before), F.col("_range") + 1) + F.row_number().over(before) - 1
    share = F.least(F.floor(begins.cast("decimal(38,0)") * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    placed = stored(ranged.select("record", share.alias("shard"), index.alias("_index")), "placed")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("_index").alias("first")).collect()}
    starts = _numbers([first.get(k, 0) for k in range(shards)])
    return placed.select("record.*", "shard", (F.col("_index") - F.element_at(starts, F.col("shard") + 1)).alias("slot"))


def _splitters(rows: DataFrame, n: int, total: int, ranges: int) -> tuple[list[Key], dict[int, tuple[int, int, int]]]:
    """Splitters and, per range, its bytes, rows and largest record. What the driver holds grows with
    the number of ranges only, and that is bounded."""
    splitters = _quantiles(_draw(rows, max(total, 1) / (ranges * DRAWN), 0), ranges)
    share, row_share, salt = max(total, 1) / ranges, max(1.0, n / ranges), 0
    while True:
        found = rows.withColumn("_at", _key()).withColumn("_range", _range(splitters)).groupBy("_range").agg(
            F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows"), F.max("_size").alias("largest")).collect()
        stats = {r["_range"]: (r["size"], r["rows"], r["largest"]) for r in found}
        full = [k for k, (size, count, largest) in stats.items()
                if count > 1 and (size - largest > FULL * share or count > 8 * FULL * row_share)]
        if not full:
            return splitters, stats
        salt += 1
        inside = rows.withColumn("_at", _key()).where(_range(splitters).isin(full))
        if any(stats[k][0] - stats[k][2] <= FULL * share for k in full):  # many small records: draw by rows
            inside = inside.withColumn("_size", F.greatest("_size", F.lit(math.ceil(share / row_share))))
        more = [key for key, _ in _draw(inside, share / (DRAWN * (1 << min(salt, 20))), salt)]
        keep = max(1, len(more) // (4 * len(full) * DRAWN) or 1)
        splitters = sorted({*splitters, *more[::keep]})


def write_shards(placed: DataFrame, path: str, files: int) -> str:
    """One folder per shard; every file in it holds a run of consecutive slots in order."""
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
