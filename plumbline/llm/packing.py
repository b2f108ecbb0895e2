"""Packing token sequences into windows by best-fit decreasing.

Best fit places longer pieces first and looks at nothing but lengths, and a piece has one of at
most ``capacity`` lengths. So the whole corpus is packed from its histogram of lengths: pieces of
one length are placed many at a time, into runs of windows with the same room left, and a segment
tree over the room left finds the tightest run. The resulting plan says which ranks of a length
go to which windows; its size depends on the capacity, not on the corpus. Spark then ranks the
pieces within their length and looks each one up.

A length may hold any share of the pieces: ranks are counted in salted buckets of bounded size.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.llm.common import body, stored
from plumbline.llm.tokens import encoder, pieces_of

CAPACITY = 4096
BUCKET_ROWS = 1_000       # about so many pieces of one length are ranked together
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Room:
    """Segment tree over the room left: the least room at or above a length that any window has."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._any = [0] * (2 * self._leaves)

    def add(self, room: int, windows: int) -> None:
        at = room + self._leaves
        while at:
            self._any[at] += windows
            at >>= 1

    def tightest(self, length: int) -> int | None:
        at = length + self._leaves
        while not self._any[at]:
            while at & 1:            # a right child: nothing further right below this parent
                at >>= 1
                if not at:
                    return None
            at += 1
            if at & (at - 1) == 0:   # ran off the right edge of this level
                return None
        while at < self._leaves:
            at = 2 * at if self._any[2 * at] else 2 * at + 1
        return at - self._leaves


def best_fit_decreasing(lengths: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan: rows ``length, first_rank, windows, first_window, offset``.

    ``lengths`` says how many pieces there are of each length from 1 to ``capacity``. Pieces
    ``first_rank ... first_rank + windows - 1`` of a length go one each to as many windows from
    ``first_window`` on, at ``offset``. Placing a run at once equals placing its pieces one by
    one: the window just used stays the tightest until the length no longer fits.
    """
    room, runs, plan, opened = _Room(capacity), defaultdict(list), [], 0
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            tight = room.tightest(length)
            if tight is None:
                first, windows, tight = opened, -(-left // (capacity // length)), capacity
                opened += windows
            else:
                first, windows = runs[tight].pop()
                room.add(tight, -windows)
            each = tight // length
            full = min(windows, left // each)
            rest = min(left - full * each, each) if full < windows else 0
            for k in range(each if full else 0):
                plan.append((length, rank + k * full, full, first, capacity - tight + k * length))
            rank += full * each
            for k in range(rest):
                plan.append((length, rank + k, 1, first + full, capacity - tight + k * length))
            rank += rest
            left -= full * each + rest
            for run, used, start in ((full, each, first), (1 if rest else 0, rest, first + full)):
                if run:
                    runs[tight - used * length].append((start, run))
                    room.add(tight - used * length, run)
            untouched = windows - full - (1 if rest else 0)
            if untouched:
                runs[tight].append((first + windows - untouched, untouched))
                room.add(tight, untouched)
    return np.array(plan, np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
                 id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids with its end id, cut into full windows and one shorter rest.

    With ``with_ids`` each piece carries its ids.
    """
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in pieces_of(batches, "text"):
            ids, bounds = encode.encode(batch["text"], end_id)
            sizes = np.diff(bounds)
            count = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            at = bounds[owner] + start
            raw = memoryview(ids.astype("<u4"))
            columns = {
                "doc_id": batch["doc_id"].take(pa.array(owner)), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[a:a + n]) for a, n in zip(at.tolist(), length.tolist())], pa.int64()),
                "doc_tokens": pa.array(sizes[owner], pa.int64())}
            if with_ids:  # pieces follow one another, so their ids are one run
                columns["ids"] = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([at, [len(ids)]]), pa.int32()), pa.array(ids.astype("i4")))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(name(id_column).cast("long").alias("doc_id"), body(text_column).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset`` added.

    Every row gets its own place, also rows that repeat whole. Sequence ids run from 0 without a
    gap, offsets within a sequence leave none. No pieces, no rows. Columns of these two names are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    rows = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    lengths = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = F.expr("array(" + ", ".join(f"{1 + lengths.get(n, 0) // BUCKET_ROWS}L" for n in range(1, capacity + 1)) + ")")
    salted = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.element_at(buckets, F.col("length").cast("int"))))
    counts = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")
    inside = Window.partitionBy("length", "_bucket").orderBy("_row")
    ranked = (salted.withColumn("_rank", F.row_number().over(inside) - 1).join(bases, ["length", "_bucket"])
              .withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_base", "_bucket", "_row"))
    plan = best_fit_decreasing(lengths, capacity)
    # Steps in order of (length, rank) as one number: ranks stay below 2^48.
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    step_keys = (plan[:, 0] << 48) + plan[:, 1]
    shared = spark.sparkContext.broadcast((step_keys, plan))  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, steps = shared.value
        for batch in batches:
            rank = batch["_rank"].to_numpy(zero_copy_only=False).astype(np.int64)
            length = batch["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            step = steps[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            columns = {c: batch[c] for c in batch.schema.names if c != "_rank"}
            columns["sequence_id"] = pa.array(step[:, 3] + rank - step[:, 1], pa.int64())
            columns["offset"] = pa.array(step[:, 4], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"])).select(
        *pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
                   id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place. A null text counts as empty and is its end id
    alone; a null document id stays null; other columns are not read; an empty table gives no rows."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, id_column, text_column, with_ids), capacity)


def sequences(placed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The packed windows: ``sequence_id, ids, lengths, padding``.

    ``placed`` comes from :func:`pack_documents` with ids. ``lengths`` are those of the pieces in
    order, for attention masks. Windows are padded to ``capacity``, except where their own length
    is a power of two. One window's pieces are gathered, at most ``capacity`` ids.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    windows = placed.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["length"]).alias("lengths"))
    used = F.size("ids")
    padding = F.when(F.bit_count(used) == 1, F.lit(0)).otherwise(F.lit(capacity) - used)
    return windows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), padding)).alias("ids"),
                          "lengths", padding.alias("padding"))
