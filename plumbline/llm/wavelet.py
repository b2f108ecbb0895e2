"""Token ids in wavelet-matrix shards.

Documents are range-partitioned by id, encoded, and cut into shards of about a million tokens.
A shard is one self-contained compressed file, kept as one binary cell of a Parquet table, so it
can live wherever Spark writes. It holds one bit-plane per bit of the largest id. On it, reading
any token, counting an id in a range and finding its occurrences take one rank or select per plane.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.llm.common import body
from plumbline.llm.tokens import encoder, pieces_of

SHARD_TOKENS = 1 << 20    # a shard closes with the document that reaches this
MAGIC = b"WVMTX1\0\0"
HEAD = struct.Struct("<8sQQI")
BLOCK = 8                 # 64-bit words per entry of the rank directory
SHARD_SCHEMA = "part int, seq int, n_tokens long, n_docs long, file binary"


class _Plane:
    """Packed bits with a rank directory of one entry per 512 bits."""

    def __init__(self, bits: np.ndarray, n: int):
        self.bits, self.n = bits, n
        words = np.frombuffer(bits.tobytes() + bytes(-len(bits) % (8 * BLOCK) + 8 * BLOCK), "<u8")
        ones = np.bitwise_count(words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self._words, self._before = words, np.concatenate([[0], np.cumsum(ones)])

    def get(self, i: int) -> int:
        return int(self.bits[i >> 3]) >> (i & 7) & 1

    def rank(self, bit: int, i: int) -> int:
        """How many of the first ``i`` bits equal ``bit``."""
        word = i >> 6
        block = word // BLOCK
        ones = int(self._before[block]) + int(np.bitwise_count(self._words[block * BLOCK:word]).sum())
        ones += (int(self._words[word]) & ((1 << (i & 63)) - 1)).bit_count()
        return ones if bit else i - ones

    def select(self, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) bit that equals ``bit``."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.rank(bit, middle + 1) > k:
                high = middle
            else:
                low = middle + 1
        return low


class WaveletMatrix:
    """A sequence of ids as bit-planes, the highest bit first, each stably sorted by the bits above."""

    def __init__(self, planes: list[_Plane], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, zeros = [], []
        for level in range(width - 1, -1, -1):
            ones = (ids >> ids.dtype.type(level) & ids.dtype.type(1)).view(f"u{ids.dtype.itemsize}").astype(bool)
            planes.append(_Plane(np.packbits(ones, bitorder="little"), len(ids)))
            ids = np.concatenate([ids[~ones], ids[ones]])
            zeros.append(len(ids) - int(np.count_nonzero(ones)))
        return cls(planes, zeros, len(ids))

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes are unsorted from the lowest bit up."""
        ids = np.zeros(self.n, "<u2" if len(self.planes) <= 16 else "<u4")
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = np.unpackbits(plane.bits, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(ids)
            out[~ones] = ids[:zeros]
            out[ones] = ids[zeros:] | ids.dtype.type(1 << level)
            ids = out
        return ids

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane, zeros in zip(self.planes, self.zeros):
            bit = plane.get(i)
            token = token << 1 | bit
            i = plane.rank(bit, i) + (zeros if bit else 0)
        return token

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` in ``[begin, end)`` lie below the lowest plane."""
        if not 0 <= token < 1 << len(self.planes):
            return 0, 0
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            bit = token >> (len(self.planes) - 1 - level) & 1
            shift = zeros if bit else 0
            begin, end = plane.rank(bit, begin) + shift, plane.rank(bit, end) + shift
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often ``token`` occurs in ``[begin, end)``."""
        low, high = self._range(token, begin, self.n if end is None else end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = token >> level & 1
            i = plane.select(bit, i - (zeros if bit else 0))
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


class Shard:
    """One file: a wavelet matrix and the documents in it. A null document id stays null."""

    def __init__(self, matrix: WaveletMatrix, doc_ids: list[int | None], bounds: np.ndarray):
        self.matrix, self.doc_ids, self.bounds = matrix, doc_ids, bounds

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        null = np.array([d is None for d in self.doc_ids], "u1")
        parts = [ids.tobytes(), null.tobytes(), self.bounds.astype("<i8").tobytes(),
                 np.array(self.matrix.zeros, "<i8").tobytes(), *[p.bits.tobytes() for p in self.matrix.planes]]
        packed = [pack(p) for p in parts]
        head = HEAD.pack(MAGIC, self.matrix.n, len(ids), len(self.matrix.planes))
        return b"".join([head, *[struct.pack("<Q", len(p)) + p for p in packed]])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, n, _, n_planes = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        unpack, at, parts = zstandard.ZstdDecompressor().decompress, HEAD.size, []
        for _ in range(4 + n_planes):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(unpack(data[at + 8:at + 8 + size]))
            at += 8 + size
        null = np.frombuffer(parts[1], "u1")
        doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(parts[0], "<i8").tolist(), null)]
        planes = [_Plane(np.frombuffer(p, "u1"), n) for p in parts[4:]]
        return cls(WaveletMatrix(planes, np.frombuffer(parts[3], "<i8").tolist(), n), doc_ids, np.frombuffer(parts[2], "<i8"))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id",
                 text_column: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode every whole text, end each with ``end_id``, and write the shards to ``path``.

    Shards follow ascending id over ``(part, seq)``; null ids come first, rows with one id in no
    fixed order. A null text counts as empty and is its end id alone. A document is never split,
    so memory is bounded by a shard and the longest document. Ids must be integers. Other columns
    are not read. An empty table writes an empty table.
    """
    rows = docs.select(name(id_column).cast("long").alias("doc_id"), body(text_column).alias("text"),
                       F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        ids, doc_ids, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            shard = Shard(WaveletMatrix.of(np.concatenate(ids)), doc_ids, np.concatenate([[0], np.cumsum(sizes)]))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_tokens": pa.array([held], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64()),
                "file": pa.array([shard.to_bytes()], pa.binary())})

        for batch in pieces_of(batches, "text"):
            got, bounds = encode.encode(batch["text"], end_id)
            named, at = batch["doc_id"].to_pylist(), 0
            while at < len(named):
                until = min(len(named), int(np.searchsorted(bounds, bounds[at] + shard_tokens - held, "left")))
                until = max(at + 1, until)
                ids.append(got[bounds[at]:bounds[until]])
                doc_ids += named[at:until]
                sizes += np.diff(bounds[at:until + 1]).tolist()
                held += int(bounds[until] - bounds[at])
                at = until
                if held >= shard_tokens:
                    yield close()
                    seq, ids, doc_ids, sizes, held = seq + 1, [], [], [], 0
        if doc_ids:
            yield close()

    # The cells are compressed files already.
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The shards, and per shard ``base``: how many tokens come before it."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per writing task.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(ahead.orderBy("part")), F.lit(0)).alias("part_base"))
    bases = sizes.join(parts, "part").select(
        "part", "seq", (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("base"))
    return shards.drop("n_tokens", "n_docs"), bases


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    shards, bases = read_shards(spark, path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["file"]):
                shard = Shard.from_bytes(file.as_buffer())
                raw, bounds = memoryview(shard.matrix.tokens().astype("<u4")), shard.bounds.tolist()
                n = len(shard.doc_ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()),
                    "doc_id": pa.array(shard.doc_ids, pa.int64()), "at": pa.array(bounds[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(shard.bounds), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64())})

    rows = shards.mapInArrow(digests, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``doc_id, position``: where ``token`` stands in the whole sequence, by rank and select on each shard."""
    shards, bases = read_shards(spark, path)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["file"]):
                shard = Shard.from_bytes(file.as_buffer())
                at = shard.matrix.occurrences(token)
                owners = np.searchsorted(shard.bounds, at, "right") - 1
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(at), pa.int32()), "seq": pa.array([seq] * len(at), pa.int32()),
                    "doc_id": pa.array([shard.doc_ids[o] for o in owners], pa.int64()), "at": pa.array(at, pa.int64())})

    rows = shards.mapInArrow(found, "part int, seq int, doc_id long, at long")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("position"))
