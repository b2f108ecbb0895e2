"""Passages that occur more than once, removed: a sampled suffix array sorted deep-shallow.

Of all suffixes those at window minima are kept: of each ``sample`` places in a row the one whose next bytes have the
smallest hash. Every string of ``length`` bytes holds at least one such place at an offset that depends on the string
alone, so strings that occur twice hold suffixes that agree from that place on and, backwards, up to it. A sampled suffix
carries the strings whose place it is: some bytes before it and some behind.

Spark deals the suffixes out by what all of these strings share, the next ``length - sample + 1`` bytes; those alone in
their unit are done. A unit's suffixes are sorted deep-shallow, forwards and backwards: multikey quicksort to a shallow
depth, blind tries for what still agrees there. Suffixes meet from the longest common past to the shortest, and the
neighbours in forward order of each that joins tell its longest common future: where past and future together reach
``length``, both occur again. Whatever lies within the longest such past and future of some suffix is removed.

A unit too large for a task is dealt out anew by longer parts of its strings, in steps that end with the strings
themselves, which need only be counted. Equal texts are one text. The texts are dealt out once, to a bucketed table, and
what is found about them goes to them.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.llm.common import body, small_batches, stored
from plumbline.llm.periodic import window_minima
from plumbline.llm.tokens import pieces_of
from plumbline.session import shared_path

LENGTH = 400           # bytes that must occur again
GRAM = 8               # bytes hashed at a place, at most
PLACES = 1 << 20       # windows looked at together
PLACE = np.uint64((1 << 24) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
SHALLOW, CHARACTER = 64, 8   # bytes up to which multikey quicksort goes, and its character
LARGE = 2_000          # suffixes of a unit beyond which it is dealt out anew
STEPS = (64, 8, 1)     # offsets that share a unit then
FOLD = 20_000          # suffixes of large units in a group of texts whose runs are told at once
TEXTS_AT_ONCE = 2 << 20
SEEN = 1_000_000       # texts a task remembers to drop copies early


# --- sampled suffixes -------------------------------------------------------------------------------

def sample_of(length: int) -> int:
    """Places of which one is kept: the fewer, the longer what the strings of a suffix share."""
    return max(1, length * 4 // 5)


def sampled(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``data`` with the first and last start of the strings of ``length`` bytes whose place they are.

    ``bounds`` part the texts; no string crosses them.
    """
    width = sample_of(length)
    gram = min(GRAM, length - width + 1)
    parts = [np.empty((3, 0), np.int64)]
    first, last = bounds[:-1], bounds[1:] - length   # of the starts of each text
    long = last >= first
    first, last = first[long], last[long]
    keep = np.uint64((1 << 8 * gram) - 1 if gram < 8 else 0xFFFFFFFFFFFFFFFF)
    for begin in range(0, max(0, len(data) - length + 1), PLACES):
        end = min(begin + PLACES, len(data) - length + 1)
        some = np.zeros(end - begin + width + 2 * GRAM, np.uint8)
        piece = data[begin:end + width + gram]
        some[:len(piece)] = piece
        grams = np.ndarray((end - begin + width - 1,), "<u8", some, 0, (1,)) & keep
        hashes = (grams ^ (grams >> np.uint64(29))) * MIX
        place = np.arange(len(hashes), dtype=np.uint64)
        chosen = (window_minima((hashes & ~PLACE) | place, width)[:end - begin] & PLACE).astype(np.int64)
        here = slice(np.searchsorted(last, begin), np.searchsorted(first, end))
        edges = np.zeros(end - begin + 1, np.int64)
        np.add.at(edges, np.maximum(first[here] - begin, 0), 1)
        np.add.at(edges, np.minimum(last[here] + 1, end) - begin, -1)
        starts = np.flatnonzero(np.cumsum(edges[:-1]))
        if not len(starts):
            continue
        chosen = chosen[starts]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(starts) != 1)]))
        upto = np.append(new[1:], len(starts)) - 1
        parts.append(np.stack([chosen[new], starts[new], starts[upto]]) + begin)
    at, low, high = np.concatenate(parts, axis=1)
    return at, low, high


# --- deep-shallow sorting ---------------------------------------------------------------------------

def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that ``a`` and ``b`` begin with alike."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def blind_trie_order(strings: Sequence[bytes], members: list[int]) -> list[int]:
    """``members``, numbers of different strings, in order of their strings.

    A branch is ``[depth, {byte there: branch or string}, some string below]``; an end counts as byte -1. Looking for
    a string reads the bytes at the branches only; one comparison with a string below tells where it belongs.
    """
    def byte(i: int, depth: int) -> int:
        s = strings[i]
        return s[depth] if depth < len(s) else -1

    root: list | int = members[0]
    for i in members[1:]:
        node = root
        while isinstance(node, list):
            node = node[1].get(byte(i, node[0]), node[2])
        depth = common_prefix(strings[i], strings[node])
        above, node = None, root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][byte(i, node[0])]
        if isinstance(node, list) and node[0] == depth:
            node[1][byte(i, depth)] = i
            continue
        some = node[2] if isinstance(node, list) else node
        branch = [depth, {byte(some, depth): node, byte(i, depth): i}, some]
        if above is None:
            root = branch
        else:
            above[1][byte(i, above[0])] = branch
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow_order(strings: Sequence[bytes], first: int = CHARACTER) -> list[int]:
    """Numbers of different strings in order: multikey quicksort to a shallow depth, then blind tries.

    ``first`` is how many bytes the first character has, where all are known to begin alike.
    """
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        members, depth = todo.pop()
        if len(members) < 2:
            out += members
        elif depth >= first + SHALLOW:
            out += blind_trie_order(strings, members)
        else:
            until = depth + (CHARACTER if depth else first)
            characters = [strings[i][depth:until] for i in members]
            pivot = characters[len(members) // 2]
            todo += [([i for i, c in zip(members, characters) if c > pivot], depth),
                     ([i for i, c in zip(members, characters) if c == pivot], until),
                     ([i for i, c in zip(members, characters) if c < pivot], depth)]
    return out


def reaches(pasts: list[bytes], futures: list[bytes], copies: list[int], length: int) -> list[tuple[int, int] | None]:
    """Per suffix how far back and forth the strings of ``length`` bytes reach that it shares with another.

    ``pasts`` are read backwards from the place. ``copies`` tells how often a past and future occur together.
    """
    n = len(pasts)
    far: list[tuple[int, int] | None] = [(len(p), len(f)) if c > 1 else None for p, f, c in zip(pasts, futures, copies)]

    def meet(i: int, j: int, past: int) -> None:
        future = common_prefix(futures[i], futures[j])
        if past + future >= length:
            for k in (i, j):
                had = far[k] or (0, 0)
                far[k] = max(had[0], past), max(had[1], future)

    if n < 3:
        if n == 2:
            meet(0, 1, common_prefix(*pasts))
        return far
    shared = length - sample_of(length) + 1
    different = list(dict.fromkeys(futures))
    rank = {different[i]: r for r, i in enumerate(deep_shallow_order(different, shared))}
    by_past: dict[bytes, list[int]] = {}
    for i, p in enumerate(pasts):
        by_past.setdefault(p, []).append(i)
    heads = list(by_past)
    order = deep_shallow_order(heads)
    longest = max(map(len, futures))

    def join(large: list[tuple[int, int]], small: list[tuple[int, int]], past: int) -> None:
        for entry in small:
            k = bisect_left(large, entry)
            for _, other in large[max(0, k - 1):k + 1]:
                meet(entry[1], other, past)
        for entry in small:
            insort(large, entry)

    groups: list[list[tuple[int, int]]] = []
    for k in order:
        group: list[tuple[int, int]] = []
        for i in by_past[heads[k]]:
            join(group, [(rank[futures[i]], i)], len(heads[k]))
        groups.append(group)
    above = list(range(len(order)))

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    alike = [common_prefix(heads[a], heads[b]) for a, b in zip(order, order[1:])]
    for k in sorted(range(len(alike)), key=lambda k: -alike[k]):
        if alike[k] + longest < length:
            break
        a, b = top(k), top(k + 1)
        if len(groups[a]) < len(groups[b]):
            a, b = b, a
        join(groups[a], groups[b], alike[k])
        above[b] = a
    return far


# --- on Spark ---------------------------------------------------------------------------------------

SUFFIX = "key long, owner binary, places array<int>, past int, string binary"
SPOT = "key long, kind binary, owner binary, at int, low int, high int"


def _texts(docs: DataFrame, text_column: str, length: int) -> DataFrame:
    """Each different text of at least ``length`` bytes once, with its sampled suffixes, in a table bucketed by ``owner``.

    ``owner`` is half the SHA-256 of the text.
    """
    shared = length - sample_of(length) + 1

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces_of(batches, "text", TEXTS_AT_ONCE):
            digests = [hashlib.sha256(t).digest() for t in (v.as_buffer() for v in batch["text"])]
            fresh = []
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if not fresh:
                continue
            texts = batch["text"].take(pa.array(fresh))
            bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
            data = np.frombuffer(texts.buffers()[2], np.uint8, int(bounds[-1]))
            at, low, high = sampled(data, bounds, length)
            view = memoryview(data)
            keys = np.array([xxhash.xxh3_64_intdigest(view[a:a + shared]) for a in at.tolist()], np.uint64).view(np.int64)
            owner = np.searchsorted(bounds, low, "right") - 1
            offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
            lists = {c: pa.ListArray.from_arrays(offsets, pa.array(v, kind)) for c, v, kind in (
                ("keys", keys, pa.int64()), ("at", at - bounds[owner], pa.int32()), ("low", low - bounds[owner], pa.int32()), ("high", high - bounds[owner], pa.int32()))}
            yield pa.RecordBatch.from_pydict({
                "owner": pa.array([digests[i][:16] for i in fresh], pa.binary()), "sha256": pa.array([digests[i].hex() for i in fresh]), "text": texts, **lists})

    found = docs.select(body(text_column).cast("binary").alias("text")).where(F.octet_length("text") >= length).mapInArrow(
        told, "owner binary, sha256 string, text binary, keys array<long>, at array<int>, low array<int>, high array<int>")
    return _bucketed(found, "texts")


def _bucketed(rows: DataFrame, label: str) -> DataFrame:
    """One row for each ``owner`` in a table that joins by it without being dealt out again."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"plumbline_{label}_{uuid.uuid4().hex}"
    (rows.repartition(buckets, "owner").dropDuplicates(["owner"]).write.bucketBy(buckets, "owner").format("parquet")
     .option("compression", "zstd").option("path", shared_path(spark, label)).saveAsTable(table))
    return spark.table(table)


def _beside(texts: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Texts with the rows that name them as their ``owner``: only the rows are dealt out."""
    marks = rows.groupBy("owner").agg(F.collect_list(F.struct(*columns)).alias("marks"))
    return texts.join(marks.hint("shuffle_hash"), "owner")


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """``key, owner, text, at, low, high`` of the sampled suffixes with a wanted key."""
    for owner, text, keys, at, low, high, marks in zip(*(batch[c].to_pylist() for c in ("owner", "text", "keys", "at", "low", "high", "marks"))):
        some = {m["key"] for m in marks}
        for k, a, b, e in zip(keys, at, low, high):
            if k in some:
                yield k, owner, text, a, b, e


def _suffixes(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The sampled suffixes with the ``wanted`` keys, each different one of a text once."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", TEXTS_AT_ONCE):
            found: dict[tuple, list[int]] = {}
            for k, owner, text, a, b, e in _wanted(batch):
                found.setdefault((k, owner, a - b, text[b:e + length]), []).append(a)
            keys, owners, pasts, strings = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys, pa.int64()), "owner": pa.array(owners, pa.binary()), "places": pa.array(list(found.values()), pa.list_(pa.int32())),
                "past": pa.array(pasts, pa.int32()), "string": pa.array(strings, pa.binary())})

    return _beside(texts.drop("sha256"), wanted, "key").mapInArrow(cut, SUFFIX)


def _spots(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["key", "kind", "owner", "at", "low", "high"])


def _kinds(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Per text its sampled suffixes with a ``wanted`` key, in lists, each with a digest of its past and future as its ``kind``."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", TEXTS_AT_ONCE):
            rows: dict[bytes, list[tuple]] = {}
            for k, owner, text, a, b, e in _wanted(batch):
                rows.setdefault(owner, []).append((k, hashlib.blake2b(b"%d|%b" % (a - b, text[b:e + length]), digest_size=16).digest(), a, b, e))
            columns = list(zip(*(r for own in rows.values() for r in own))) if rows else [()] * 5
            offsets = pa.array(np.cumsum([0, *map(len, rows.values())]), pa.int32())
            kinds = pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, kind)) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), *lists], ["owner", "keys", "kinds", "at", "low", "high"])

    return _beside(texts.drop("sha256"), wanted, "key").mapInArrow(
        told, "owner binary, keys array<long>, kinds array<binary>, at array<int>, low array<int>, high array<int>")


def _counted(here: DataFrame) -> DataFrame:
    """``group, kind, n`` and one suffix of each kind, added up for each batch of texts before anything is dealt out."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch["kinds"]).to_numpy()
            text = np.repeat(np.arange(len(size)), size)
            code = pc.list_flatten(batch["kinds"]).dictionary_encode().indices.to_numpy().astype(np.int64)
            both = np.stack([batch["group"].to_numpy()[text], code])
            _, first, n = np.unique(both, axis=1, return_index=True, return_counts=True)
            some = pa.array(first)
            yield pa.RecordBatch.from_pydict({
                "group": pa.array(both[0][first], pa.int64()), "kind": pc.list_flatten(batch["kinds"]).take(some), "n": pa.array(n, pa.int64()),
                "owner": batch["owner"].take(pa.array(text[first])), "key": pc.list_flatten(batch["keys"]).take(some),
                **{c: pc.list_flatten(batch[c]).take(some) for c in ("at", "low", "high")}})

    return here.mapInArrow(add, "group long, kind binary, n long, owner binary, key long, at int, low int, high int")


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows in tables that end where a unit ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        keys = batch["key"].to_numpy()
        if not len(keys) or keys[0] == keys[-1] and held[0]["key"][0] == batch["key"][-1]:
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
        held = [batch.slice(last)]
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _reached(suffixes: DataFrame, length: int) -> DataFrame:
    """Solve units: ``owner, begin, end`` of what is covered, relative to each place."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            out: tuple[list, list, list] = [], [], []
            unit: dict[tuple[int, bytes], list] = {}
            last = None

            def close() -> None:
                if len(unit) == 1 and len(next(iter(unit.values()))) == 1 and len(next(iter(unit.values()))[0][1]) == 1:
                    return
                kinds = list(unit)
                copies = [sum(len(places) for _, places in owners) for owners in unit.values()]
                far = reaches([s[:p][::-1] for p, s in kinds], [s[p:] for p, s in kinds], copies, length)
                for reach, owners in zip(far, unit.values()):
                    if reach:
                        for owner, places in owners:
                            out[0].extend([owner] * len(places))
                            out[1].extend([at - reach[0] for at in places])
                            out[2].extend([at + reach[1] for at in places])

            for key, owner, places, past, string in zip(*(table[c].to_pylist() for c in ("key", "owner", "places", "past", "string"))):
                if key != last and unit:
                    close()
                    unit.clear()
                last = key
                unit.setdefault((past, string), []).append((owner, places))
            if unit:
                close()
            yield pa.RecordBatch.from_pydict({"owner": pa.array(out[0], pa.binary()), "begin": pa.array(out[1], pa.int32()), "end": pa.array(out[2], pa.int32())})

    units = suffixes.repartition("key").sortWithinPartitions("key")
    return units.mapInArrow(solve, "owner binary, begin int, end int")


def _redealt(marked: DataFrame, step: int, length: int) -> DataFrame:
    """Each mark once per ``step`` offsets of its strings, keyed by the part these share."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", TEXTS_AT_ONCE // 8):
            rows = []
            for owner, text, marks in zip(*(batch[c].to_pylist() for c in ("owner", "text", "marks"))):
                for m in marks:
                    at = m["at"]
                    for g in range((at - m["high"]) // step, (at - m["low"]) // step + 1):
                        part = text[at - g * step:at + length - (g + 1) * step + 1]
                        key = xxhash.xxh3_64_intdigest(part, seed=g)
                        rows.append((key - (key >> 63 << 64), owner, owner, at, max(m["low"], at - (g + 1) * step + 1), min(m["high"], at - g * step)))
            yield _spots(rows)

    return marked.mapInArrow(deal, SPOT)


def _strings(marked: DataFrame, length: int) -> DataFrame:
    """The past and future of each mark, as suffixes of its kind."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", TEXTS_AT_ONCE // 8):
            rows = [(m["key"], m["kind"], [0], m["at"] - m["low"], text[m["low"]:m["high"] + length])
                    for text, marks in zip(batch["text"].to_pylist(), batch["marks"].to_pylist()) for m in marks]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["key", "owner", "places", "past", "string"])

    return marked.mapInArrow(cut, SUFFIX)


def _reached_large(texts: DataFrame, wanted: DataFrame, length: int, large: int) -> DataFrame:
    """What ``_reached`` tells of the ``wanted`` keys, for units of any size.

    Suffixes alike in past and future are one kind; kinds that occur again are covered whole. One suffix of each kind
    is kept in a bucketed table and dealt out by longer and longer parts of its strings, until the units are small, or are single strings
    that need only be counted. Digests travel, not strings: those leave the table for small units only.
    """
    spot = ("key", "kind", "at", "low", "high")
    reach = [(F.col("low") - F.col("at")).alias("begin"), (F.col("high") + length - F.col("at")).alias("end")]
    # Texts of one group lie in one bucket, so that a task meets few groups and most kinds are counted where they are.
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 + wanted.count() // (FOLD * buckets)
    group = F.pmod(F.hash("owner"), F.lit(buckets)).cast("long") * parts + F.pmod(F.xxhash64("owner"), F.lit(parts))
    here = stored(_kinds(texts, wanted, length).withColumn("group", group), "large")
    with small_batches(texts.sparkSession):
        counted = stored(_counted(here), "counted")
    firsts = counted.groupBy("kind").agg(F.min(F.struct("owner", "key", "at", "low", "high")).alias("first")).select("kind", "first.*")
    again = counted.groupBy("kind").agg(F.sum("n").alias("n"), F.first(F.col("at") - F.col("low")).alias("past"), F.first(F.col("high") - F.col("low")).alias("more")).where("n > 1")
    found = [again.select("kind", (-F.col("past")).alias("begin"), (F.col("more") + length - F.col("past")).alias("end"))]
    kinds = _bucketed(_strings(_beside(texts.select("owner", "text"), firsts, *spot), length).select(
        "owner", F.col("string").alias("text"), F.col("past").alias("at"), F.lit(0).alias("low"), (F.octet_length("string") - length).alias("high")), "kinds")
    marked = kinds.select("owner", "text", F.array(F.struct("at", "low", "high")).alias("marks"))
    for step in [s for s in STEPS if s < sample_of(length) or s == 1]:
        dealt = stored(_redealt(marked, step, length), "dealt")
        sizes = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        if step == 1:
            found.append(dealt.join(sizes.hint("merge"), "key", "left_semi").select("kind", *reach))
            break
        few = dealt.join(sizes.where(F.col("n") <= large).hint("merge"), "key", "left_semi")
        found.append(_reached(_strings(_beside(kinds.select("owner", "text"), few, *spot), length), length).withColumnRenamed("owner", "kind"))
        many = sizes.where(F.col("n") > large)
        if many.isEmpty():
            break
        marked = _beside(kinds.select("owner", "text"), dealt.join(many.hint("merge"), "key", "left_semi"), *spot)
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    far = stored(told.groupBy("kind").agg(F.min("begin").alias("back"), F.max("end").alias("forth")), "far")
    return _runs(here, counted.select(F.col("group").alias("home"), "kind").distinct().join(far, "kind"))


def _runs(here: DataFrame, reach: DataFrame) -> DataFrame:
    """``owner, begin, end`` of the runs that the suffixes of a text cover together, by how far those of their kind reach.

    Each group of texts has the reach of its own kinds beside it: that of a kind in all texts is there once a group, and a passage
    covered by many suffixes of a text is one row.
    """
    def fold(own: pa.Table, far: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        found = pc.index_in(pc.list_flatten(own["kinds"]).combine_chunks(), value_set=far["kind"].combine_chunks())
        covered = found.is_valid().to_numpy(zero_copy_only=False)
        kind = found.drop_null().to_numpy()
        text = np.repeat(np.arange(own.num_rows), pc.list_value_length(own["kinds"]).to_numpy())[covered] << 32  # one behind the other
        at = text + pc.list_flatten(own["at"]).to_numpy()[covered]
        begin, end = at + far["back"].to_numpy()[kind], at + far["forth"].to_numpy()[kind]
        order = np.argsort(begin)
        begin, end = begin[order], np.maximum.accumulate(end[order])
        first = np.flatnonzero(np.append(True, begin[1:] > end[:-1])[:len(begin)])
        last = np.append(first[1:], len(begin))[:len(first)] - 1
        place = (1 << 32) - 1
        return pa.table({"owner": own["owner"].take(pa.array(begin[first] >> 32)),
                         "begin": pa.array(begin[first] & place, pa.int32()), "end": pa.array(end[last] & place, pa.int32())})

    texts = here.select("group", "owner", "kinds", "at")
    return texts.groupBy("group").cogroup(reach.select("home", "kind", "back", "forth").groupBy("home")).applyInArrow(fold, "owner binary, begin int, end int")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each text's covered parts, and its other bytes."""
    for batch in pieces_of(batches, "text", TEXTS_AT_ONCE):
        spans, kept = [], []
        for text, parts in zip(batch["text"].to_pylist(), batch["parts"].to_pylist()):
            merged: list[list[int]] = []
            for part in sorted((p["begin"], p["end"]) for p in parts):
                if merged and part[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], part[1])
                else:
                    merged.append(list(part))
            edges = [0, *(e for m in merged for e in m), len(text)]
            spans.append([{"begin": b, "end": e} for b, e in merged])
            kept.append(b"".join(text[b:e] for b, e in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_pydict({
            "sha256": batch["sha256"], "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", large: int = LARGE) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, kept, text_sha256``.

    Texts are taken as UTF-8 bytes, null as empty. ``spans`` are the maximal runs of bytes covered by strings of
    ``length`` bytes that start anywhere else too, in the same text, overlapping or not, or in another row; by
    ``begin`` and ``end`` from 0, in order. Rows that repeat count as different places, so texts of ``length`` bytes or
    more that occur twice are covered whole. ``kept`` holds the other bytes; it is null where no byte goes, so that such texts
    need not travel; ``text_sha256`` is the digest of the whole text. Shorter texts have no spans. Null and repeated ids
    are kept as they are, other columns are not read, no rows give no rows. ``large`` is the size from which units are dealt out anew.
    """
    texts = _texts(docs, text_column, length)
    suffixes = texts.select("owner", F.explode("keys").alias("key"))
    again = stored(suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    wanted = stored(suffixes.join(again.hint("merge"), "key"), "wanted")
    covered = _reached(_suffixes(texts, wanted.where(F.col("n") <= large), length), length)
    if not again.where(F.col("n") > large).isEmpty():
        covered = covered.unionByName(_reached_large(texts, wanted.where(F.col("n") > large), length, large))
    parts = stored(covered.groupBy("owner").agg(F.collect_set(F.struct("begin", "end")).alias("parts")), "parts")
    told = texts.select("owner", "sha256", "text").join(parts.hint("shuffle_hash"), "owner").mapInArrow(
        _kept, "sha256 string, spans array<struct<begin:long,end:long>>, kept binary")
    rows = docs.select(name(id_column).alias("doc_id"), F.octet_length(body(text_column)).cast("long").alias("n_bytes"), F.sha2(body(text_column), 256).alias("text_sha256"))
    copied = rows.where(F.col("n_bytes") >= length).groupBy(F.col("text_sha256").alias("sha256")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    marks = stored(told.join(copied, "sha256", "full"), "marks")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<begin:long,end:long>>")
    return rows.join(marks.withColumnRenamed("sha256", "text_sha256").hint("merge"), "text_sha256", "left").select(
        "doc_id", "n_bytes", F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("copies") > 1, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "text_sha256")
