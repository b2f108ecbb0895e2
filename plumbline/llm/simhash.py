"""SimHash near-duplicates by a self-join over a binary trie of fingerprints.

Fingerprints within ``budget`` bits of each other differ in at most half the budget (rounded
down) in one half of their bits. So two tries are joined with themselves: one over the bits as
they are, one with the halves swapped, and in each the upper half may use only that share of the
budget. The top of each trie is walked by Spark: a fingerprint goes to its own node and, as a
visitor, to every lower-numbered node its share of errors can reach. Below, a task walks its
node: all pairs of subtrees go down one bit at a time together, adding up differing bits, and a
pair is dropped as soon as it exceeds what the depth allows.

Equal fingerprints count once. A node too full for one task is walked further down by Spark, and
at the last depth cut into blocks that are joined block against block. A task reports a spanning
forest of the links it found, never the pairs of a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.llm.common import body, components, roots, small_batches, stored

BITS, HALF = 64, 32
SEED = 42
TARGET = 2_000            # fingerprints a trie node at the first depth should own
FULL = 30_000             # rows beyond which a node is split further
DEEPER = 6                # bits added where nodes are too full
AT_ONCE = 200_000         # shingles hashed at once
PAIRS_AT_ONCE = 500_000   # pairs of subtrees walked at once
SPACE = b" \t\n\x0b\x0c\r"


def _runs(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The words in runs of bounded size; a run repeats the last ``width - 1`` words of the one before."""
    held, at = [], 0
    while at < len(text):
        until = min(len(text), at + (1 << 20))
        while until < len(text) and text[until] not in SPACE:
            until += 1
        held += text[at:until].split()
        at = until
        if len(held) >= AT_ONCE or at == len(text):
            yield held
            held = held[1 - width:] if width > 1 else []


def fingerprint(text: str | bytes | memoryview, width: int = 3) -> int:
    """64-bit SimHash of ``text`` (bytes: in UTF-8): A-Z in lower case, words between ASCII white space, ``width``-word
    shingles with repeats. A bit is set if more than half of the shingles' XXH64 values set it. With
    fewer words the whole sequence is one shingle; without any the fingerprint is zero."""
    lowered = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)).lower()
    ones, total = np.zeros(BITS, np.int64), 0
    first: list[bytes] | None = None
    for words in _runs(lowered, width):
        first = words if first is None else first
        shingles = map(b" ".join, zip(*[islice(words, i, None) for i in range(width)]))
        n = max(0, len(words) - width + 1)
        values = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", n)
        for i in range(0, n, AT_ONCE):
            ones += np.unpackbits(values[i:i + AT_ONCE].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += n
    if not total:
        if not first:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(first), SEED)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, text_column: str = "text", alias: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as the long ``alias``; null counts as empty.

    A column of the name of ``alias`` is replaced.
    """
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        # Straight from the batch's buffer: no text becomes a Python string.
        values = np.fromiter((fingerprint(v.as_buffer(), width) for v in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return docs.withColumn(alias, of(body(text_column)))


def trie_links(values: np.ndarray, own: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in sorted ``values`` (unsigned 64-bit) within ``budget`` bits, at least one ``own``.

    All values of the node agree up to ``depth`` but for visitors' errors. The walk keeps pairs of
    ranges of ``values``, which are pairs of trie nodes, and goes down bit by bit.
    """
    share = budget // 2
    n = len(values)
    if not n:
        return
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(values >> np.uint64(BITS - depth)) != 0])) if depth else np.array([0])
    ends = np.append(bounds[1:], n)
    heads = values[bounds] >> np.uint64(BITS - depth) if depth else np.zeros(1, np.uint64)
    mine = np.add.reduceat(own.astype(np.int64), bounds) > 0
    i, j = np.nonzero(mine[:, None] & (~mine[None, :] | (np.arange(len(bounds))[:, None] <= np.arange(len(bounds))[None, :])))
    diff = np.bitwise_count(heads[i] ^ heads[j]).astype(np.int64)
    todo = [(depth, bounds[i], ends[i], bounds[j], ends[j], diff)]
    while todo:  # depth first, a bounded number of pairs at a time
        level, *pairs = todo.pop()
        if len(pairs[0]) > PAIRS_AT_ONCE:
            todo += [(level, *[x[k:k + PAIRS_AT_ONCE] for x in pairs]) for k in range(0, len(pairs[0]), PAIRS_AT_ONCE)]
            continue
        live = pairs[4] <= (share if level <= HALF else budget)
        alo, ahi, blo, bhi, diff = (x[live] for x in pairs)
        single = (ahi - alo == 1) & (bhi - blo == 1)  # distinct values: always so at the last level
        if single.any():
            a, b = alo[single], blo[single]
            parted = values[a] ^ values[b]
            near = ((a != b) & (np.bitwise_count(parted) <= budget)
                    & (np.bitwise_count(parted >> np.uint64(BITS - HALF)) <= share))
            yield a[near], b[near]
            alo, ahi, blo, bhi, diff = (x[~single] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - level) & np.uint64(1)).astype(np.int64))])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])  # sorted: zeros come first
        other = alo != blo
        parts = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1),
                 tuple(x[other] for x in (amid, ahi, blo, bmid, diff + 1))]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*parts))
        some = (ahi > alo) & (bhi > blo)
        todo.append((level + 1, *[x[some] for x in (alo, ahi, blo, bhi, diff)]))


def _node_links(table: pa.Table, budget: int) -> pa.Table:
    """A spanning forest of the links in one node (or block pair): ``value, root``."""
    depth = table["depth"][0].as_py()
    values = table["turned"].to_numpy().astype("int64").view("uint64")
    order = np.argsort(values, kind="stable")
    values, own = values[order], table["own"].to_numpy(zero_copy_only=False).astype(bool)[order]
    swapped = bool(table["trie"][0].as_py())
    root = np.arange(len(values))
    for a, b in trie_links(values, own, depth, budget):
        root = roots(np.concatenate([a, np.arange(len(values))]), np.concatenate([b, root]), len(values))
    linked = root != np.arange(len(values))
    plain = (values << np.uint64(HALF) | values >> np.uint64(HALF)) if swapped else values
    return pa.table({"value": pa.array(plain[linked].view("int64")), "root": pa.array(plain[root[linked]].view("int64"))})


def _within(errors: int, bits: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``errors`` set."""
    return [sum(1 << p for p in where) for k in range(min(errors, bits) + 1) for where in combinations(range(bits), k)]


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, BITS - depth) if depth else F.lit(0).cast("long")


def _at_depth(turned: DataFrame, depth: int, share: int) -> DataFrame:
    """Each fingerprint at its node and, as a visitor, at the lower nodes its errors reach."""
    own = _prefix(F.col("turned"), depth)
    masks = F.array(*[F.lit(m).cast("long") for m in _within(share, depth)])
    return (turned.withColumn("mask", F.explode(masks)).withColumn("node", own.bitwiseXOR(F.col("mask")))
            .where(F.col("node") <= own).withColumn("own", F.col("mask") == 0).withColumn("depth", F.lit(depth)).drop("mask"))


def near_links(values: DataFrame, column: str, budget: int = 3, target: int = TARGET, full: int = FULL) -> DataFrame:
    """``value, root``: links that connect all distinct values within ``budget`` bits, and no others.

    ``values`` holds distinct non-null longs. Every link is between values in the budget or follows
    from such links.
    """
    share = budget // 2
    plain = name(column)
    swapped = F.shiftleft(plain, HALF).bitwiseOR(F.shiftrightunsigned(plain, HALF))
    turned = stored(values.select(F.explode(F.array(
        F.struct(F.lit(0).alias("trie"), plain.alias("turned")), F.struct(F.lit(1).alias("trie"), swapped.alias("turned"))))
        .alias("t")).select("t.*"), "tries")
    n = turned.count() // 2
    depth = min(HALF, max(0, math.ceil(math.log2(max(1, n / target)))))
    found, within = [], None
    while True:
        dealt = _at_depth(turned, depth, share)
        if within is not None:  # only below the nodes that were too full
            up, at = within
            dealt = dealt.withColumn("_up", F.shiftrightunsigned(F.col("node"), depth - at)).join(
                up, ["trie", "_up"], "left_semi").drop("_up")
        dealt = stored(dealt, "nodes")
        sizes = stored(dealt.groupBy("trie", "node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > full), "full")
        crowded = not sizes.isEmpty()
        rest = dealt.join(sizes, ["trie", "node"], "left_anti") if crowded else dealt
        found.append(_walk(rest.withColumns({"low": F.lit(0), "high": F.lit(0)}), budget))
        if not crowded:
            break
        if depth == HALF:
            found.append(_walk(_blocked(dealt, sizes, full), budget))
            break
        within, depth = (sizes.select("trie", F.col("node").alias("_up")), depth), min(HALF, depth + DEEPER)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _blocked(dealt: DataFrame, sizes: DataFrame, full: int) -> DataFrame:
    """Nodes that no depth can split: every pair of blocks of a node becomes a unit of its own."""
    blocks = F.ceil(F.col("rows") * 2 / full).cast("int")
    mine = F.pmod(F.xxhash64("turned"), F.col("blocks")).cast("int")
    return (dealt.join(sizes.select("trie", "node", blocks.alias("blocks")), ["trie", "node"]).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("mine", "other", "blocks"))


def _walk(dealt: DataFrame, budget: int) -> DataFrame:
    return dealt.groupBy("trie", "node", "low", "high").applyInArrow(lambda t: _node_links(t, budget), "value long, root long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3,
                    budget: int = 3, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, kept`` and ``payload``.

    Fingerprints link at ``budget`` or fewer differing bits; ``component_id`` is the smallest id
    reachable over links, itself included. Texts without words have fingerprint zero and link like
    any other. ``kept`` marks exactly one row of each component, one with the smallest id. Null ids
    count as larger than any other; a component with null ids only has a null id. ``fingerprint``
    is the signed long. ``payload`` is a struct of the ``carry`` columns. No rows give no rows.
    """
    payload = F.struct(*[name(c) for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    plain = docs.select(name(id_column).alias("doc_id"), name(text_column).alias("_text"), payload.alias("payload"))
    with small_batches(docs.sparkSession):
        rows = stored(fingerprints(plain, width, "_text").drop("_text").withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    least = [F.min("doc_id").alias("first_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("first_row")]
    distinct = stored(rows.groupBy("fingerprint").agg(*least), "distinct")
    links = near_links(distinct, "fingerprint", budget)
    member = components(links, "value", "root")
    joined = stored(distinct.join(member, distinct["fingerprint"] == member["node"], "left").select(
        "fingerprint", "first_id", "first_row", F.coalesce("component", "fingerprint").alias("component")), "members")
    firsts = joined.groupBy("component").agg(
        F.min("first_id").alias("component_id"), F.coalesce(F.min_by("first_row", "first_id"), F.min("first_row")).alias("kept_row"))
    classes = stored(joined.join(firsts, "component").select("fingerprint", "component_id", "kept_row"), "classes")
    return rows.join(classes, "fingerprint").select(
        "doc_id", "fingerprint", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"), "payload")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3,
                         budget: int = 3) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates, all columns as they were."""
    return near_duplicates(docs, id_column, text_column, width, budget, docs.columns).where("kept").select("payload.*")
