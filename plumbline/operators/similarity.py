"""Near-duplicate values: which distinct values of a column are almost the same text.

Similarity is ``100 * (1 - levenshtein / longer length)`` on distinct values. Pairs are found by equi-joins, not by
comparing all values with all others. The shorter value of a pair within ``d`` edits is cut into ``d + 1`` segments; one of
them stands unchanged in the longer, at most so many places away as the edits on either side of it allow. A
segment that many values share, such as the name that all codes begin with, says little: there the rest of the values, without it,
must again be within ``d`` edits, so it is cut and joined in turn beside the segment, until few share what has been
joined or nothing is left to cut. What a value meets thus follows the values that are like it, not the number of values.

Values that may differ in more than ``SEGMENT_EDITS`` places would have too many places to look at. Of these, each sends its rarest overlapping
pieces: one edit touches at most ``q`` pieces of length ``q``, so a pair within ``d`` edits shares one of both's ``q * d + 1``
rarest. Either join returns a superset of the similar pairs; the exact distance then decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import name, string_columns, unused
from plumbline.operators.metrics import distinct_estimates
from plumbline.session import local_table, materialize

SEGMENT_EDITS = 8  # up to which values are cut into segments
SHARED = 16        # values that share what has been joined; beyond, the rest is joined, too,
ENOUGH = 200_000   # unless all that these would join at once is no more than this
AUDIT_LIMIT = 200  # distinct values per column that a whole audit compares; it names the columns it skips


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, freq)`` of every non-null value; combined map-side."""
    cells = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), name(c).cast("string").alias("value")) for c in columns]))
    return (df.select(cells).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq")))


def limited_values(df: DataFrame, columns: Sequence[str] | None, limit: int | None,
                   estimates: dict[str, int] | None = None) -> tuple[DataFrame, list[str]]:
    """Value counts of the columns with at least two distinct values, and the columns left out
    because they have more than ``limit`` (no limit: none).

    A sketch rules out the columns far beyond the limit before anything is grouped; the exact count
    then decides.
    """
    columns = string_columns(df) if columns is None else list(columns)
    if limit is not None:
        estimates = distinct_estimates(df, columns) if estimates is None else estimates
        near = [c for c in columns if estimates.get(c, 0) <= 2 * limit]
    else:
        near = columns
    counts = value_counts(df, near) if near else local_table(df.sparkSession, [], "column string, value string, freq bigint")
    counts = materialize(counts, "values") if near else counts
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = [c for c in columns if c not in near or limit is not None and sizes.get(c, 0) > limit]
    kept = [c for c in near if sizes.get(c, 0) >= 2 and c not in wide]
    return counts.where(F.col("column").isin(kept)), wide


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def _edits(length: Column, slack: float, of: float) -> Column:
    return F.floor(length * slack / of + F.lit(1e-9)).cast("int")


def _cut(length: Column, segment: Column) -> tuple[Column, Column]:
    """Where a segment of a text of this length begins, from 0, and how long it is: the last ones are longer by one."""
    parts = F.col("d") + 1
    plain = parts - length % parts
    base = F.floor(length / parts).cast("int")
    return segment * base + F.greatest(F.lit(0), segment - plain), base + (segment >= plain).cast("int")


def _without(rest: Column, begin: Column, size: Column) -> Column:
    return F.concat(F.substring(rest, F.lit(1), begin), F.substring(rest, begin + size + 1, F.length(rest)))


def _indexed(rows: DataFrame) -> DataFrame:
    """Every segment of ``rest`` as a key, with what is left; a text shorter than its segments' number goes by its length."""
    n, i = F.length("rest"), F.col("i")
    whole = n > F.col("d")
    cut = rows.withColumn("i", F.explode(F.when(whole, F.sequence(F.lit(0), F.col("d"))).otherwise(F.array(F.lit(-1)))))
    begin, size = _cut(n, i)
    key = F.when(i >= 0, F.xxhash64("key", n, "i", F.substring(F.col("rest"), begin + 1, size))).otherwise(F.xxhash64("key", n, "i"))
    return cut.select(key.alias("key"), "id", F.when(i >= 0, _without(F.col("rest"), begin, size)).otherwise(F.col("rest")).alias("rest"), "d")


def _probing(rows: DataFrame) -> DataFrame:
    """Every place of ``rest`` at which a segment of a text shorter by ``apart`` may stand, as a key, with what is left."""
    m, i, d, apart = F.length("rest"), F.col("i"), F.col("d"), F.col("apart")
    n = m - apart
    cut = rows.where(n > 0).withColumn("i", F.explode(F.when(n > d, F.sequence(F.lit(0), d)).otherwise(F.array(F.lit(-1)))))
    begin, size = _cut(n, i)
    # At most i edits lie before segment i and d - i behind it: both bound how far it may have moved.
    low = F.greatest(begin - i, begin + apart - (d - i), F.lit(0))
    high = F.least(begin + i, begin + apart + (d - i), m - size)
    at = F.col("at")
    placed = cut.withColumns({"low": F.when(i >= 0, low).otherwise(0), "high": F.when(i >= 0, high).otherwise(0)}).where("high >= low").withColumn(
        "at", F.explode(F.sequence("low", "high")))
    key = F.when(i >= 0, F.xxhash64("key", n, "i", F.substring(F.col("rest"), at + 1, size))).otherwise(F.xxhash64("key", n, "i"))
    return placed.select(key.alias("key"), "id", F.when(i >= 0, _without(F.col("rest"), at, size)).otherwise(F.col("rest")).alias("rest"), "d", "apart")


def _by_segments(named: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """``id_a, id_b``: pairs whose shorter value may have up to ``SEGMENT_EDITS`` edits; each once or more, in any order."""
    slack, key = 100 - threshold, F.xxhash64(*map(name, by), F.lit(0)).alias("key")
    indexed = named.where(F.col("edits") <= SEGMENT_EDITS).select(key, "id", F.col("value").alias("rest"), F.col("edits").alias("d"))
    probing = (named.select(key, "id", F.col("value").alias("rest"), "n", F.explode(F.sequence(F.lit(0), _edits(F.col("n"), slack, 100))).alias("apart"))
               .withColumn("d", _edits(F.col("n") - F.col("apart"), slack, threshold))
               .where((F.col("d") >= F.greatest(F.lit(1), "apart")) & (F.col("d") <= SEGMENT_EDITS)).drop("n"))
    found = []
    while True:
        indexed = materialize(_indexed(indexed), "segments")
        # All values of a key have as much left, and may differ in as many places.
        sizes = materialize(indexed.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) > SHARED) & (F.min(F.length("rest")) > F.min("d"))).alias("shared")), "segment-sizes")
        more = (sizes.where("shared").agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) > ENOUGH
        sizes = sizes.select("key", (F.col("shared") & F.lit(more)).alias("shared"))
        probing = materialize(_probing(probing).join(sizes, "key"), "places") if more else _probing(probing).join(sizes, "key")
        met = indexed.join(sizes.where("not shared"), "key").select("key", F.col("id").alias("id_a")).join(
            probing.where("not shared").select("key", F.col("id").alias("id_b")), "key")
        found.append(met.where("id_a <> id_b").select("id_a", "id_b"))
        if not more:
            return reduce(DataFrame.unionAll, found)
        indexed = indexed.join(sizes.where("shared").select("key"), "key", "left_semi")
        probing = probing.where("shared").drop("shared")


def _by_rarest_pieces(named: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """``id_a, id_b``: pairs that share one of the rarest pieces of both."""
    by, slack = list(by), 100 - threshold
    # With pieces of two characters every value of a pair that may differ has enough of them.
    q = 2 if threshold >= 75 else 1
    at = F.sequence(F.lit(1), F.col("n") - (q - 1))
    pieces = (named.where(F.col("n") >= q)
              .select(*by, "id", "n", "edits", F.posexplode(F.transform(at, lambda i: F.substring("value", i, F.lit(q)))).alias("at", "piece")))
    same = Window.partitionBy("id", "piece").orderBy("at")
    pieces = pieces.withColumn("nth", F.row_number().over(same)).drop("at")  # a repeated piece counts as often
    common = pieces.groupBy(*by, "piece", "nth").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    rarest = Window.partitionBy("id").orderBy(F.coalesce("freq", F.lit(1)), "piece", "nth")
    sent = (pieces.join(common, [*by, "piece", "nth"], "left").withColumn("rank", F.row_number().over(rarest))
            .where((F.col("rank") <= F.col("edits") * q + 1) & F.col("freq").isNotNull()).select(*by, "id", "n", "piece", "nth"))
    other = sent.select(*by, F.col("id").alias("id_b"), F.col("n").alias("n_b"), "piece", "nth")
    return (sent.withColumnRenamed("id", "id_a").join(other, [*by, "piece", "nth"])
            .where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("n") - F.col("n_b")) <= _edits(F.greatest("n", "n_b"), slack, 100)))
            .select("id_a", "id_b"))


def candidates(named: DataFrame, threshold: float, by: Sequence[str] = ("column",)) -> DataFrame:
    """``id_a, id_b``: a superset of the similar pairs of ``named`` (``by`` columns, ``id, value, n, edits``)."""
    found = [_by_segments(named, by, threshold)]
    long = named.where(F.col("edits") > SEGMENT_EDITS)
    if not long.isEmpty():
        found.append(_by_rarest_pieces(long, by, threshold))
    return reduce(DataFrame.unionAll, found)


def named_values(values: DataFrame, threshold: float, by: Sequence[str] = ("column",)) -> DataFrame:
    """The values that may have a partner, numbered, with their length and most edits to one that may be longer."""
    return materialize(values.select(*by, "value").withColumns({"id": F.monotonically_increasing_id(), "n": F.length("value")})
                       .withColumn("edits", _edits(F.col("n"), 100 - threshold, threshold)).where("edits > 0"), "named-values")


def similar_pairs(values: DataFrame, threshold: float, by: Sequence[str] = ("column",)) -> DataFrame:
    """Pairs ``value_a < value_b`` of distinct values with similarity >= ``threshold``, which is above 0.

    ``values`` holds the ``by`` columns and ``value``, one row per distinct value.
    """
    by, slack = list(by), 100 - threshold
    if threshold <= 0:
        raise ValueError("every pair is similar at a threshold of 0")
    named = named_values(values, threshold, by)
    # Pairs are small and their distances dear: a fixed number of partitions, which are not drawn together, keeps all cores at it.
    spark = values.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = (candidates(named, threshold, by).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
           .repartition(spread, "id_a", "id_b").distinct())
    texts = named.select(*by, "id", "value")
    both = (met.join(texts.select(*by, F.col("id").alias("id_a"), F.col("value").alias("x")), "id_a")
            .join(texts.select(F.col("id").alias("id_b"), F.col("value").alias("y")), "id_b"))
    longest = F.greatest(F.length("x"), F.length("y"))
    # The distance is given up, as -1, once it exceeds what the threshold allows.
    close = both.withColumn("distance", F.expr(
        f"levenshtein(x, y, cast(floor(greatest(length(x), length(y)) * {slack} / 100 + 1e-9) as int))")).where("distance >= 0")
    return close.select(*by, F.least("x", "y").alias("value_a"), F.greatest("x", "y").alias("value_b"),
                        (100.0 * (1 - F.col("distance") / longest)).alias("similarity"))


def similar_values(df: DataFrame, column: str, threshold: float = 90) -> DataFrame:
    """For each value with near-duplicates: the value and the group it would join."""
    values = value_counts(df, [column]).drop("freq")
    pairs = similar_pairs(values, threshold)
    both = pairs.select("column", "value_a", "value_b").unionAll(
        pairs.select("column", F.col("value_b").alias("value_a"), F.col("value_a").alias("value_b")))
    return both.groupBy("column", F.col("value_a").alias("value")).agg(
        F.count(F.lit(1)).alias("matches"), F.min("value_b").alias("first_match"), F.max("value_b").alias("last_match"))


def typo_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 85,
               limit: int | None = None) -> DataFrame:
    """Similar pairs in every string column, or in those of at most ``limit`` distinct values."""
    return similar_pairs(limited_values(df, columns, limit)[0].drop("freq"), threshold)


def _most_frequent_first(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes that come up when all are taken in order and each one taken rules out its later neighbours.

    ``nodes(column, value)`` are distinct; ``links(column, value, earlier)`` hold the neighbours before a
    value. A round takes every node with no earlier neighbour left and rules out what links to
    it, so the rounds follow the longest chain of neighbours; each is written to the shared folder.
    """
    key, taken = ["column", "value"], None
    nodes, links = materialize(nodes, "open-values"), materialize(links, "open-links")
    while not links.isEmpty():
        free = nodes.join(links, key, "left_anti")
        first = free.select("column", F.col("value").alias("earlier"))
        ruled_out = links.join(first, ["column", "earlier"], "left_semi").select(*key).distinct()
        done = materialize(free.withColumn("taken", F.lit(True)).unionAll(ruled_out.withColumn("taken", F.lit(False))), "settled")
        now = done.where("taken").select(*key)
        taken = now if taken is None else taken.unionAll(now)
        nodes = materialize(nodes.join(done, key, "left_anti"), "open-values")
        links = materialize(links.join(done, key, "left_anti").join(
            done.select("column", F.col("value").alias("earlier")), ["column", "earlier"], "left_anti").select(*key, "earlier"), "open-links")
    return nodes if taken is None else taken.unionAll(nodes)


def typo_corrections(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 94,
                     ratio: float = 0.80, limit: int | None = None) -> DataFrame:
    """``(column, value, replacement, freq)`` for rare spellings of a clearly more frequent value.

    Most frequent values go first, equal ones by text. A group whose two most frequent members are within
    ``ratio`` of each other is left alone, and so is a column beyond ``limit`` distinct values.
    Values, pairs and corrections stay tables: nothing that grows with the values reaches the driver.
    """
    return _corrections(limited_values(df, columns, limit)[0], threshold, ratio)


def _corrections(values: DataFrame, threshold: float, ratio: float) -> DataFrame:
    pairs = similar_pairs(values.drop("freq"), threshold)
    key = ["column", "value"]
    ends = F.inline(F.array(F.struct(F.col("value_a").alias("value"), F.col("value_b").alias("other")),
                            F.struct(F.col("value_b").alias("value"), F.col("value_a").alias("other"))))
    # A value's place in the order: the more frequent first, equal ones by text.
    placed = values.select(*key, F.struct((-F.col("freq")).alias("minus"), F.col("value").alias("text")).alias("place"))
    near = materialize(
        pairs.select("column", ends).join(placed, key)
        .join(placed.select("column", F.col("value").alias("other"), F.col("place").alias("other_place")), ["column", "other"]), "similar")
    # The two first of each value and its neighbours: the minimum, then the minimum of the rest.
    best = materialize(near.groupBy("column", "value").agg(F.first("place").alias("place"), F.min("other_place").alias("least"))
                       .withColumn("best", F.least("place", "least")), "best-values")
    rest = (near.join(best.select(*key, "best"), key).where(F.col("other_place") > F.col("best"))
            .groupBy(*key).agg(F.min("other_place").alias("next")))
    second = F.when(F.col("place") == F.col("best"), F.col("next")).otherwise(F.least("place", "next"))
    clear = materialize(best.join(rest, key, "left").withColumn("second", second)
                        .where(F.col("second.minus") / F.col("best.minus") < ratio).select(*key, "place", "best"), "clear-groups")
    earlier = (near.where(F.col("other_place") < F.col("place")).select(*key, F.col("other").alias("earlier"))
               .join(clear.select(*key), key, "left_semi")
               .join(clear.select("column", F.col("value").alias("earlier")), ["column", "earlier"], "left_semi").select(*key, "earlier"))
    groups = clear.join(_most_frequent_first(clear.select(*key), earlier), key, "left_semi")
    members = groups.select("column", F.col("place").alias("group"), "best", F.col("place").alias("member")).unionAll(
        near.select(*key, F.col("other_place").alias("member")).join(groups, key)
        .select("column", F.col("place").alias("group"), "best", "member"))
    # A value in several groups goes by the last of them.
    return materialize(
        members.where(F.col("member") != F.col("best")).groupBy("column", "member").agg(F.max(F.struct("group", "best")).alias("last"))
        .select("column", F.col("member.text").alias("value"), F.col("last.best.text").alias("replacement"),
                (-F.col("member.minus")).alias("freq")), "corrections")


def fix_typos(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 94,
              ratio: float = 0.80, limit: int | None = None) -> DataFrame:
    """Replace rare spellings by the frequent one: a join with the corrections per column that has any."""
    return fix_typos_within(df, limit, columns, threshold, ratio)[0]


def fix_typos_within(df: DataFrame, limit: int | None, columns: Sequence[str] | None = None, threshold: float = 94,
                     ratio: float = 0.80) -> tuple[DataFrame, list[str]]:
    """What :func:`fix_typos` makes of the table, and the columns left alone for more than ``limit`` distinct values."""
    values, wide = limited_values(df, columns, limit)
    corrections = _corrections(values, threshold, ratio)
    order, key, new = df.columns, unused(df.columns, "_value"), unused(df.columns, "_replacement")
    for r in corrections.select("column").distinct().orderBy("column").collect():  # a name per column
        own = corrections.where(F.col("column") == r["column"]).select(F.col("value").alias(key), F.col("replacement").alias(new))
        df = (df.join(own, name(r["column"]).cast("string") == F.col(key), "left")
              .withColumn(r["column"], F.coalesce(F.col(new), name(r["column"]))).drop(key, new))
    return df.select(*map(name, order)), wide
