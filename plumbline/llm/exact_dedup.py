"""Exact duplicates by distributed most-significant-digit radix partitioning.

All texts start in one group. A round cuts the next bytes off every text still in play and
splits its group by them; a text alone in its group is done, and so is a group whose texts
have ended. Equality is decided by the bytes alone. Digits widen from round to round, so
the number of rounds grows with the logarithm of the longest repeated text, and only texts
that still share a whole prefix with another are carried on.

A group is never gathered: a round counts ``(group, digit)`` with map-side combine, stores
the counts that are not 1, and joins them back. Both sides of that join are plain stored
tables, so a group that holds a third of all rows is split by the adaptive skew join. The join
is a merge at every size: what it joins grows with the data, so it is never broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.llm.common import body, stored

FIRST_DIGIT = 64   # bytes compared in the first round
WIDER = 8          # each round compares so many times the bytes of the round before


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``payload``.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal texts the row with
    the largest id is kept: exactly one row, also where rows repeat whole. Null ids count as
    smaller than any other; a group with null ids only has a null ``keep_id``. ``payload`` is a
    struct of the ``carry`` columns (none by default), so other columns may have any name. The
    digest is a column of the result; it decides nothing. An empty table gives no rows.
    """
    others = [c for c in carry or [] if c != text_column]
    with_text = len(others) < len(carry or [])
    rows = docs.select(
        name(id_column).alias("doc_id"), F.sha2(body(text_column), 256).alias("text_sha256"), name(text_column).cast("string").alias("body"),
        (F.struct(*[name(c) for c in others]) if others else F.lit(None).cast("struct<none:int>")).alias("others"))
    open_rows, results = _first_round(rows, with_text), []
    results.append(_done(open_rows))
    begin, width = FIRST_DIGIT, FIRST_DIGIT
    while True:
        active = open_rows.where("state = 'open'")
        if active.isEmpty():
            break
        width *= WIDER
        open_rows = _next_round(active, begin, width, with_text)
        begin += width
        results.append(_done(open_rows))
    # The text is carried once; it goes back among the other columns.
    payload = F.struct(*[F.col("body").alias(c) if c == text_column else F.col("others")[c].alias(c) for c in carry]) if carry else F.col("others")
    return reduce(DataFrame.unionByName, results).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", payload.alias("payload"))


def _digit(begin: int, width: int) -> Column:
    return F.substring(F.coalesce("body", F.lit("")).cast("binary"), begin + 1, width)


def _first_round(rows: DataFrame, with_text: bool) -> DataFrame:
    """Counts only: nothing but first bytes is shuffled to find the groups worth carrying on."""
    shared = stored(rows.select(_digit(0, FIRST_DIGIT).alias("digit")).groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("digit", F.monotonically_increasing_id().alias("next")), "digits")
    joined = rows.withColumn("digit", _digit(0, FIRST_DIGIT)).join(shared.hint("merge"), "digit", "left")
    alone = F.col("next").isNull()
    return stored(joined.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", "others",
        (F.col("body") if with_text else F.when(~alone, F.col("body"))).alias("body"), F.col("next").alias("node"),
        F.when(alone, F.col("doc_id")).alias("keep_id"), F.when(alone, F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).alias("kept"),
        F.when(alone, F.lit("done")).otherwise(F.lit("open")).alias("state")), "radix", "state")


def _next_round(active: DataFrame, begin: int, width: int, with_text: bool) -> DataFrame:
    cut = active.drop("keep_id", "group_size", "kept", "state").withColumn("digit", _digit(begin, width))
    shared = stored(cut.groupBy("node", "digit").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_id"),
        F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("last_row"))
        .where("n > 1").withColumn("next", F.monotonically_increasing_id()), "digits")
    joined = cut.join(shared.hint("merge"), ["node", "digit"], "left")
    alone = F.col("next").isNull()
    ended = ~alone & (F.length("digit") < width)
    going = ~alone & ~ended
    return stored(joined.select(
        "row", "doc_id", "text_sha256", "others", (F.col("body") if with_text else F.when(going, F.col("body"))).alias("body"),
        F.when(going, F.col("next")).alias("node"),
        F.when(alone, F.col("doc_id")).when(ended, F.col("last_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).when(ended, F.col("n")).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).when(ended, F.col("row") == F.col("last_row")).alias("kept"),
        F.when(going, F.lit("open")).otherwise(F.lit("done")).alias("state")), "radix", "state")


def _done(rows: DataFrame) -> DataFrame:
    return rows.where("state = 'done'").select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "others", "body")


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    return exact_groups(docs, id_column, text_column, docs.columns).where("kept").select("payload.*")
