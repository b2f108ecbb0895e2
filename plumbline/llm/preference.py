"""Preference pairs: the turns both conversations begin with as prompt, what follows as completions.

Turns are put in order once, over all pairs, and numbered from there, so a conversation that holds
a third of all turns is ordered by many tasks. Chosen and rejected turns meet on their number;
the first number where they differ ends the prompt. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.operators.ordering import global_index

CHUNK = 256               # turns per output row; longer pairs go on in further rows
BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"      # the role whose words carry loss in a completion


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, the 0-based number of a turn in its side of its pair."""
    ordered = stored(global_index(turns, ["pair_id", "side", "turn"], "at"), "turns")
    first = stored(ordered.groupBy("pair_id", "side").agg(F.min("at").alias("first")), "first-turns")
    return ordered.join(first, ["pair_id", "side"]).withColumn("pos", F.col("at") - F.col("first"))


def common_prefix(turns: DataFrame) -> DataFrame:
    """Turns of both sides met on their number: ``pair_id, pos, chosen, rejected, prefix``.

    ``chosen`` and ``rejected`` are structs of role and text, null where that side has ended, and
    ``prefix`` is how many turns both sides begin with.
    """
    numbered = _numbered(turns.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')").select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    said = F.struct("role", "text")
    chosen = numbered.where("side = 'chosen'").select("pair_id", "pos", said.alias("chosen"))
    rejected = numbered.where("side = 'rejected'").select("pair_id", "pos", said.alias("rejected"))
    met = stored(chosen.join(rejected, ["pair_id", "pos"], "full"), "met")
    alike = F.coalesce((F.col("chosen.role") == F.col("rejected.role")) & (F.col("chosen.text") == F.col("rejected.text")), F.lit(False))
    prefix = stored(met.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~alike, F.col("pos"))), F.max("pos") + 1).alias("prefix")), "prefix")
    return met.join(prefix, "pair_id")


def format_pairs(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Paired masked completions of ``turns(pair_id, side, turn, role, text)``.

    One row per pair and ``chunk`` turns: ``prompt`` is the longest common prefix of turns, rendered
    once; ``chosen`` and ``rejected`` are what follows; the masks are ``(start, end)`` spans of
    their characters, end exclusive, that carry loss: the assistant's words with their end mark.
    Nothing in a prompt carries loss. Sides that are equal have empty completions; a missing side
    has an empty one and leaves no prompt. Null roles and texts count as empty; turns follow
    ``turn``, null first, repeated numbers in an order of their content. Turns without a pair or of
    another side are left out. Other columns are not read.
    """
    met = common_prefix(turns)
    in_prompt = F.col("pos") < F.col("prefix")
    parts = met.select("pair_id", (F.floor(F.col("pos") / chunk)).alias("chunk"), "pos", F.explode(F.filter(F.array(
        F.struct(F.when(in_prompt, "prompt").otherwise("chosen").alias("part"), F.col("chosen").alias("said")),
        F.struct(F.when(~in_prompt, "rejected").alias("part"), F.col("rejected").alias("said"))),
        lambda p: p["part"].isNotNull() & p["said"].isNotNull())).alias("p"))
    head = F.concat(F.lit(BEGIN), F.col("p.said.role"), F.lit("\n"))
    rendered = parts.select("pair_id", "chunk", F.col("p.part").alias("part"), F.struct(
        "pos", head.alias("head"), F.concat(F.col("p.said.text"), F.lit(END)).alias("content"),
        ((F.col("p.said.role") == LEARNT) & (F.col("p.part") != "prompt")).alias("learnt")).alias("turn"))
    # At most ``chunk`` turns of each part meet in a group.
    grouped = rendered.groupBy("pair_id", "chunk").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("turn")))).alias(p) for p in ("prompt", "chosen", "rejected")])
    return grouped.select(
        "pair_id", "chunk", *[_joined(p).alias(p) for p in ("prompt", "chosen", "rejected")],
        *[_mask(p).alias(f"{p}_mask") for p in ("chosen", "rejected")],
        *[F.size(p).cast("long").alias(f"{p}_turns") for p in ("prompt", "chosen", "rejected")])


def _joined(part: str) -> Column:
    return F.array_join(F.transform(part, lambda t: F.concat(t["head"], t["content"], F.lit("\n"))), "")


def _mask(part: str) -> Column:
    span = "array<struct<start:long,end:long>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["content"])
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["learnt"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(part, start, add, lambda acc: acc["spans"])
