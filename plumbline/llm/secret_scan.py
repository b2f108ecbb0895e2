"""Secrets found by one automaton for all rules.

Every whole text goes byte by byte through one minimal automaton of all rules (:mod:`automaton`),
whatever their number. It accepts where a match that will be kept has shown its head and the
first bytes of its tail, so nearly all texts are done after that pass. A text where a rule accepts is then cut into that rule's leftmost
non-overlapping matches by the rule's own automaton.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.llm import automaton
from plumbline.llm.automaton import Automaton, compile_patterns
from plumbline.llm.common import body, unused

SPANS = "array<struct<kind:string,start:long,end:long>>"
STREAM = 8 << 20          # bytes scanned at once; one longer text is a stream of its own
HINT = 8                  # tail bytes after which the automaton for all rules takes a match for possible


@dataclass(frozen=True)
class Rule:
    """``head`` followed by one or more bytes of class ``tail`` (or ``head`` alone without a tail).

    Matches are leftmost, as long as possible, and do not overlap. One whose tail is shorter than
    ``least`` uses up its text but is dropped.
    """

    kind: str
    head: str
    tail: str = ""
    least: int = 1
    ignore_case: bool = False

    @property
    def whole(self) -> str:
        return f"(?:{self.head}){self.tail}+" if self.tail else self.head

    @property
    def hint(self) -> str:
        """Ends in every match that is kept: the whole of a short one, the begin of a long one."""
        return f"(?:{self.head}){self.tail}{{{min(self.least, HINT)},}}" if self.tail else self.head


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
RULES = (
    *BASE_RULES,
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


@dataclass(frozen=True)
class Scanner:
    """The compiled rules: one automaton for all, and per rule one for its matches and one for its head."""

    rules: tuple[Rule, ...]
    all: Automaton
    whole: tuple[Automaton, ...]
    heads: tuple[Automaton, ...]

    @classmethod
    def of(cls, rules: Sequence[Rule]) -> Scanner:
        if any(r.tail == "" and r.head == "" for r in rules):
            raise ValueError("a rule must match something")
        return cls(tuple(rules), compile_patterns([(r.hint, r.ignore_case) for r in rules], anywhere=True),
                   tuple(compile_patterns([(r.whole, r.ignore_case)], anywhere=False) for r in rules),
                   tuple(compile_patterns([(r.head, r.ignore_case)], anywhere=False) for r in rules))

    def scan(self, texts: Sequence[str]) -> list[list[tuple[str, int, int]]]:
        """Per text the kept spans in code points, by start, then in the order of the rules."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        held, size, first = [], 0, 0
        for i, text in enumerate(texts):
            held.append(text.encode("utf-8", "surrogatepass"))
            size += len(held[-1]) + 1
            if size >= STREAM or i + 1 == len(texts):
                self._scan_stream(held, found, first)
                held, size, first = [], 0, i + 1
        return found

    def _scan_stream(self, raw: list[bytes], found: list, first: int) -> None:
        begins = np.cumsum([0] + [len(r) + 1 for r in raw])
        where, states = automaton.accepting(self.all, bytes([automaton.SEPARATOR]).join(raw))
        if not len(where):
            return
        owner = np.searchsorted(begins, where, "right") - 1
        kinds = np.zeros(len(raw), np.int64)
        np.bitwise_or.at(kinds, owner, self.all.accepts[states])
        for i in np.flatnonzero(kinds).tolist():
            spans = [(a, r, b) for r in range(len(self.rules)) if kinds[i] >> r & 1 for a, b in self._matches(r, raw[i])]
            points = _code_points(raw[i], sorted({x for a, _, b in spans for x in (a, b)}))
            found[first + i] = [(self.rules[r].kind, points[a], points[b]) for a, r, b in sorted(spans)]

    def _matches(self, r: int, text: bytes) -> list[tuple[int, int]]:
        auto, out, at = self.whole[r], [], 0
        opens = auto.next[auto.start * auto.classes + auto.class_of.astype(np.int64)] != auto.dead * auto.classes
        may = np.flatnonzero(opens[np.frombuffer(text, np.uint8)])  # bytes that can begin a match
        for begin in may.tolist():
            if begin < at:
                continue
            end, _ = automaton.longest(auto, text, begin)
            if end > begin:
                at = end
                if self._tail(r, text, begin, end) >= self.rules[r].least:
                    out.append((begin, end))
        return out

    def _tail(self, r: int, text: bytes, begin: int, end: int) -> int:
        """Length of what follows the longest head that leaves a tail."""
        if not self.rules[r].tail:
            return end - begin
        _, heads = automaton.longest(self.heads[r], text[:end], begin)
        return end - max(h for h in heads if h < end)


def _code_points(text: bytes, offsets: list[int]) -> dict[int, int]:
    points, at, n = {}, 0, 0
    for x in offsets:
        n += len(text[at:x].decode("utf-8", "surrogatepass"))
        points[x], at = n, x
    return points


def secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text_column: str = "text", alias: str = "secrets") -> DataFrame:
    """``docs`` with ``alias``: an array of ``(kind, start, end)`` in code points, end exclusive.

    Ordered by start, then as the rules are listed; empty where nothing is found. A null text
    counts as empty. Rules are compiled once on the driver; a row sees nothing but its own text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner.of(rules))  # bounded by the rules

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in shared.value.scan(texts.tolist())],
                         index=texts.index, dtype=object)

    return docs.withColumn(alias, find(body(text_column)))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span, overlapping ones as one, replaced by ``mask``. Null texts stay null."""
    spans = unused(docs, "_secrets")
    found = secrets(docs, rules, text_column, spans)
    merged = F.aggregate(spans, F.array().cast("array<struct<start:long,end:long>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (s["start"] < F.element_at(done, -1)["end"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    text = name(text_column)
    cleaned = F.aggregate(merged, F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")), lambda acc, s: F.struct(
        F.concat(acc["text"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)).alias("text"),
        s["end"].alias("at")), lambda acc: F.concat(acc["text"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text_column, F.when(F.size(spans) > 0, cleaned).otherwise(text)).select(*[name(c) for c in docs.columns])
