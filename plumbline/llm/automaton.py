"""One minimal deterministic automaton for many regular expressions, and its scan of whole batches.

Patterns are written in a small regular language: literals, escapes, classes, groups, ``|`` and
the quantifiers ``? * + {m} {m,} {m,n}``. They are compiled to a nondeterministic automaton over
bytes, joined, made deterministic by subset construction, and minimised by refining classes of
states. What remains is one array: next state by state and class of bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

ALL = frozenset(range(256))
ESCAPES = {"n": {10}, "t": {9}, "r": {13}, "d": set(range(48, 58)), "s": {9, 10, 11, 12, 13, 32},
           "w": {*range(48, 58), *range(65, 91), 95, *range(97, 123)}}
SEPARATOR = 0xFF          # in no UTF-8 text, so between two texts every pattern falls back to its start
LANE = 1024               # bytes one lane of a scan holds


class _Parser:
    """Recursive descent; each method returns the (start, end) of a fragment of the automaton."""

    def __init__(self, nfa: _Nfa, pattern: str, ignore_case: bool):
        self.nfa, self.pattern, self.at, self.ignore_case = nfa, pattern, 0, ignore_case

    def parse(self) -> tuple[int, int]:
        out = self._choice()
        if self.at != len(self.pattern):
            raise ValueError(f"unexpected {self.pattern[self.at]!r} at {self.at} in {self.pattern!r}")
        return out

    def _peek(self) -> str:
        return self.pattern[self.at:self.at + 1]

    def _take(self) -> str:
        if self.at >= len(self.pattern):
            raise ValueError(f"{self.pattern!r} ends too early")
        self.at += 1
        return self.pattern[self.at - 1]

    def _choice(self) -> tuple[int, int]:
        options = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]
        start, end = self.nfa.state(), self.nfa.state()
        for a, b in options:
            self.nfa.skip(start, a)
            self.nfa.skip(b, end)
        return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self._peek() not in ("", "|", ")"):
            begun = self.at
            a, b = self._atom()
            low, high = self._quantifier()
            done = self.at
            for k in range(max(low, high or 0, 1)):
                if k:  # another copy of the same atom
                    self.at = begun
                    a, b = self._atom()
                self.nfa.skip(end, a)
                if k >= low:
                    self.nfa.skip(a, b)
                end = b
            if high is None:
                self.nfa.skip(b, a)
            if not low and high == 0:
                raise ValueError("a quantifier of zero")
            self.at = done
        return start, end

    def _quantifier(self) -> tuple[int, int | None]:
        mark = self._peek()
        if mark in ("?", "*", "+"):
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        if mark == "{":
            until = self.pattern.index("}", self.at)
            low, comma, high = self.pattern[self.at + 1:until].partition(",")
            self.at = until + 1
            return int(low), int(high) if high else (None if comma else int(low))
        return 1, 1

    def _atom(self) -> tuple[int, int]:
        c = self._take()
        if c == "(":
            if self.pattern.startswith("?:", self.at):
                self.at += 2
            inner = self._choice()
            if self._take() != ")":
                raise ValueError(f"an open group in {self.pattern!r}")
            return inner
        if c == "[":
            return self._bytes(self._class())
        if c == "\\":
            return self._bytes(self._escape())
        if c == ".":
            return self._bytes(set(ALL - {10, SEPARATOR}))
        start = end = self.nfa.state()
        for b in c.encode():
            following = self.nfa.state()
            self.nfa.step(end, self._cases({b}), following)
            end = following
        return start, end

    def _bytes(self, values: set[int]) -> tuple[int, int]:
        start, end = self.nfa.state(), self.nfa.state()
        self.nfa.step(start, self._cases(values), end)
        return start, end

    def _cases(self, values: set[int]) -> frozenset[int]:
        letters = {b ^ 32 for b in values if 65 <= b & ~32 <= 90} if self.ignore_case else set()
        return frozenset(values | letters)

    def _escape(self) -> set[int]:
        c = self._take()
        if c == "x":
            return {int(self._take() + self._take(), 16)}
        if c in ESCAPES:
            return set(ESCAPES[c])
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return {ord(c)}

    def _class(self) -> set[int]:
        negated, values, first = self._peek() == "^", set(), True
        self.at += negated
        while self._peek() != "]" or first:
            first, c = False, self._take()
            some = self._escape() if c == "\\" else {ord(c)}
            if self._peek() == "-" and self.pattern[self.at + 1:self.at + 2] not in ("]", "") and len(some) == 1:
                self.at += 1
                top = self._take()
                some = set(range(min(some), (min(self._escape()) if top == "\\" else ord(top)) + 1))
            values |= some
        self.at += 1
        if max(values, default=0) > 127:
            raise ValueError("classes hold ASCII only")
        return set(range(128)) - values if negated else values


class _Nfa:
    def __init__(self):
        self.skips: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.skips.append([])
        self.steps.append([])
        return len(self.skips) - 1

    def skip(self, a: int, b: int) -> None:
        self.skips[a].append(b)

    def step(self, a: int, values: frozenset[int], b: int) -> None:
        self.steps[a].append((values, b))

    def closures(self) -> list[int]:
        """For each state, the states reached without a byte, as bits."""
        out = []
        for s in range(len(self.skips)):
            seen, todo = {s}, [s]
            while todo:
                for following in self.skips[todo.pop()]:
                    if following not in seen:
                        seen.add(following)
                        todo.append(following)
            out.append(sum(1 << x for x in seen))
        return out


@dataclass(frozen=True)
class Automaton:
    """``next[state * classes + class_of[byte]]`` is the next state times ``classes``.

    ``accepts[state]`` has bit ``i`` set where pattern ``i`` may end. States that accept anything
    come last, from ``first_accept`` on; state ``start`` is where a text begins; a dead state, if
    there is one, is its own only successor.
    """

    next: np.ndarray
    class_of: np.ndarray
    classes: int
    accepts: np.ndarray
    start: int
    first_accept: int
    dead: int

    @cached_property
    def lists(self) -> tuple[list[int], list[int], int]:
        """The arrays as plain lists, which are faster for one byte at a time."""
        return self.next.tolist(), self.class_of.tolist(), self.first_accept * self.classes


def compile_patterns(patterns: Sequence[tuple[str, bool]], anywhere: bool) -> Automaton:
    """The minimal automaton of all ``(pattern, ignore_case)``; with ``anywhere`` a match may begin at any byte."""
    nfa = _Nfa()
    start, ends = nfa.state(), []
    for pattern, ignore_case in patterns:
        a, b = _Parser(nfa, pattern, ignore_case).parse()
        nfa.skip(start, a)
        ends.append(b)
    closure = nfa.closures()
    sets = {values for steps in nfa.steps for values, _ in steps}
    shapes: dict[tuple[bool, ...], int] = {}
    class_of = np.array([shapes.setdefault(tuple(b in s for s in sets), len(shapes)) for b in range(256)], np.uint8)
    sample = [int(np.argmax(class_of == k)) for k in range(len(shapes))]
    moves = [[0] * len(sample) for _ in nfa.steps]
    for s, steps in enumerate(nfa.steps):
        for values, b in steps:
            for k, byte in enumerate(sample):
                if byte in values:
                    moves[s][k] |= closure[b]
    first = closure[start]
    known, rows, todo = {first: 0}, [], [first]
    for subset in todo:
        row, left = [first if anywhere else 0] * len(sample), subset
        while left:
            low = left & -left
            for k, reached in enumerate(moves[low.bit_length() - 1]):
                row[k] |= reached
            left ^= low
        for reached in row:
            if reached not in known:
                known[reached] = len(known)
                todo.append(reached)
        rows.append([known[reached] for reached in row])
    table = np.array(rows, np.int64)
    accepts = np.array([sum(1 << i for i, e in enumerate(ends) if subset >> e & 1) for subset in todo], np.int64)
    return _minimal(table, accepts, class_of)


def _minimal(table: np.ndarray, accepts: np.ndarray, class_of: np.ndarray) -> Automaton:
    """Classes of states are split by where their bytes lead until nothing splits."""
    label = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    shown = np.unique(label, return_index=True)[1]
    order = np.argsort(accepts[shown] != 0, kind="stable")      # accepting states last
    place = np.argsort(order)
    small, classes = place[label[table[shown]]][order], table.shape[1]
    kinds = accepts[shown][order]
    own = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (kinds == 0))
    return Automaton((small * classes).reshape(-1), class_of, classes, kinds, int(place[label[0]]),
                     int((kinds == 0).sum()), int(own[0]) if len(own) else -1)


def accepting(auto: Automaton, stream: bytes | bytearray) -> tuple[np.ndarray, np.ndarray]:
    """Where the automaton accepts on one pass over ``stream``, and the states there.

    The stream is cut into lanes that advance together, one byte each. A lane that does not begin
    at the start takes its first state for the start state; afterwards lanes whose forerunner ended
    elsewhere are run again from there until they meet what was noted, which is soon.
    """
    n = len(stream)
    lanes = max(1, -(-n // LANE))
    padded = np.full(lanes * LANE, SEPARATOR, np.uint8)
    padded[:n] = np.frombuffer(stream, np.uint8)
    symbols = np.ascontiguousarray(auto.class_of[padded].reshape(lanes, LANE).T)
    start = auto.start * auto.classes
    states = np.empty((LANE, lanes), np.int32)
    state, at = np.full(lanes, start, np.int64), np.empty(lanes, np.int64)
    for t in range(LANE):
        np.add(state, symbols[t], out=at)
        np.take(auto.next, at, out=state, mode="clip")
        states[t] = state
    entered = np.full(lanes, start, np.int64)
    while True:
        true = np.concatenate([[start], states[-1, :-1]])
        wrong = np.flatnonzero(true != entered)
        if not len(wrong):
            break
        entered[wrong] = true[wrong]
        state = true[wrong]
        for t in range(LANE):
            state = auto.next[state + symbols[t, wrong]]
            differs = state != states[t, wrong]
            states[t, wrong] = state
            wrong, state = wrong[differs], state[differs]
            if not len(wrong):
                break
    t, lane = np.nonzero(states >= auto.first_accept * auto.classes)
    where = lane * LANE + t
    order = np.argsort(where)
    return where[order], (states[t, lane] // auto.classes)[order]


def longest(auto: Automaton, text: bytes, at: int) -> tuple[int, list[int]]:
    """End of the longest match that begins at ``at`` (-1: none), and all ends on the way."""
    state, dead, ends = auto.start * auto.classes, auto.dead * auto.classes, []
    table, class_of, first = auto.lists
    if auto.accepts[auto.start]:
        ends.append(at)
    for i in range(at, len(text)):
        state = table[state + class_of[text[i]]]
        if state == dead:
            break
        if state >= first:
            ends.append(i + 1)
    return (ends[-1] if ends else -1), ends
