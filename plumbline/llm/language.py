"""Language by cross-parsing: how few phrases of a language's sample text make up a text.

For each language a suffix automaton is built over sample text. A text is cut, from left to
right, into the longest phrases that occur somewhere in the sample; the language that needs the
fewest phrases for its length wins. The automata are built once on the driver from a bounded
sample and laid out as one transition array; a task walks all blocks of its texts in all
languages side by side, one byte at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import name

SAMPLE_ROWS = 200         # labelled rows learnt from, per language
SAMPLE_CHARS = 24_000     # most characters of sample text, per language
EVEN = 7 / 8              # samples this near in length are made equally long
ROW_CHARS = 1_000         # characters one row may give to the sample
LANGUAGES = 200           # languages that can be learnt
BLOCK = 1024              # bytes parsed in one go; each block begins a new phrase
STREAM = 4 << 20          # bytes parsed at once
NONE = "und"
PAD, SPACE = 0, 1
ALPHABET = 1 + 26 + 128   # symbols there are: the space, letters, bytes of other scripts
LETTER = regex.compile(r"\p{L}")


def _normal_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _symbols(text: bytes, table: np.ndarray) -> np.ndarray:
    """Letters as symbols; a run of anything else is one space."""
    coded = table[np.frombuffer(text, np.uint8)]
    return coded[~((coded == SPACE) & np.concatenate([[False], coded[:-1] == SPACE]))]


def _suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``sequence``; state 0 starts."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in sequence:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:  # split off the shorter substrings that end here
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


@dataclass(frozen=True)
class LanguageModel:
    """``steps[state * width + symbol]`` holds four times the next row plus the phrases that end.

    ``weights`` holds what a phrase found in a language's sample counts, and ``known`` which symbols
    the sample has: see :meth:`costs`.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    width: int
    starts: np.ndarray
    steps: np.ndarray
    weights: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, samples: dict[str, str]) -> LanguageModel:
        """Every language keeps its own sample, whatever the others have.

        Samples nearly as long as each other are made equally long, so that their counts compare as
        they are: one loses at most an eighth. Other lengths are evened out by :meth:`costs`.
        """
        raw = {k: _normal_bytes(v) for k, v in sorted(samples.items())}
        plain = np.full(256, SPACE, np.int64)
        plain[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = np.arange(2, 2 + 26 + 128)
        coded = {k: _symbols(v, plain) for k, v in raw.items()}
        lengths = [len(v) for v in coded.values()]
        coded = {k: v[:min(n for n in lengths if n >= EVEN * len(v))] for k, v in coded.items()}
        used = np.unique(np.concatenate([[SPACE], *coded.values()]))
        # Bytes in no sample share one symbol, which no phrase can hold.
        rank = np.zeros(2 + 26 + 128, np.int64) + len(used) + 1
        rank[used] = np.arange(1, len(used) + 1)
        table, width = rank[plain].astype(np.uint8), len(used) + 2
        bits = np.log([len(v) + ALPHABET for v in coded.values()])
        rows, starts = [], []
        known = np.zeros((len(coded), width), bool)
        for own, v in zip(known, coded.values()):
            own[rank[v]] = True
            moves = _suffix_automaton(rank[v].tolist())
            base = sum(map(len, rows))
            step = np.full((len(moves), width), -1, np.int64)
            for s, move in enumerate(moves):
                step[s, list(move)] = list(move.values())
            # No phrase goes on: it ends, and the symbol begins the next, or is one by itself.
            again = np.where(step[0] >= 0, (step[0] + base) * width * 4 + 1, base * width * 4 + 2)
            again[step[0] < 0] = base * width * 4 + 2
            filled = np.where(step >= 0, (step + base) * width * 4, again[None, :])
            filled[0] = np.where(step[0] >= 0, filled[0], base * width * 4 + 1)  # at the start nothing ends before
            filled[:, PAD] = (np.arange(len(moves)) + base) * width * 4
            rows.append(filled)
            starts.append(base * width)
        steps = np.concatenate(rows) if rows else np.zeros((0, width), np.int64)
        if steps.size and steps.max() >= 1 << 31:
            raise ValueError("the samples are too long for one array")
        return cls(tuple(raw), table, width, np.array(starts, np.int64), steps.reshape(-1).astype(np.int32),
                   bits / bits.max(initial=1), known)

    def phrases(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and symbols per text."""
        coded = [_symbols(t, self.table) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(coded)), blocks)
        lengths = np.minimum(sizes[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK, BLOCK)
        padded = np.full((len(owner), BLOCK), PAD, np.uint8)
        flat, at = padded.reshape(-1), 0
        for c, n in zip(coded, blocks.tolist()):
            flat[at * BLOCK:at * BLOCK + len(c)] = c
            at += n
        order = np.argsort(-lengths, kind="stable")  # the blocks still running are always the first
        columns = np.ascontiguousarray(padded[order].T)
        running = np.searchsorted(-lengths[order], -np.arange(BLOCK), "left")
        k = len(self.languages)
        state = np.repeat(self.starts[:, None], len(owner), axis=1)
        ended = np.zeros((k, len(owner)), np.int32)
        for t in range(int(lengths.max()) if len(lengths) else 0):
            n = running[t]
            step = self.steps[state[:, :n] + columns[t, :n]]
            ended[:, :n] += step & 3
            np.right_shift(step, 2, out=step)
            state[:, :n] = step
        ended += state != self.starts[:, None]  # the phrase a block ends in
        total = np.zeros((len(texts), k), np.int64)
        np.add.at(total, owner[order], ended.T)
        return total, sizes

    def costs(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language as if all samples were as long as the longest, and symbols per text.

        To name a place in a sample or a symbol takes the logarithm of their number, so a phrase found in
        a shorter sample counts less, by that ratio. A symbol that is not in the sample is a phrase
        by itself and counts one in every language.
        """
        counts, sizes = self.phrases(texts)
        if (self.weights == 1).all():
            return counts, sizes
        held = np.stack([np.bincount(_symbols(t, self.table), minlength=self.width) for t in texts])
        strange = held @ ~self.known.T
        return strange + (counts - strange) * self.weights, sizes

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float, float]]:
        """``(language, score, phrases per symbol)``: see :func:`with_language`."""
        out: list[tuple[str, float, float]] = []
        held: list[bytes | None] = []
        size = 0
        for i, text in enumerate(texts):
            readable = bool(text) and bool(self.languages) and LETTER.search(text) is not None
            held.append(_normal_bytes(text) if readable else None)
            size += len(held[-1] or b"")
            if size >= STREAM or i + 1 == len(texts):
                out += self._predict(held)
                held, size = [], 0
        return out

    def _predict(self, texts: list[bytes | None]) -> list[tuple[str, float, float]]:
        read = [t for t in texts if t is not None]
        if not read:
            return [(NONE, 0.0, 1.0)] * len(texts)
        counts, sizes = self.costs(read)
        least = counts.min(axis=1)
        share = 1 / np.exp(np.maximum(least[:, None] - counts, -700)).sum(axis=1)
        found = zip([self.languages[b] for b in counts.argmin(axis=1)], share.tolist(), (least / sizes).tolist())
        return [(NONE, 0.0, 1.0) if t is None else next(found) for t in texts]


def fit(docs: DataFrame, learn: Column, text_column: str = "text", lang_column: str = "lang", languages: int = LANGUAGES,
        sample_rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Learn from the rows where ``learn`` holds: up to ``sample_rows`` different texts per language are picked,
    the one with the smallest hash in each class of hashes. Each gives its first ``row_chars`` characters; they are
    joined in order of their signed hash and cut to ``sample_chars`` characters, so of long texts only the first few
    are learnt from. Rows without language or text, and those with no letter, teach nothing.
    Of more than ``languages`` labels those with most characters of text are learnt, of equal ones the first by name.
    """
    rows = docs.where(learn & name(lang_column).isNotNull() & name(text_column).rlike(r"\p{L}")).select(
        name(lang_column).cast("string").alias("lang"), F.xxhash64(name(text_column)).alias("hash"), name(text_column).alias("text"))
    labels = rows.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("size")).orderBy(F.desc("size"), "lang").limit(languages)
    known = sorted(r["lang"] for r in labels.select("lang").collect())  # at most ``languages``
    rows = rows.where(F.col("lang").isin(known)).withColumn("text", F.left("text", F.lit(row_chars)))
    # The smallest hash of each of the classes of hashes: different texts, combined map-side.
    picked = rows.groupBy("lang", F.pmod("hash", F.lit(sample_rows)).alias("class")).agg(F.min("hash").alias("hash")).drop("class")
    # At most ``sample_rows`` rows for each of ``languages``; copies of a picked text are one group, combined map-side.
    some = rows.join(F.broadcast(picked), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    samples: dict[str, str] = {}
    for r in some.orderBy("lang", "hash").toLocalIterator():
        had = samples.get(r["lang"])
        if had is None or len(had) < sample_chars:
            samples[r["lang"]] = r["text"] if had is None else f"{had}\n{r['text']}"
    return LanguageModel.of({k: v[:sample_chars] for k, v in samples.items()})


def with_language(docs: DataFrame, model: LanguageModel, text_column: str = "text", alias: str = "language") -> DataFrame:
    """``docs`` with ``alias``: a struct of ``lang_pred``, ``score`` and ``phrase_rate``. A column of that name is replaced.

    Nothing but the whole text is read. Phrases count as in :meth:`LanguageModel.costs`: one each where
    all samples are equally long. ``lang_pred`` is the language with the fewest phrases, the
    first by name if several tie; ``und`` where the text is null or has no letter, or nothing was
    learnt. ``score`` is the share of ``exp(-phrases)`` that the winner holds (0 for ``und``, at
    least one part in the number of languages otherwise). ``phrase_rate`` is the winner's phrases
    per symbol: near 1 for text unlike any sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double, phrase_rate double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame(own, columns=["lang_pred", "score", "phrase_rate"])

    return docs.withColumn(alias, predict(name(text_column).cast("string")))


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the row is kept from learning: crc32 of the id as text, modulo 3, is 1. False for a null id."""
    return F.coalesce(F.crc32(name(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
