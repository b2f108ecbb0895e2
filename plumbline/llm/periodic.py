"""Runs of words that repeat with a period, found through minimizers at doubling scales.

Inside a run of period q a window's smallest hash comes back q words later. At the scale Q (Q/2 < q <= Q) the
hashes are those of Q words in a row, which inside a run of at least 4 q words are equal at multiples of q only,
and the windows are Q/2 + 1 such hashes long. So two windows q apart, both inside the run, choose places q apart that
follow each other among the chosen places of equal hash: such pairs at distances of the scale are the seeds. A seed is
extended word by word both ways as far as words q apart are identical, which also checks it; what has a smaller period
is left to that one. Periods up to ``SHORT`` are found by comparing the text with itself that many words later.

Hashes of 2 Q words come from two of Q words, so a scale costs a few passes over the texts that are long enough for it.
Texts of a batch are taken in one stream, parted by codes that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.functions.columns import name
from plumbline.llm.common import body
from plumbline.llm.tokens import pieces_of

SHORT = 8                    # periods found by direct lag scans; scales double from here
EXPONENT, LEAST = 4, 6       # a run has at least so many periods, and so many words
PLACE = np.uint64((1 << 30) - 1)  # bits of a window minimum that hold its place
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[0]
    return h ^ (h >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - span:]) if width > span else out


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal stretch of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _extent(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` of places whose word equals the one ``lag`` later; empty if ``at`` is none."""
    ends = []
    for step in (1, -1):
        place, size = at if step > 0 else at - 1, 32
        while True:
            until = min(len(codes) - lag, place + size) if step > 0 else max(-1, place - size)
            if place == until:
                break
            low, high = (place, until) if step > 0 else (until + 1, place + 1)
            differs = codes[low:high] != codes[low + lag:high + lag]
            if differs.any():
                place = low + int(differs.argmax()) if step > 0 else high - 1 - int(differs[::-1].argmax())
                break
            place, size = until, size * 2
        ends.append(place)
    return ends[1] + 1, ends[0]


def _primitive(codes: np.ndarray, begin: int, end: int, period: int) -> bool:
    """Whether no divisor of ``period`` is a period of this stretch, too."""
    rest, factor = period, 2
    while rest > 1:
        factor = factor if factor * factor <= rest else rest
        if rest % factor:
            factor += 1
            continue
        lag = period // factor
        if np.array_equal(codes[begin:end - lag], codes[begin + lag:end]):
            return False
        while rest % factor == 0:
            rest //= factor
    return True


def _seeds(hashes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal window minima that follow each other, and their distance, where it belongs to the scale."""
    places = np.arange(len(hashes), dtype=np.uint64)
    chosen = window_minima((hashes & ~PLACE) | places, scale // 2 + 1) & PLACE
    chosen = chosen[np.flatnonzero(np.diff(chosen, prepend=~chosen[:1]))].astype(np.int64)
    order = np.argsort(hashes[chosen], kind="stable")
    at, value = chosen[order], hashes[chosen][order]
    apart = np.diff(at)
    seed = (value[1:] == value[:-1]) & (apart > scale // 2) & (apart <= scale)
    return at[:-1][seed], apart[seed]


def _longer(codes: np.ndarray, sizes: np.ndarray, short: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of equal words at lags beyond ``short``: ``begin, end, lag``; ``end`` is where the last period begins.

    ``sizes`` are the lengths of the parts of ``codes``, separators included.
    """
    where = np.arange(len(codes))
    inner, hashes, width, scale = codes, _mixed(codes.astype(np.int64).view(np.uint64) + MIX[1]), 1, 2 * short
    seen: dict[int, tuple[int, int]] = {}
    while True:
        enough = sizes > EXPONENT * (scale // 2 + 1)
        if not enough.any():
            return
        if not enough.all():  # shorter texts can have no run of these periods
            keep = np.repeat(enough, sizes)
            where, inner = where[keep], inner[keep]
            hashes, sizes = hashes[keep[:len(hashes)]], sizes[enough]
        while width < scale:
            hashes = _mixed(hashes[:len(hashes) - width] * MIX[1] + hashes[width:])
            width *= 2
        if len(hashes) > scale // 2:
            at, lags = _seeds(hashes, scale)
            order = np.lexsort((at, lags))
            for place, lag in zip(where[at[order]].tolist(), lags[order].tolist()):
                if lag in seen and seen[lag][0] <= place < seen[lag][1]:
                    continue
                begin, end = _extent(codes, place, lag)
                if end > begin:
                    seen[lag] = begin, end
                    yield begin, end, lag
        scale *= 2


def find_runs(codes: np.ndarray, sizes: np.ndarray | None = None, short: int = SHORT) -> np.ndarray:
    """Rows ``start, length, period`` of all runs in ``codes``, in order of start, then period.

    ``sizes`` are the lengths of its parts, each ended by a code that occurs once; by default it is one part.
    """
    sizes = np.array([len(codes) + 1]) if sizes is None else sizes
    found: set[tuple[int, int, int]] = set()
    for lag in range(1, short + 1):
        if len(codes) > lag:
            begin, end = _stretches(codes[lag:] == codes[:-lag], max(LEAST - lag, (EXPONENT - 1) * lag))
            found.update((b, e, lag) for b, e in zip(begin.tolist(), end.tolist()))
    found.update((b, e, lag) for b, e, lag in _longer(codes, sizes, short) if e - b >= (EXPONENT - 1) * lag)
    runs = [(b, e + lag - b, lag) for b, e, lag in found if _primitive(codes, b, e + lag, lag)]
    return np.array(sorted(runs, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where each text's words begin and the last one's end."""
    split = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(split.offsets, dtype=np.int64)
    words = split.values[int(offsets[0]):int(offsets[-1])]
    there = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    upto = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return words.filter(there), upto[offsets - offsets[0]]


def _told(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words, bounds = _words(texts)
    sizes = np.diff(bounds)
    n = len(sizes)
    codes = -1 - np.arange(len(words) + n, dtype=np.int64)  # separators stay
    text_of = np.repeat(np.arange(n), sizes)
    codes[np.arange(len(words)) + text_of] = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    runs = find_runs(codes, sizes + 1)
    begins = bounds[:-1] + np.arange(n)
    owner = np.searchsorted(begins, runs[:, 0], "right") - 1
    runs[:, 0] -= begins[owner]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, bounds[owner] + runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, bounds[owner] + runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(cover[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept))), " ")
    best = [None] * n
    for text, (start, length, period) in zip(owner.tolist(), runs.tolist()):
        run = -Fraction(length, period), start, period
        if best[text] is None or run < best[text][0]:
            best[text] = run, {"start": start, "length": length, "period": period}
    struct = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], ["start", "length", "period"])
    per_text = np.searchsorted(owner, np.arange(n + 1))
    return pa.RecordBatch.from_pydict({
        "doc_id": ids, "n_words": pa.array(sizes, pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), struct),
        "best": pa.array([b and b[1] for b in best], struct.type), "collapsed": collapsed.cast(pa.string())})


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, runs, best, collapsed``.

    Words are what ASCII white space parts; null text counts as empty. A run is a stretch of words with smallest
    period q and a length of at least 4 q and 6 words that no neighbouring word extends with that period. ``runs`` has
    each run's ``start`` (word number from 0), ``length`` and ``period``, by start, then period; ``best`` the one of most periods (ties:
    smallest start, then period), null if there is none. ``collapsed`` holds the words that no run contains after its first
    period, joined by one space. Rows that repeat, null ids and ids in any order are told like any other; no other
    column is read. No rows give no rows. A text is taken whole by one task.
    """
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            yield _told(batch["doc_id"], batch["text"])

    rows = docs.select(name(id_column).alias("doc_id"), body(text_column).alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    return rows.mapInArrow(told, T.StructType([
        rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)),
        T.StructField("best", run), T.StructField("collapsed", T.StringType())]))
