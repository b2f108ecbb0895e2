"""Text, number and date expressions shared by checks, fixes and profiles.

Everything here is a built-in expression: null in, null out, no Python workers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.functions.columns import name, type_of


def strip(c: Column) -> Column:
    """Remove all edge whitespace (the built-in ``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def title(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def is_title(c: Column) -> Column:
    """The text equals its ``title`` form: no letter run starts lower or goes on upper."""
    return ~c.rlike(r"(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}")


def parse_number(c: Column) -> Column:
    """The number a text spells out, or null (``12d`` and ``nan`` are not numbers)."""
    return F.when(c.rlike(fixed.NUMBER_PATTERN), F.trim(c).try_cast("double"))


def strip_currency(c: Column) -> Column:
    return F.regexp_replace(c, fixed.CURRENCY_PATTERN, "")


def _shape(date_format: str) -> str:
    """Pattern of the texts a date format can parse: a cheap test before the costly attempt."""
    widths = {"yyyy": r"\d{4}", "MMM": r"\p{L}{3,4}\.?", "MM": r"\d{2}", "dd": r"\d{2}",
              "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}
    parts = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", date_format)
    return "^" + "".join(widths.get(a + b, r".+") if a else "\\" + other for a, b, other in parts) + "$"


def may_hold_dates(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def date_formats(df: DataFrame, columns: Sequence[str], formats: Sequence[str] | None = None) -> dict[str, list[str]]:
    """The formats to try on each text column: of day-first and month-first only the one that
    parses more cells, day-first if both parse as many. One aggregate; a stream keeps all formats."""
    formats = list(fixed.DATE_FORMATS if formats is None else formats)
    orders = [f for f in fixed.DATE_ORDERS if f in formats]
    texts = [c for c in columns if isinstance(type_of(df, c), T.StringType)]
    if len(orders) < 2 or not texts or df.isStreaming:
        return {c: formats for c in texts}

    def fits(c: str, order: str) -> Column:
        cell = name(c)
        return F.count(F.when(cell.rlike(_shape(order)), F.try_to_timestamp(cell, F.lit(order))))

    row = df.agg(*[F.array(*[fits(c, o) for o in orders]).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    best = {c: orders[row[i].index(max(row[i]))] for i, c in enumerate(texts)}
    return {c: [f for f in formats if f not in orders or f == best[c]] for c in texts}


def parse_timestamp(c: Column, dtype: T.DataType, formats: Sequence[str] | None = None) -> Column:
    """ISO forms first, then each format in turn; null when none parses.

    A failed attempt costs an exception inside the JVM, so a format is only tried on
    texts of its shape. Only texts, dates and timestamps can be dates: for other types,
    numbers among them, the result is null.
    """
    if not isinstance(dtype, T.StringType):
        return c.cast("timestamp_ntz") if may_hold_dates(dtype) else F.lit(None).cast("timestamp_ntz")
    formats = fixed.DATE_FORMATS if formats is None else formats
    iso = c.try_cast("timestamp_ntz")
    if not formats:
        return iso
    attempts = [F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))).cast("timestamp_ntz") for f in formats]
    return F.coalesce(iso, F.when(c.rlike("|".join(_shape(f) for f in formats)), F.coalesce(*attempts)))


def is_junk(c: Column) -> Column:
    return F.lower(strip(c)).isin(fixed.JUNK_WORDS)


def test_word_pattern() -> str:
    return "(?U)" + "|".join(rf"\b{word}\b" for word in fixed.TEST_WORDS)


def has_test_word(c: Column) -> Column:
    """A byte search for the bare words comes first: it spares most long texts the pattern."""
    lowered = F.lower(c)
    present = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(word)) for word in fixed.TEST_WORDS])
    return present & lowered.rlike(test_word_pattern())


def is_blank(c: Column) -> Column:
    """Null or nothing but whitespace."""
    return c.isNull() | (strip(c.cast("string")) == "")
