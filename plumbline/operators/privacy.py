"""Masking and hashing of personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.columns import columns_named, name, snake_name, type_of


def masked(c: Column, mask_char: str = "*") -> Column:
    """First two and last two characters of a longer text, all masked up to four."""
    c = c.cast("string")
    size = F.length(c)
    return F.when(size > 4, F.concat(F.substring(c, 1, 2), F.repeat(F.lit(mask_char), size - 4), F.right(c, F.lit(2)))) \
        .otherwise(F.repeat(F.lit(mask_char), size))


def hashed(c: Column, algorithm: str = "sha256") -> Column:
    c = c.cast("string")
    return F.sha2(c, 256) if algorithm == "sha256" else F.md5(c)


def mask_pii(df: DataFrame, columns: Sequence[str], mask_char: str = "*") -> DataFrame:
    return df.withColumns({c: masked(name(c), mask_char) for c in columns if c in df.columns})


def hash_column(df: DataFrame, column: str, algorithm: str = "sha256") -> DataFrame:
    type_of(df, column)
    return df.withColumn(column, hashed(name(column), algorithm))


def resolve_columns(df: DataFrame, audited: Sequence[str]) -> list[str]:
    """Audited names as they are called in ``df`` now, raw or cleaned to snake case."""
    known = {snake_name(c): c for c in df.columns} | {c: c for c in df.columns}
    found = [known.get(c, known.get(snake_name(c))) for c in audited]
    return list(dict.fromkeys(c for c in found if c is not None))


def pii_columns(df: DataFrame, match: str = "substring") -> list[str]:
    return columns_named(df.columns, fixed.PII_WORDS, match)


def protect(df: DataFrame, mask: Sequence[str] = (), hash: Sequence[str] = (), algorithm: str = "sha256") -> DataFrame:
    """Mask, then hash; a column in both is hashed after masking."""
    out = mask_pii(df, resolve_columns(df, mask))
    for c in resolve_columns(df, hash):
        out = hash_column(out, c, algorithm)
    return out
