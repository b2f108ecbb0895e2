"""Many statistics of many columns in one scan.

Two shapes, both one scan with map-side combine whatever the table holds:

* ``per_column`` builds one global aggregate whose single row is an array of structs and
  unfolds it to one row per column. Best for a few measures; sketches and moments live here.
* ``text_profile`` unfolds the text cells of each row and groups them by column. The code
  generated for it does not grow with the number of columns, so its many pattern measures
  stay small enough for the JIT compiler, and its scan reads the text columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed, text
from plumbline.functions.columns import atomic_columns, name, string_columns, type_class, type_of
from plumbline.session import local_table

# Columns whose expressions share one generated plan; wider tables take several scans.
COLUMNS_PER_PASS = 200
# Values of a text column up to which their cells are counted first.
FEW_VALUES = 10_000

Measure = tuple[str, Callable[[Column, T.DataType], "Column | None"]]


def _numeric(build: Callable[[Column], Column]) -> Callable[[Column, T.DataType], Column | None]:
    return lambda c, t: build(c.cast("double")) if type_class(t) == "numeric" else None


def _atomic(build: Callable[[Column], Column]) -> Callable[[Column, T.DataType], Column | None]:
    return lambda c, t: None if type_class(t) == "other" else build(c)


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; rows where it is null do not count."""
    return F.avg(condition.cast("int"))


def skewness(n: Column, g1: Column, spread: Column) -> Column:
    """Bias-corrected skewness from the population form; 0 without spread, null below 3 values."""
    corrected = g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n < 3, None).when(spread == 0, F.lit(0.0)).otherwise(corrected)


def kurtosis(n: Column, g2: Column, spread: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 without spread, null below 4 values."""
    corrected = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * g2 + 6)
    return F.when(n < 4, None).when(spread == 0, F.lit(0.0)).otherwise(corrected)


def skewness_of(c: Column) -> Column:
    c = c.cast("double")
    return skewness(F.count(c).cast("double"), F.skewness(c), F.var_pop(c))


def kurtosis_of(c: Column) -> Column:
    c = c.cast("double")
    return kurtosis(F.count(c).cast("double"), F.kurtosis(c), F.var_pop(c))


def _holds_boolean_pair(c: Column, dtype: T.DataType) -> Column | None:
    """Both values of a pair and nothing else, for the types that are not text."""
    if isinstance(dtype, T.IntegralType):
        return (F.min(c) == 0) & (F.max(c) == 1)
    return F.min(c) != F.max(c) if isinstance(dtype, T.BooleanType) else None


MEASURES: dict[str, Measure] = {
    "rows": ("bigint", lambda c, t: F.count(F.lit(1))),
    "nulls": ("bigint", lambda c, t: F.count_if(c.isNull())),
    "distinct_estimate": ("bigint", _atomic(F.approx_count_distinct)),
    "constant": ("boolean", _atomic(lambda c: F.min(c).eqNullSafe(F.max(c)))),
    "min": ("double", _numeric(F.min)),
    "max": ("double", _numeric(F.max)),
    "mean": ("double", _numeric(F.avg)),
    "std": ("double", _numeric(F.stddev_samp)),
    "std_pop": ("double", _numeric(F.stddev_pop)),
    "boolean_pair": ("boolean", _holds_boolean_pair),
    "skewness": ("double", _numeric(skewness_of)),
    "kurtosis": ("double", _numeric(kurtosis_of)),
}


def per_column(df: DataFrame, columns: Sequence[str] | None,
               measures: Sequence[str] | Mapping[str, Measure]) -> DataFrame:
    """One row per column: ``column``, ``position`` and the asked measures, from one scan."""
    columns = df.columns if columns is None else list(columns)
    if not isinstance(measures, Mapping):
        if "distinct_estimate" in measures and len(measures) > 1:
            # Beside a sketch, plain aggregates lose code generation: a scan each is faster.
            plain = per_column(df, columns, [m for m in measures if m != "distinct_estimate"])
            sketched = per_column(df, columns, {"distinct_estimate": MEASURES["distinct_estimate"]}).drop("position")
            return plain.join(F.broadcast(sketched), "column").select("column", "position", *measures)
        measures = {m: MEASURES[m] for m in measures}
    schema = "column string, position int, " + ", ".join(f"`{m}` {t}" for m, (t, _) in measures.items())
    if not columns:
        return local_table(df.sparkSession, [], schema)

    def entry(column: str) -> Column:
        dtype = type_of(df, column)
        fields = [F.lit(column).alias("column"), F.lit(df.columns.index(column)).alias("position")]
        for measure, (kind, build) in measures.items():
            value = build(name(column), dtype)
            fields.append((F.lit(None) if value is None else value).cast(kind).alias(measure))
        return F.struct(*fields)

    parts = [columns[i:i + COLUMNS_PER_PASS] for i in range(0, len(columns), COLUMNS_PER_PASS)]
    passes = [df.agg(F.array(*[entry(c) for c in part]).alias("entries")).select(F.inline("entries"))
              for part in parts]
    return reduce(DataFrame.unionAll, passes)


# -- text cells -------------------------------------------------------------------

def _boolean_words(word: Column) -> Column:
    """Bitmask of the boolean words a column holds, with one extra bit for any other value."""
    words = [w for pair in fixed.BOOLEAN_PAIRS for w in pair]
    bits = reduce(lambda acc, iw: acc.when(word == iw[1], F.lit(1 << iw[0])),
                  enumerate(words), F.when(word.isNull(), F.lit(None).cast("int")))
    return F.bit_or(bits.otherwise(F.lit(1 << len(words))))


def boolean_pair(mask: Column) -> Column:
    """True when the mask holds exactly both words of one pair."""
    return mask.isin([0b11 << (2 * i) for i in range(len(fixed.BOOLEAN_PAIRS))])


def only_boolean_words(mask: Column) -> Column:
    """True when every non-null value is a boolean word."""
    return F.coalesce(mask < (1 << (2 * len(fixed.BOOLEAN_PAIRS))), F.lit(True))


TEXT_MEASURES = {
    "edge_space": "boolean", "inner_space": "boolean", "sql_breaking": "boolean", "html_tags": "boolean",
    "lettered": "bigint", "lower_share": "double", "upper_share": "double", "title_share": "double",
    "number_share": "double", "money_share": "double", "real_number_share": "double", "date_share": "double",
    "boolean_words": "int",
}


def _text_measures(n: Column | None = None) -> dict[str, Column]:
    """The measures of cells ``txt``, or of values ``txt`` of ``n`` cells each."""
    def share(condition: Column) -> Column:
        if n is None:
            return F.avg(condition.cast("int"))
        return F.sum(condition.cast("int") * n) / F.sum(F.when(condition.isNotNull(), n))

    txt = F.col("txt")  # never null
    lettered = F.when(txt.rlike("[a-zA-Z]"), txt)
    bare = text.strip(txt)
    return {
        "edge_space": F.bool_or(txt != bare),
        "inner_space": F.bool_or(txt.rlike(r"(?U)\s{2,}")),
        "sql_breaking": F.bool_or(txt.rlike(fixed.SQL_BREAKING_PATTERN)),
        "html_tags": F.bool_or(txt.rlike(fixed.HTML_TAG_PATTERN)),
        "lettered": F.count(lettered) if n is None else F.coalesce(F.sum(F.when(lettered.isNotNull(), n)), F.lit(0)),
        "lower_share": share(lettered == F.lower(txt)),
        "upper_share": share(lettered == F.upper(txt)),
        "title_share": share(text.is_title(lettered)),
        "number_share": share(text.parse_number(txt).isNotNull()),
        "money_share": share(text.parse_number(text.strip_currency(txt)).isNotNull()),
        "real_number_share": share(F.when(~text.is_junk(txt), text.parse_number(bare).isNotNull())),
        "date_share": share(text.parse_timestamp(txt, T.StringType()).isNotNull()),
        "boolean_words": _boolean_words(F.lower(txt)),
    }


def text_profile(df: DataFrame, columns: Sequence[str] | None = None, measures: Sequence[str] | None = None,
                 estimates: Mapping[str, int] | None = None) -> DataFrame:
    """One row per text column: ``column``, ``position`` and the asked text measures.

    Columns that hold few values by ``estimates`` are measured once a value, not once a cell; that is only a matter of time.
    """
    columns = string_columns(df) if columns is None else list(columns)
    measures = list(TEXT_MEASURES) if measures is None else list(measures)
    names = local_table(df.sparkSession, [(c, df.columns.index(c)) for c in columns], "column string, position int")
    if not columns:
        return names.select("*", *[F.lit(None).cast(TEXT_MEASURES[m]).alias(m) for m in measures])
    few = [c for c in columns if estimates is not None and estimates.get(c, FEW_VALUES + 1) <= FEW_VALUES]
    grouped = []
    for some, build in ((few, _text_measures(F.col("n"))), ([c for c in columns if c not in few], _text_measures())):
        for part in [some[i:i + COLUMNS_PER_PASS] for i in range(0, len(some), COLUMNS_PER_PASS)]:
            cells = df.select(F.inline(F.array(*[F.struct(F.lit(df.columns.index(c)).alias("position"), name(c).alias("txt")) for c in part]))).where("txt is not null")
            if some is few:
                cells = cells.groupBy("position", "txt").agg(F.count(F.lit(1)).alias("n"))
            grouped.append(cells.groupBy("position").agg(*[build[m].alias(m) for m in measures]))
    grouped = reduce(DataFrame.unionAll, grouped)
    return names.join(F.broadcast(grouped), "position", "left").select("column", "position", *measures)  # one row a column


def unpivot(metrics: DataFrame, measures: Sequence[str], check: str) -> DataFrame:
    """Long form ``(check, column, metric, value)`` of the given measures, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in measures])
    return (metrics.select(F.lit(check).alias("check"), "column", F.inline(pairs))
            .where(F.col("value").isNotNull()))


def distinct_estimates(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Sketched distinct counts, one scan; used as a gate before exact work."""
    rows = per_column(df, [c for c in columns if c in atomic_columns(df)], ["distinct_estimate"]).collect()
    return {r["column"]: r["distinct_estimate"] for r in rows}
