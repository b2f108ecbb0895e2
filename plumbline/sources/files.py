"""Reading and writing tables by file extension."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.functions.columns import name, normalise, unused
from plumbline.session import materialize


def _extension(path: str) -> str:
    last = path.rstrip("/").rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[-1].lower() if "." in last else ""


# No cell holds this: it keeps an empty cell (missing) apart from a quoted empty text.
_NO_CELL = "\u0001missing"
_INTEGER = r"^\s*[+-]?\d+\s*$"
FIRST_LINES = 100   # that tell how a JSON file holds its records


@dataclass(frozen=True)
class Loaded:
    """A table, and the records that do not fit it: ``record, reason``."""

    table: DataFrame
    rejects: DataFrame


def _fails(broken: Column, message: Column, columns: Sequence[str]) -> Column:
    """A row condition that is true or an error. It names a column, as a reader cannot give the broken record alone."""
    shown = F.coalesce(name(columns[0]).cast("string"), F.lit("")) if columns else F.lit("")
    return F.when(broken, F.raise_error(F.concat(message, F.substring(shown, 1, 0)))).otherwise(F.lit(True))


def _csv_cells(spark: SparkSession, path: str, multi_line: bool, options: dict) -> tuple[DataFrame, str, Column]:
    """All cells as text with the whole record where its number of cells is not that of the header; the
    record's column; and whether a record has cells that no column takes."""
    settings = {"header": True, "multiLine": multi_line, "escape": '"', "ignoreLeadingWhiteSpace": False,
                "ignoreTrailingWhiteSpace": False, "nullValue": _NO_CELL, "emptyValue": "", **options}
    header = spark.read.options(**settings).csv(path).columns
    record = unused(header, "_record")
    struct = T.StructType([T.StructField(c, T.StringType()) for c in [*header, record]])
    # Without pruning a record's cells are counted whichever columns are asked for.
    cells = spark.read.options(**settings, columnNameOfCorruptRecord=record, mode="PERMISSIVE", columnPruning=False).schema(struct).csv(path)
    separator, quote = settings.get("sep", settings.get("delimiter", ",")), settings.get("quote", '"')
    outside = F.regexp_replace(name(record), f"{re.escape(quote)}[^{re.escape(quote)}]*{re.escape(quote)}", "") if quote else name(record)
    separators = (F.length(outside) - F.length(F.replace(outside, F.lit(separator), F.lit("")))) / len(separator)
    return cells, record, F.coalesce(separators >= len(header), F.lit(False))


def _named(path: str, header: Sequence[str], struct: T.StructType) -> None:
    missing, unknown = [c for c in struct.names if c not in header], [c for c in header if c not in struct.names]
    if missing or unknown:
        raise ValueError(f"{path}: the header lacks {missing} and has {unknown} that the schema does not name")


def _struct(schema: T.StructType | str | None) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _without_markers(cells: DataFrame, na_values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    if not na_values:
        return cells
    return cells.select(*[name(c) if c in keep else F.when(~name(c).isin(list(na_values)), name(c)).alias(c) for c in cells.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True,
             na_values: Sequence[str] = tuple(fixed.NA_VALUES), **options) -> DataFrame:
    """CSV with a header row. Pass a schema in production: inferring one costs a second scan.

    A schema's columns are found by their names in the header, in any order; a name that only one of
    them has is an error. A record with more cells than the header is an error when it is read, one with
    fewer lacks its last cells (:func:`load_csv` collects such records instead). Cells equal to one of ``na_values`` are
    missing, and so are empty ones; a quoted empty text is an empty text, and edge whitespace belongs to the cell.
    With a schema, a cell that does not fit its type is an error. Without one, whole numbers beyond the range of
    bigint become decimals or stay text, never rounded. Quoted cells may hold line breaks and doubled quotes; the price
    is one task per file. Where no cell holds a line break, ``multi_line=False`` splits large files.
    """
    cells, record, too_long = _csv_cells(spark, path, multi_line, options)
    header = [c for c in cells.columns if c != record]
    struct = _struct(schema)
    if struct is not None:
        _named(path, header, struct)
    message = F.concat(F.lit(f"{path}: more cells than the header has: "), F.coalesce(name(record), F.lit("")))
    cells = _without_markers(cells.where(_fails(too_long, message, header)).select(*map(name, header)), na_values)
    kinds = _kinds(cells) if struct is None else {f.name: f.dataType for f in struct}
    return normalise(cells.select(*[name(c).cast(kinds[c]).alias(c) for c in (header if struct is None else struct.names)]))


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True,
             na_values: Sequence[str] = tuple(fixed.NA_VALUES), **options) -> Loaded:
    """What :func:`read_csv` reads, without the records that are errors there; these come as ``rejects``.

    A record is rejected as ``cells`` if it has more cells than the header, and as ``type of <columns>`` if cells do not fit
    the schema. The file is parsed once, into a table in the shared folder.
    """
    cells, record, too_long = _csv_cells(spark, path, multi_line, options)
    header = [c for c in cells.columns if c != record]
    struct = _struct(schema)
    if struct is not None:
        _named(path, header, struct)
    clean = _without_markers(cells, na_values, [record])
    typed = [f for f in struct or () if not isinstance(f.dataType, T.StringType)]
    unfit = F.array_compact(F.array(*[F.when(name(f.name).isNotNull() & name(f.name).try_cast(f.dataType).isNull(), F.lit(f.name)) for f in typed])) if typed else F.array().cast("array<string>")
    why, whole = unused(cells.columns, "_reason"), F.coalesce(name(record), F.to_csv(F.struct(*map(name, header))))
    reason = F.when(too_long, F.lit("cells")).when(F.size(unfit) > 0, F.concat(F.lit("type of "), F.array_join(unfit, ", ")))
    parsed = materialize(clean.withColumns({why: reason, record: F.when(reason.isNotNull(), whole)}), "loaded")
    good = parsed.where(name(why).isNull()).select(*map(name, header))
    kinds = _kinds(good) if struct is None else {f.name: f.dataType for f in struct}
    table = good.select(*[name(c).cast(kinds[c]).alias(c) for c in (header if struct is None else struct.names)])
    return Loaded(normalise(table), parsed.where(name(why).isNotNull()).select(name(record).alias("record"), name(why).alias("reason")))


def _kinds(cells: DataFrame) -> dict[str, str]:
    """The narrowest of whole number, number, boolean, timestamp and text that all cells of a column fit unchanged."""
    def fits(c: str) -> dict[str, Column]:
        cell = name(c)
        whole, small = cell.rlike(_INTEGER), cell.try_cast("bigint").isNotNull()
        return {"bigint": whole & small, "decimal(38,0)": whole & cell.try_cast("decimal(38,0)").isNotNull(),
                "double": cell.rlike(fixed.NUMBER_PATTERN) & cell.try_cast("double").isNotNull() & (~whole | small),
                "boolean": F.lower(cell).isin("true", "false"), "timestamp_ntz": cell.try_cast("timestamp_ntz").isNotNull()}

    if not cells.columns:
        return {}
    tests = [F.struct(*[F.coalesce(F.every(F.when(name(c).isNotNull(), ok)), F.lit(False)).alias(kind) for kind, ok in fits(c).items()]).alias(f"c{i}")
             for i, c in enumerate(cells.columns)]
    row = cells.agg(*tests).first()
    return {c: next((kind for kind, ok in row[i].asDict().items() if ok), "string") for i, c in enumerate(cells.columns)}


def _json_records(spark: SparkSession, path: str, schema: T.StructType | str | None, lines: bool | None, options: dict) -> tuple[DataFrame, str]:
    """The records, and the column that holds a record's text where it is broken."""
    if lines is None:
        # Of the first lines only the first sign and whether they are whole records come to the driver.
        text = F.trim("value")
        first = spark.read.text(path).where(text != "").limit(FIRST_LINES).select(
            F.substring(text, 1, 1).alias("sign"), F.json_object_keys(text).isNotNull().alias("whole")).collect()
        lines = not first or first[0]["sign"] != "[" and 2 * sum(r["whole"] for r in first) >= len(first)
    settings = {"multiLine": not lines, "mode": "PERMISSIVE", **options}
    struct = _struct(schema)
    if struct is None:
        struct = spark.read.options(**settings, columnNameOfCorruptRecord="_record").json(path).schema
        struct = T.StructType([f for f in struct if f.name != "_record"])
    record = unused(struct.names, "_record")
    read = spark.read.options(**settings, columnNameOfCorruptRecord=record)
    return read.schema(T.StructType([*struct, T.StructField(record, T.StringType())])).json(path), record


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              lines: bool | None = None, **options) -> DataFrame:
    """One record per line (which splits over tasks), or with ``lines=False`` files that hold one
    array of records or one record over several lines. Unless said, it is by lines if half of the first ones are whole records.

    A broken record, or one with a value that does not fit the schema, is an error when it is read; :func:`load_json`
    collects such records instead. A file that is not read by lines is one record if it is broken.
    """
    records, record = _json_records(spark, path, schema, lines, options)
    columns = [c for c in records.columns if c != record]
    if not columns:
        return records.select()
    message = F.concat(F.lit(f"{path}: broken record: "), F.coalesce(name(record), F.lit("")))
    return normalise(records.where(_fails(name(record).isNotNull(), message, columns)).select(*map(name, columns)))


def load_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool | None = None, **options) -> Loaded:
    """What :func:`read_json` reads, without the records that are errors there; these come as ``rejects``, with reason ``record``.

    The file is parsed once, into a table in the shared folder.
    """
    records, record = _json_records(spark, path, schema, lines, options)
    parsed = materialize(records, "loaded")
    return Loaded(normalise(parsed.where(name(record).isNull()).drop(record)),
                  parsed.where(name(record).isNotNull()).select(name(record).alias("record"), F.lit("record").alias("reason")))


def read_parquet(spark: SparkSession, path: str, nan_as_null: bool = True) -> DataFrame:
    """Parquet as stored. With ``nan_as_null=False`` float filters still reach the scan."""
    df = spark.read.parquet(path)
    return normalise(df) if nan_as_null else df


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read by extension: csv, json, jsonl, parquet, each with its reader's options. Anything else is refused."""
    kind = _extension(path)
    if kind == "csv":
        return read_csv(spark, path, schema, **options)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, schema, **({"lines": True} if kind == "jsonl" else {}) | options)
    if kind == "parquet":
        return read_parquet(spark, path, **options)
    raise ValueError(f"unsupported file type {kind!r}: {path}")


def save(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> str:
    """Write a directory of part files by extension; an unknown extension means CSV. ``options`` go to the writer.

    JSON is written one record per line, which reads back in parallel. CSV keeps edge whitespace,
    and writes an empty text quoted and a missing cell empty.
    """
    writer = df.write.mode(mode).options(**options)
    kind = _extension(path)
    if kind == "parquet":
        writer.parquet(path)
    elif kind in ("json", "jsonl"):
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.options(**{"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **options}).csv(path)
    return path
