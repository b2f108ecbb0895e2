"""Query registry, and the test tables with dirt that reads the same in Spark and in SQL.

The test tables are clean, so a check on them would compare nothing with nothing. Each
dirty table is the whole table with some columns replaced, added, or some rows repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import files

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(label: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if label in REGISTRY:
            raise ValueError(f"query {label!r} registered twice")
        REGISTRY[label] = (fn, sql)
        return fn
    return add


@dataclass(frozen=True)
class Dirty:
    base: str
    replaced: dict[str, str] = field(default_factory=dict)
    added: dict[str, str] = field(default_factory=dict)
    kept: tuple[str, ...] = ()
    repeated: str | None = None


DIRTY = {
    "lineitem_gaps": Dirty("lineitem", {
        "l_discount": "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_discount END",
        "l_tax": "CASE WHEN l_orderkey % 10 < 6 THEN NULL ELSE l_tax END",
        "l_returnflag": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END"}),
    "lineitem_redundant": Dirty("lineitem", {
        "l_discount": "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_discount END"}, {
        "l_gross": "l_extendedprice * 1.25 + l_linenumber",
        "l_fixed": "CAST(7 AS DOUBLE)",
        "l_status": "'open'"},
        kept=("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "orders_twice": Dirty("orders", repeated="o_orderkey % 50 = 0"),
    "orders_text": Dirty("orders", {
        "o_orderpriority": "CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 23 = 0 THEN ' Unknown ' "
                           "WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderpriority END"}, {
        "total_text": "'$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)",
        "qty_text": "CASE WHEN o_orderkey % 5 < 2 THEN 'n' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END",
        "count_text": "CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'missing' "
                      "ELSE CAST(o_custkey % 50 AS STRING) END",
        "active": "CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'no' END",
        "flag": "CAST(o_orderkey % 2 AS INT)",
        "level": "CAST(o_orderkey % 3 AS STRING)"},
        kept=("o_orderkey", "o_orderpriority")),
    "orders_dates": Dirty("orders", {}, {
        "order_date": "CASE WHEN o_orderkey % 19 = 0 THEN 'soon' WHEN o_orderkey % 23 = 0 THEN NULL "
                      "WHEN o_orderkey % 4 = 0 THEN substring(CAST(o_orderdate AS STRING), 9, 2) || '/' || "
                      "substring(CAST(o_orderdate AS STRING), 6, 2) || '/' || substring(CAST(o_orderdate AS STRING), 1, 4) "
                      "ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END"},
        kept=("o_orderkey",)),
    "orders_blank": Dirty("orders", {}, {
        "priority": "CASE WHEN o_orderkey % 40 = 0 THEN '  ' ELSE o_orderpriority END",
        "price": "CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_totalprice END"}, kept=("o_orderkey",)),
    "orders_names": Dirty("orders", {}, {
        "c_name": "'Customer ' || substring(md5(CAST(o_custkey AS STRING)), 1, 16) || CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE '' END"},
        kept=("o_orderkey",)),
    "orders_broken": Dirty("orders", {
        "o_custkey": "CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 10000000 ELSE o_custkey END"},
        kept=("o_orderkey", "o_custkey")),
    "customer_messy": Dirty("customer", {
        "c_name": "CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' WHEN c_custkey % 11 = 0 THEN c_name || '  <b>x</b>' "
                  "WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END",
        "c_mktsegment": "CASE WHEN c_custkey % 97 = 0 THEN replace(c_mktsegment, 'E', 'F') ELSE c_mktsegment END"}, {
        "email": "CASE WHEN c_custkey % 11 = 0 THEN 'bad' WHEN c_custkey % 17 = 0 THEN NULL "
                 "ELSE 'u' || CAST(c_custkey AS STRING) || '@x.org' END",
        "phone": "CASE WHEN c_custkey % 9 = 0 THEN 'call me' WHEN c_custkey % 19 = 0 THEN NULL "
                 "ELSE '+1 555-' || CAST(1000 + c_custkey % 9000 AS STRING) END",
        "note": "CASE WHEN c_custkey % 5 = 0 THEN 'it''s a \"Test\" row' WHEN c_custkey % 3 = 0 THEN 'ALL  GOOD; really' "
                "ELSE 'fine Here' END"}),
    "events_spikes": Dirty("events", {"value": "CASE WHEN event_id % 499 = 0 THEN value * 100 ELSE value END"},
                           kept=("event_id", "user_id", "event_type", "value")),
    "events_gaps": Dirty("events", {"value": "CASE WHEN event_id % 7 < 2 THEN NULL ELSE value END",
                                    "event_type": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END"},
                         kept=("event_id", "event_type", "value")),
}


def frame(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table, or its dirty variant."""
    if table not in DIRTY:
        return files.read_parquet(spark, f"{sf_dir}/{table}.parquet")
    spec = DIRTY[table]
    base = files.read_parquet(spark, f"{sf_dir}/{spec.base}.parquet")
    kept = list(spec.kept) or base.columns
    out = base.select(*[F.expr(spec.replaced[c]).alias(c) if c in spec.replaced else F.col(c) for c in kept],
                      *[F.expr(e).alias(c) for c, e in spec.added.items()])
    if spec.repeated:
        out = out.unionAll(base.where(F.expr(spec.repeated)))
    return out


COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
}


def columns_of(table: str) -> list[str]:
    if table not in DIRTY:
        return COLUMNS[table].split()
    spec = DIRTY[table]
    return (list(spec.kept) or COLUMNS[spec.base].split()) + list(spec.added)


def source(table: str) -> str:
    """The same table as a SQL subquery."""
    if table not in DIRTY:
        return table
    spec = DIRTY[table]
    kept = list(spec.kept) or COLUMNS[spec.base].split()
    cells = [f"{spec.replaced[c]} AS {c}" if c in spec.replaced else c for c in kept]
    cells += [f"{e} AS {c}" for c, e in spec.added.items()]
    sql = f"SELECT {', '.join(cells)} FROM {spec.base}"
    if spec.repeated:
        sql += f" UNION ALL SELECT * FROM {spec.base} WHERE {spec.repeated}"
    return f"({sql})"


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def with_table(table: str, sql: str) -> str:
    """``sql`` over ``t``, the given table."""
    return f"WITH t AS (SELECT * FROM {source(table)} AS s)\n{sql}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, decimals as doubles, timestamps as text: what the comparison sees."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float", "decimal"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def findings(df: DataFrame) -> DataFrame:
    return rounded(df.select(F.col("column").alias("column_name"), "metric", "value"))


def stamp(column: str) -> str:
    """SQL text of a timestamp, as ``rounded`` writes it."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
