"""Sources and sinks: write the whole table in one format, read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import frame, query, rounded, stamp, with_table
from plumbline.catalog.audit import AS_OF, CUSTOMER_AUDIT
from plumbline.functions import fixed
from plumbline.functions.columns import normalise
from plumbline.operators import clean, privacy
from plumbline.plans import workflow
from plumbline.session import shared_path
from plumbline.sources import files

ORDERS = f"""SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice,
{stamp('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders"""


@query("read_csv", ORDERS)
def _(spark, d):
    df = frame(spark, d, "orders")
    path = files.save(df, shared_path(spark, "orders") + ".csv")
    return rounded(files.read_table(spark, path, df.schema))


@query("read_csv_inferred", ORDERS)
def _(spark, d):
    path = files.save(frame(spark, d, "orders"), shared_path(spark, "orders") + ".csv")
    out = files.read_csv(spark, path, multi_line=False)
    return rounded(out.withColumns({"o_orderkey": F.col("o_orderkey").cast("bigint"), "o_custkey": F.col("o_custkey").cast("bigint")}))


@query("read_csv_long_text", "SELECT doc_id, md5(text) AS digest, length(text) AS size FROM documents")
def _(spark, d):
    df = frame(spark, d, "documents").select("doc_id", "text")
    out = files.read_table(spark, files.save(df, shared_path(spark, "documents") + ".csv"), df.schema)
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("size"))


@query("read_json", ORDERS)
def _(spark, d):
    df = frame(spark, d, "orders")
    path = files.save(df, shared_path(spark, "orders") + ".json")
    return rounded(files.read_json(spark, path, df.schema, lines=True))


@query("read_parquet", ORDERS)
def _(spark, d):
    path = files.save(frame(spark, d, "orders"), shared_path(spark, "orders") + ".parquet")
    return rounded(files.read_table(spark, path))


# Cells that a file may lose: padded, empty, null, quoted, over several lines.
DOCUMENT_CELLS = ("CASE WHEN doc_id % 7 = 0 THEN '  ' || text || ' ' WHEN doc_id % 7 = 1 THEN '' WHEN doc_id % 7 = 2 THEN NULL "
                  "WHEN doc_id % 7 = 3 THEN chr(34) || text || chr(34) || ', ' || chr(92) || ' ' || lang "
                  "WHEN doc_id % 7 = 4 THEN lang || chr(10) || text ELSE text END")
DIGESTS = "SELECT doc_id, lang, source, n_chars, md5(cell) AS digest, length(cell) AS size FROM"


def _digests(df):
    return df.select("doc_id", "lang", "source", "n_chars", F.md5("cell").alias("digest"), F.length("cell").cast("bigint").alias("size"))


def _round_trips(kind: str) -> None:
    options = {"na_values": ()} if kind == "csv" else {}

    @query(f"roundtrip_{kind}_documents", f"{DIGESTS} (SELECT *, {DOCUMENT_CELLS} AS cell FROM documents)")
    def _(spark, d):
        df = frame(spark, d, "documents").withColumn("cell", F.expr(DOCUMENT_CELLS)).drop("text")
        path = files.save(df, shared_path(spark, "documents") + f".{kind}")
        return _digests(files.read_table(spark, path, df.schema, **options))

    @query(f"roundtrip_{kind}_customers", with_table("customer_messy", "SELECT * REPLACE (round(c_acctbal, 4) AS c_acctbal) FROM t"))
    def _(spark, d):
        df = frame(spark, d, "customer_messy")
        path = files.save(df, shared_path(spark, "customers") + f".{kind}")
        return rounded(files.read_table(spark, path, df.schema, **options)).withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


for _kind in ("csv", "json", "parquet"):
    _round_trips(_kind)


@query("read_csv_na", """
SELECT count(*) FILTER (o_orderkey % 3 = 0) AS missing_priority, count(*) FILTER (o_orderkey % 5 = 0) AS missing_total,
       round(sum(o_totalprice) FILTER (o_orderkey % 5 > 0), 2) AS total FROM orders""")
def _(spark, d):
    markers = F.element_at(F.array(*[F.lit(v) for v in fixed.NA_VALUES]), (F.col("o_orderkey") % len(fixed.NA_VALUES) + 1).cast("int"))
    df = frame(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, markers).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderkey") % 5 == 0, markers).otherwise(F.col("o_totalprice").cast("string")).alias("total"))
    back = files.read_table(spark, files.save(df, shared_path(spark, "orders") + ".csv"), multi_line=False)
    return back.agg(F.count_if(F.col("priority").isNull()).alias("missing_priority"), F.count_if(F.col("total").isNull()).alias("missing_total"),
                    F.round(F.sum("total"), 2).alias("total"))


@query("read_csv_reordered", ORDERS)
def _(spark, d):
    df = frame(spark, d, "orders")
    path = files.save(df.select(*reversed(df.columns)), shared_path(spark, "orders") + ".csv")
    return rounded(files.read_table(spark, path, df.schema))


BIG = "CAST(18446744073709000000 + o_orderkey AS DECIMAL(38, 0))"


@query("read_csv_big_ids", f"SELECT CAST({BIG} AS VARCHAR) AS big_id, o_custkey, count(*) AS rows FROM orders GROUP BY ALL")
def _(spark, d):
    df = frame(spark, d, "orders").select((F.lit("18446744073709000000").cast("decimal(38,0)") + F.col("o_orderkey")).cast("decimal(38,0)").alias("big_id"), "o_custkey")
    out = files.read_csv(spark, files.save(df, shared_path(spark, "orders") + ".csv"), multi_line=False)
    return out.groupBy(F.col("big_id").cast("string").alias("big_id"), F.col("o_custkey").cast("bigint").alias("o_custkey")).agg(F.count(F.lit(1)).alias("rows"))


# Every seventh line has a cell too many, every eleventh a total that is no number, every thirteenth lacks its last cell.
@query("read_csv_rejects", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'cells' WHEN o_orderkey % 11 = 0 THEN 'type of o_totalprice' END AS reason,
       CASE WHEN o_orderkey % 13 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def _(spark, d):
    key = F.col("o_orderkey")
    total = F.when(key % 11 == 0, F.lit("much")).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", key, total, F.when(key % 13 > 0, F.col("o_orderpriority")), F.when(key % 7 == 0, F.when(key % 13 > 0, "more").otherwise(F.lit("some,more"))))
    path = files.save(frame(spark, d, "orders").select(line.alias("o_orderkey,o_totalprice,o_orderpriority")), shared_path(spark, "orders") + ".csv", sep="\u0001")
    found = files.load_csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string")
    return found.table.select("o_orderkey", F.lit(None).cast("string").alias("reason"), "o_orderpriority").unionByName(found.rejects.select(
        F.substring_index("record", ",", 1).cast("bigint").alias("o_orderkey"), "reason", F.lit(None).cast("string").alias("o_orderpriority")))


JSON_ROWS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"


@query("read_json_rejects", """
SELECT o_orderkey, o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 AS rejected, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def _(spark, d):
    key, line = F.col("o_orderkey"), F.to_json(F.struct("o_orderkey", "o_orderpriority"))
    broken = F.when(key % 7 == 0, F.replace(line, F.lit("}"), F.lit(""))).when(key % 11 == 0, F.replace(line, F.lit(":"), F.lit(": oops "))).otherwise(line)
    path = shared_path(spark, "orders") + ".json"
    frame(spark, d, "orders").select(broken.alias("value")).write.text(path)
    found = files.load_json(spark, path, "o_orderkey bigint, o_orderpriority string")
    return found.table.select("o_orderkey", F.lit(False).alias("rejected"), "o_orderpriority").unionByName(found.rejects.select(
        F.regexp_extract("record", "[0-9]+", 0).cast("bigint").alias("o_orderkey"), F.lit(True).alias("rejected"), F.lit(None).cast("string").alias("o_orderpriority")))


@query("read_json_records", ORDERS)
def _(spark, d):
    # Files of one array each, every record over several lines.
    df = frame(spark, d, "orders")
    record = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    arrays = df.groupBy(F.expr("o_orderkey div 5000").alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value"))
    path = shared_path(spark, "orders") + ".json"
    arrays.write.partitionBy("part").text(path)
    return rounded(files.read_table(spark, path, df.schema).drop("part"))


@query("read_normalised", "SELECT event_id, round(CASE WHEN event_id % 5 > 0 THEN value END, 4) AS value FROM events")
def _(spark, d):
    broken = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return rounded(normalise(frame(spark, d, "events").select("event_id", broken.alias("value"))))


@query("save_report", CUSTOMER_AUDIT + """
SELECT check_name, category = 'A' AND found AND fix_key IS NOT NULL AND severity = 'HIGH' AS approved FROM summary""")
def _(spark, d):
    report = workflow.audit_and_clean(frame(spark, d, "customer_messy"), "auto_high", order_by="c_custkey", as_of=AS_OF)
    written = workflow.write_report(report, shared_path(spark, "customer") + ".parquet")
    return files.read_json(spark, written["plan"], lines=True).select(F.col("check").alias("check_name"), "approved")


@query("save_dropped_duplicates", """
SELECT event_id, kept_id FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS kept_id FROM events) WHERE event_id <> kept_id""")
def _(spark, d):
    df = frame(spark, d, "events").select("event_id", "user_id", "event_type")
    trail = clean.dropped_duplicates(df, "event_id", ["user_id", "event_type"]).select("event_id", "kept_id")
    return files.read_parquet(spark, files.save(trail, shared_path(spark, "dropped") + ".parquet"))


@query("save_protected_csv", "SELECT c_custkey, sha256(c_name) AS c_name, c_mktsegment FROM customer")
def _(spark, d):
    df = privacy.protect(frame(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), hash=["c_name"])
    return files.read_csv(spark, files.save(df, shared_path(spark, "customer") + ".csv"), df.schema)


@query("run_without_order", "SELECT 2 * count(*) AS rows_before, count(*) AS rows_after, count(*) AS dropped FROM orders")
def _(spark, d):
    df = frame(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    path = files.save(df.unionAll(df), shared_path(spark, "orders") + ".parquet")
    out = shared_path(spark, "cleaned")
    report = workflow.run(spark, path, out + ".json", mode="auto_high")
    trail = files.read_table(spark, out + "_dropped_duplicates.json").agg(F.count(F.lit(1)).alias("dropped"), F.lit(1).alias("one"))
    kept = files.read_table(spark, out + ".json").agg(F.count(F.lit(1)).alias("rows_after"), F.lit(1).alias("one"))
    return report.summary.select("rows_before", F.lit(1).alias("one")).join(kept, "one").join(trail, "one").drop("one")
