"""Scaling, encoding, date parts and derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.audit import parsed_date
from plumbline.catalog.registry import frame, query, rounded, union, with_table
from plumbline.operators import prep


@query("normalize_minmax", """
SELECT p_partkey, round((p_size - lo) / CAST(hi - lo AS DOUBLE), 6) AS p_size, round((p_retailprice - l2) / (h2 - l2), 6) AS p_retailprice
FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM part)""")
def _(spark, d):
    out = prep.normalize_columns(frame(spark, d, "part"), "minmax", ["p_size", "p_retailprice"])
    return rounded(out.select("p_partkey", "p_size", "p_retailprice"), 6)


@query("normalize_zscore", """
SELECT event_id, round((value - m) / s, 6) AS value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""")
def _(spark, d):
    return rounded(prep.normalize_columns(frame(spark, d, "events"), "zscore", ["value"]).select("event_id", "value"), 6)


@query("encode_label", with_table("events_gaps", """
SELECT event_id, CASE WHEN event_type IS NOT NULL THEN dense_rank() OVER (ORDER BY event_type NULLS LAST) - 1 END AS event_type FROM t"""))
def _(spark, d):
    return prep.encode_categoricals(frame(spark, d, "events_gaps"), "label").select("event_id", "event_type")


@query("encode_onehot", with_table("events_gaps", "SELECT event_id, " + ", ".join(
    f"coalesce(event_type = '{v}', false) AS event_type_{v}" for v in ("click", "error", "purchase", "signup", "view")) + " FROM t"))
def _(spark, d):
    return prep.encode_categoricals(frame(spark, d, "events_gaps").drop("value"), "onehot")


@query("encode_sparse", """
WITH v AS (SELECT DISTINCT 'c_mktsegment' AS c, c_mktsegment AS v FROM customer UNION SELECT DISTINCT 'c_name', c_name FROM customer),
d AS (SELECT *, row_number() OVER (ORDER BY c, v) - 1 AS position FROM v)
SELECT c_custkey, a.position AS first, b.position AS second FROM customer
JOIN d a ON a.c = 'c_mktsegment' AND a.v = c_mktsegment JOIN d b ON b.c = 'c_name' AND b.v = c_name""")
def _(spark, d):
    encoded, _ = prep.sparse_one_hot(frame(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    return encoded.select("c_custkey", F.col("features")[0].alias("first"), F.col("features")[1].alias("second"))


@query("encode_frequency", with_table("events_gaps", """
SELECT event_id, round(n / CAST((SELECT count(event_type) FROM t) AS DOUBLE), 6) AS event_type
FROM t LEFT JOIN (SELECT event_type AS k, count(*) AS n FROM t GROUP BY 1) ON k = event_type"""))
def _(spark, d):
    return rounded(prep.encode_categoricals(frame(spark, d, "events_gaps"), "frequency").select("event_id", "event_type"), 6)


@query("datetime_features", """
SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day,
       dayname(o_orderdate) AS o_orderdate_weekday, quarter(o_orderdate) AS o_orderdate_quarter FROM orders""")
def _(spark, d):
    out = prep.add_datetime_features(frame(spark, d, "orders"), "o_orderdate")
    return rounded(out.select("o_orderkey", *[f"o_orderdate_{p}" for p in ("year", "month", "day", "weekday", "quarter")]))


@query("feature_date_parts", with_table("orders_dates", f"""
SELECT o_orderkey, year(p) AS order_date_year, month(p) AS order_date_month, quarter(p) AS order_date_quarter,
       CASE WHEN isodow(p) IN (6, 7) THEN 1 ELSE 0 END AS order_date_is_weekend
FROM (SELECT o_orderkey, {parsed_date('order_date')} AS p FROM t)"""))
def _(spark, d):
    return rounded(prep.add_date_parts(frame(spark, d, "orders_dates"), "order_date").drop("order_date"))


@query("feature_encoded", with_table("events_gaps", """
SELECT event_id, CASE WHEN event_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY event_type NULLS LAST) - 1 END AS event_type_encoded FROM t"""))
def _(spark, d):
    return prep.add_encoded(frame(spark, d, "events_gaps"), "event_type").select("event_id", "event_type_encoded")


@query("feature_frequency", with_table("events_gaps", """
SELECT event_id, n AS event_type_freq FROM t LEFT JOIN (SELECT event_type AS k, count(*) AS n FROM t GROUP BY 1) ON k = event_type"""))
def _(spark, d):
    return prep.add_frequency(frame(spark, d, "events_gaps"), "event_type").select("event_id", "event_type_freq")


@query("feature_unit_price", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 8) AS avg_unit_price FROM lineitem""")
def _(spark, d):
    df = frame(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(prep.add_unit_price(df).select("l_orderkey", "l_linenumber", "avg_unit_price"), 8)


@query("feature_value_flag", """
SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders) THEN 1 ELSE 0 END AS total_value_flag FROM orders""")
def _(spark, d):
    return rounded(prep.add_value_flag(frame(spark, d, "orders")).select("o_orderkey", "total_value_flag"))


@query("feature_ratio", "SELECT event_id, round(value / (user_id + 1e-9), 4) AS value_to_user_id_ratio FROM events WHERE user_id <> 0 "
       "UNION ALL SELECT event_id, round(value / 1e-9, 4) FROM events WHERE user_id = 0")
def _(spark, d):
    return rounded(prep.add_ratio(frame(spark, d, "events"), "value", "user_id").select("event_id", "value_to_user_id_ratio"))


@query("suggest_features", "SELECT feature, kind FROM (" + union([
    "SELECT unnest(['o_orderdate_year', 'o_orderdate_month', 'o_orderdate_is_weekend', 'o_orderdate_quarter']) AS feature, 'date' AS kind, 2 AS n",
    "SELECT 'o_orderkey_to_o_custkey_ratio', 'math', 2",
    *[f"SELECT '{c}_encoded', 'category', count(DISTINCT {c}) FROM orders HAVING count(DISTINCT {c}) BETWEEN 2 AND 30"
      for c in ("o_orderstatus", "o_orderpriority")],
    *[f"SELECT '{c}_freq', 'category', count(DISTINCT {c}) FROM orders HAVING count(DISTINCT {c}) <= 10"
      for c in ("o_orderstatus", "o_orderpriority")]]) + ")")
def _(spark, d):
    return prep.suggest_features(frame(spark, d, "orders")).select("feature", "kind")


@query("add_features", """
SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, round(o_orderkey / (o_custkey + 1e-9), 3) AS o_orderkey_to_o_custkey_ratio,
       count(*) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_freq,
       dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_encoded FROM orders""")
def _(spark, d):
    wanted = ["o_orderdate_year", "o_orderkey_to_o_custkey_ratio", "o_orderstatus_freq", "o_orderpriority_encoded"]
    out = prep.add_features(frame(spark, d, "orders"), wanted)
    return rounded(out.select("o_orderkey", *wanted), 3)
