"""Profiles, distributions, grouped summaries and SQL types."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.audit import NUMERIC, duplicates_sql, is_number
from plumbline.catalog.registry import columns_of, frame, query, rounded, stamp, union, with_table
from plumbline.functions import fixed
from plumbline.operators import correlation, profile, sqltypes
from plumbline.operators.privacy import masked
from plumbline.session import local_table
from plumbline.sources import files

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
JUNK = ", ".join("'" + w + "'" for w in fixed.JUNK_WORDS)


def top_sql(table: str, c: str, n: int, extra: str = "") -> str:
    return (f"SELECT CAST({c} AS STRING) AS value, count(*) AS count{extra} FROM {table} WHERE {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY count(*) DESC, value LIMIT {n}")


# -- columns ---------------------------------------------------------------------

def profile_sql(c: str, dtype: str, number: bool) -> str:
    moments = ["NULL"] * 5
    if number:
        moments = [f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)", f"round(avg({c}), 4)",
                   f"round(stddev_samp({c}), 4)", f"round(skewness({c}), 4)"]
    named = ", ".join(f"{m} AS {a}" for m, a in zip(moments, ["min", "max", "mean", "std", "skewness"]))
    return (f"SELECT '{c}' AS column_name, '{dtype}' AS dtype, count(*) AS rows, count(*) - count({c}) AS nulls, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct_values, "
            f"(SELECT string_agg(value || '=' || count, ';' ORDER BY count DESC, value) FROM ({top_sql('t', c, 5)})) AS top_5, "
            f"{named} FROM t")


@query("profile_column", with_table("events_gaps", union(
    [profile_sql("event_type", "string", False)] + [profile_sql("event_id", "bigint", True)])))
def _(spark, d):
    df = frame(spark, d, "events_gaps")
    both = profile.profile_column(df, "event_type").unionByName(profile.profile_column(df, "event_id"))
    return rounded(both.withColumnRenamed("column", "column_name"))


@query("numeric_profile", with_table("lineitem_gaps", union(
    f"""SELECT '{c}' AS column_name, round(100 - round((count(*) - count({c})) * 100.0 / count(*), 2), 4) AS fill_pct,
    min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
    round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
    round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
    round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr FROM t""" for c in LINE)))
def _(spark, d):
    return rounded(profile.numeric_profile(frame(spark, d, "lineitem_gaps"), LINE).withColumnRenamed("column", "column_name"))


@query("top_values", "SELECT value, count, round(count * 100.0 / (SELECT count(*) FROM part), 1) AS share_pct FROM ("
       + top_sql("part", "p_name", 10) + ")")
def _(spark, d):
    return rounded(profile.top_values(frame(spark, d, "part"), "p_name", 10))


@query("sample_values", "SELECT least(8, count(DISTINCT p_name)) AS sampled, least(8, count(DISTINCT p_name)) AS present FROM part")
def _(spark, d):
    df = frame(spark, d, "part")
    sample = profile.sample_values(df, "p_name", 8)
    known = sample.join(df.select(F.col("p_name").alias("value")).distinct(), "value", "left_semi")
    return sample.agg(F.countDistinct("value").alias("sampled"), F.lit(1).alias("one")).join(
        known.agg(F.count(F.lit(1)).alias("present"), F.lit(1).alias("one")), "one").drop("one")


@query("table_kpis", with_table("lineitem_gaps", f"""
SELECT count(*) AS rows, CAST({len(columns_of('lineitem_gaps'))} AS BIGINT) AS cols,
       CAST({' + '.join(f'(count(*) - count({c}))' for c in columns_of('lineitem_gaps'))} AS BIGINT) AS nulls,
       (SELECT dups FROM ({duplicates_sql('lineitem_gaps')})) AS duplicates FROM t"""))
def _(spark, d):
    return rounded(profile.table_kpis(frame(spark, d, "lineitem_gaps")))


@query("distribution_summary", with_table("events_gaps", """
SELECT 'value' AS column_name, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median,
       round(stddev_samp(value), 4) AS std, round(skewness(value), 4) AS skewness, count(*) - count(value) AS nulls FROM t"""))
def _(spark, d):
    return rounded(profile.distribution_summary(frame(spark, d, "events_gaps"), "value").withColumnRenamed("column", "column_name"))


@query("missing_summary", with_table("lineitem_gaps", union(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 2) "
    f"AS missing_pct, count({c}) AS present FROM t" for c in columns_of("lineitem_gaps"))))
def _(spark, d):
    return rounded(profile.missing_summary(frame(spark, d, "lineitem_gaps")).withColumnRenamed("column", "column_name"))


@query("outlier_table", with_table("events_spikes", union(
    f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean,
    round(stddev_samp({c}), 4) AS std, round(any_value(q3 - q1), 4) AS iqr,
    count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM t, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM t)"""
    for c in NUMERIC["events_spikes"])))
def _(spark, d):
    return rounded(profile.outlier_table(frame(spark, d, "events_spikes")).withColumnRenamed("column", "column_name"))


@query("column_stats", with_table("lineitem_gaps", union(
    f"""SELECT '{c}' AS column_name, '{k}' AS dtype, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values,
    {f'round(avg({c}), 4)' if n else 'NULL'} AS mean, {f'round(stddev_samp({c}), 4)' if n else 'NULL'} AS std FROM t"""
    for c, k, n in [("l_orderkey", "bigint", 1), ("l_partkey", "bigint", 1), ("l_suppkey", "bigint", 1),
                    ("l_linenumber", "int", 1), ("l_quantity", "double", 1), ("l_extendedprice", "double", 1),
                    ("l_discount", "double", 1), ("l_tax", "double", 1), ("l_returnflag", "string", 0),
                    ("l_linestatus", "string", 0), ("l_shipdate", "timestamp_ntz", 0)])))
def _(spark, d):
    return rounded(profile.column_stats(frame(spark, d, "lineitem_gaps")).withColumnRenamed("column", "column_name"))


@query("dataset_profile", with_table("events_gaps", union(
    ["SELECT 'shape' AS section, NULL AS column_name, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM t",
     "SELECT 'shape', NULL, 'cols', 3.0 FROM t HAVING count(*) > 0",
     "SELECT 'cardinality', 'event_type', 'distinct', count(DISTINCT event_type) FROM t"]
    + [f"SELECT 'nulls', '{c}', 'null_pct', round((count(*) - count({c})) * 100.0 / count(*), 1) FROM t"
       for c in ("event_id", "event_type", "value")]
    + [f"SELECT 'numbers', '{c}', '{m}', round({e}, {k}) FROM t" for c in ("event_id", "value")
       for m, e, k in (("min", f"CAST(min({c}) AS DOUBLE)", 4), ("max", f"CAST(max({c}) AS DOUBLE)", 4),
                       ("mean", f"avg({c})", 4), ("skew", f"skewness({c})", 3))])))
def _(spark, d):
    out = profile.dataset_profile(frame(spark, d, "events_gaps")).where("section <> 'samples'")
    return rounded(out.select("section", F.col("column").alias("column_name"), "metric", F.col("value").cast("double").alias("value")))


@query("dataset_profile_samples", union(
    f"SELECT '{c}' AS column_name, least(5, count(DISTINCT {c})) AS sampled, least(5, count(DISTINCT {c})) AS present FROM part"
    for c in ("p_name", "p_brand", "p_type")))
def _(spark, d):
    df = frame(spark, d, "part")
    samples = profile.dataset_profile(df).where("section = 'samples'")
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("p_name", "p_brand", "p_type")]))).distinct()
    return (samples.join(cells.withColumn("known", F.lit(1)), ["column", "value"], "left").groupBy(F.col("column").alias("column_name"))
            .agg(F.countDistinct("value").alias("sampled"), F.count("known").alias("present")))


@query("real_types", with_table("orders_text", union(
    f"SELECT '{c}' AS column_name, CASE WHEN avg(CASE WHEN {c} IS NULL OR lower(trim({c})) IN ({JUNK}) THEN NULL "
    f"WHEN {is_number(c)} THEN 1.0 ELSE 0 END) >= 0.7 THEN 'numeric' ELSE 'text' END AS real_type FROM t"
    for c in ("o_orderpriority", "total_text", "qty_text", "count_text", "active", "level"))
    + "\nUNION ALL SELECT unnest(['o_orderkey', 'flag']), 'numeric'"))
def _(spark, d):
    return profile.real_types(frame(spark, d, "orders_text")).withColumnRenamed("column", "column_name")


@query("junk_scan", with_table("orders_text", "SELECT column_name, word, count(*) AS count FROM (" + union(
    f"SELECT '{c}' AS column_name, lower(trim({c})) AS word FROM t" for c in
    ("o_orderpriority", "total_text", "qty_text", "count_text", "active", "level"))
    + f") WHERE word IN ({JUNK}) GROUP BY 1, 2"))
def _(spark, d):
    return profile.junk_scan(frame(spark, d, "orders_text")).withColumnRenamed("column", "column_name")


@query("impute_recommendations", with_table("lineitem_gaps", "SELECT column_name, nulls, round(mean, 4) AS mean, round(median, 4) AS median, "
       "round(s, 4) AS skewness, CASE WHEN abs(s) <= 1 THEN 'mean' ELSE 'median' END AS choice, "
       "round(CASE WHEN abs(s) <= 1 THEN mean ELSE median END, 4) AS fill FROM (" + union(
           f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, "
           f"skewness({c}) AS s FROM t" for c in LINE) + ") WHERE nulls > 0"))
def _(spark, d):
    return rounded(profile.impute_recommendations(frame(spark, d, "lineitem_gaps")).withColumnRenamed("column", "column_name"))


@query("fill_candidates", with_table("orders_text", union(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, v) AS rank, v AS value, count(*) AS count
    FROM (SELECT trim({c}) AS v FROM t) WHERE v IS NOT NULL AND lower(v) NOT IN ({JUNK}) GROUP BY v) WHERE rank <= 6"""
    for c in ("o_orderpriority", "count_text"))))
def _(spark, d):
    return rounded(profile.fill_candidates(frame(spark, d, "orders_text"), 6).withColumnRenamed("column", "column_name"))


# -- distributions ------------------------------------------------------------------

def histogram_sql(table: str, c: str, bins: int, by: str | None = None) -> str:
    key = f"{by} AS \"group\", " if by else ""
    group = "1, 2" if by else "1"
    return f"""
SELECT {key}CAST(least(floor(({c} - lo) / w), {bins - 1}) AS BIGINT) AS bin, count(*) AS count
FROM {table}, (SELECT min({c}) AS lo, (max({c}) - min({c})) / {bins} AS w FROM {table}) GROUP BY {group}"""


@query("histogram", "SELECT bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, count FROM ("
       + histogram_sql("lineitem", "l_extendedprice", 30)
       + "), (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)")
def _(spark, d):
    return rounded(profile.histogram(frame(spark, d, "lineitem"), "l_extendedprice", 30))


@query("histogram_by_group", "SELECT \"group\", bin, count FROM (" + histogram_sql("events", "value", 20, "event_type") + ")")
def _(spark, d):
    return profile.histogram(frame(spark, d, "events"), "value", 20, "event_type").select("group", "bin", "count")


@query("violin_density", f"""
WITH h AS ({histogram_sql("events", "value", 50, "event_type")}),
g AS (SELECT event_type AS "group", n, greatest(1.06 * s * pow(n, -0.2), w / 2) AS band, w FROM (
  SELECT event_type, count(value) AS n, stddev_samp(value) AS s FROM events GROUP BY 1), (SELECT (max(value) - min(value)) / 50 AS w FROM events))
SELECT h."group", b.bin, round(sum(h.count * exp(-pow((b.bin - h.bin) * w / band, 2) / 2)) / (any_value(n) * any_value(band) * sqrt(2 * pi())), 6) AS density
FROM h JOIN g USING ("group"), (SELECT unnest(range(50)) AS bin) b GROUP BY 1, 2""")
def _(spark, d):
    out = profile.density(frame(spark, d, "events"), "value", "event_type")
    return rounded(out.select("group", "bin", "density"), 6)


@query("value_counts", top_sql("orders", "o_orderpriority", 15))
def _(spark, d):
    return profile.top_values(frame(spark, d, "orders"), "o_orderpriority", 15).select("value", "count")


# -- correlation --------------------------------------------------------------------

@query("correlation_pearson", with_table("lineitem_gaps", "SELECT col_a, col_b, round(r, 4) AS r FROM (" + union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {'1.0' if a == b else f'corr({a}, {b})'} AS r FROM t"
    + (" HAVING count(*) > 0" if a == b else "") for a in LINE for b in LINE) + ")"))
def _(spark, d):
    return rounded(correlation.correlation_matrix(frame(spark, d, "lineitem_gaps"), LINE))


def ranked(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("correlation_spearman", "WITH r AS (SELECT " + ", ".join(
    f"{ranked(c)} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    + " FROM lineitem)\n" + union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS r FROM r" for a, b in
                                  [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]))
def _(spark, d):
    return rounded(correlation.spearman_pairs(frame(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("correlation_spearman_gaps", with_table("lineitem_gaps", f"""
, v AS (SELECT l_quantity, l_discount FROM t WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)
SELECT 'l_quantity' AS col_a, 'l_discount' AS col_b, round(corr(a, b), 4) AS r
FROM (SELECT {ranked('l_quantity')} AS a, {ranked('l_discount')} AS b FROM v)"""))
def _(spark, d):
    return rounded(correlation.spearman_pairs(frame(spark, d, "lineitem_gaps"), ["l_quantity", "l_discount"]))


@query("correlation_kendall", """
WITH p AS (SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
s AS (SELECT sum(CASE WHEN (a.x < b.x AND a.y < b.y) THEN a.w * b.w WHEN (a.x < b.x AND a.y > b.y) THEN -a.w * b.w ELSE 0 END) AS s
      FROM p a JOIN p b ON a.x < b.x),
n AS (SELECT sum(w) * (sum(w) - 1) / 2 AS n0 FROM p),
x AS (SELECT sum(w * (w - 1) / 2) AS n1 FROM (SELECT sum(w) AS w FROM p GROUP BY x)),
y AS (SELECT sum(w * (w - 1) / 2) AS n2 FROM (SELECT sum(w) AS w FROM p GROUP BY y))
SELECT 'l_quantity' AS col_a, 'l_discount' AS col_b, round(s / (sqrt(n0 - n1) * sqrt(n0 - n2)), 4) AS r FROM s, n, x, y""")
def _(spark, d):
    return rounded(correlation.kendall_pairs(frame(spark, d, "lineitem"), ["l_quantity", "l_discount"]))


@query("top_correlated_pairs", "SELECT col_a, col_b, round(r, 4) AS r FROM (" + union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM lineitem"
    for i, a in enumerate(NUMERIC["lineitem_gaps"]) for b in NUMERIC["lineitem_gaps"][i + 1:])
    + ") ORDER BY abs(r) DESC LIMIT 10")
def _(spark, d):
    return rounded(correlation.top_pairs(frame(spark, d, "lineitem")))


# -- grouped summaries ----------------------------------------------------------------

AGGREGATES = {"count": "count(o_totalprice)", "sum": "sum(o_totalprice)", "mean": "avg(o_totalprice)",
              "median": "quantile_cont(o_totalprice, 0.5)", "min": "min(o_totalprice)", "max": "max(o_totalprice)"}


def _group_query(fn: str) -> None:
    digits = 2 if fn == "sum" else 4
    sql = (f"SELECT o_custkey, {f'round({AGGREGATES[fn]}, {digits})' if fn != 'count' else AGGREGATES[fn]} AS value FROM orders "
           f"GROUP BY 1 ORDER BY {AGGREGATES[fn]} DESC, o_custkey LIMIT 15")

    @query(f"group_{fn}", sql)
    def _(spark, d):
        return rounded(profile.group_aggregate(frame(spark, d, "orders"), "o_custkey", "o_totalprice", fn), digits)


for _fn in AGGREGATES:
    _group_query(_fn)


@query("two_way_counts", """
SELECT p_brand, p_type, count(*) AS count FROM part WHERE p_brand IN (
  SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 15) GROUP BY 1, 2""")
def _(spark, d):
    return profile.two_way_counts(frame(spark, d, "part"), "p_brand", "p_type", 15)


@query("pie_shares", "SELECT value, count, round(count * 100.0 / sum(count) OVER (), 2) AS share_pct FROM ("
       + top_sql("part", "p_brand", 12) + ")")
def _(spark, d):
    return rounded(profile.pie_shares(frame(spark, d, "part"), "p_brand", 12))


@query("box_stats", with_table("events_spikes", """
, q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
        quantile_cont(value, 0.75) AS q3 FROM t GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT g AS "group", round(min(value), 4) AS min, round(min(value) FILTER (value BETWEEN lo AND hi), 4) AS low_whisker,
       round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
       round(max(value) FILTER (value BETWEEN lo AND hi), 4) AS high_whisker, round(max(value), 4) AS max,
       round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
       count(*) FILTER (NOT value BETWEEN lo AND hi) AS outliers
FROM t JOIN f ON event_type = g GROUP BY g"""))
def _(spark, d):
    return rounded(profile.box_stats(frame(spark, d, "events_spikes"), "value", "event_type"))


@query("series_by_month", f"""
SELECT {stamp("date_trunc('month', o_orderdate)")} AS x, o_orderstatus AS color, round(sum(o_totalprice), 2) AS y
FROM orders GROUP BY 1, 2""")
def _(spark, d):
    return rounded(profile.series(frame(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus", "sum"), 2)


@query("series_by_value", "SELECT CAST(l_quantity AS DOUBLE) AS x, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(profile.series(frame(spark, d, "lineitem"), "l_quantity", "l_extendedprice", fn="sum"), 2)


@query("trend_line", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""")
def _(spark, d):
    return rounded(profile.trend(frame(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("scatter_points", "SELECT least(1000, count(*)) AS points, least(1000, count(*)) AS present FROM lineitem")
def _(spark, d):
    df = frame(spark, d, "lineitem")
    points = profile.scatter_points(df, "l_quantity", "l_extendedprice", 1000)
    known = points.join(df.select("l_quantity", "l_extendedprice").distinct(), ["l_quantity", "l_extendedprice"], "left_semi")
    return points.agg(F.count(F.lit(1)).alias("points"), F.lit(1).alias("one")).join(
        known.agg(F.count(F.lit(1)).alias("present"), F.lit(1).alias("one")), "one").drop("one")


# -- rows ---------------------------------------------------------------------------

FILTERS = {
    "equals": ("==", "o_orderstatus", "F", "CAST(o_orderstatus AS STRING) = 'F'"),
    "not_equals": ("!=", "o_orderpriority", "5-LOW", "o_orderpriority IS DISTINCT FROM '5-LOW'"),
    "greater": (">", "o_totalprice", "250000", "o_totalprice > 250000"),
    "less": ("<", "o_totalprice", "5000.5", "o_totalprice < 5000.5"),
    "at_least": (">=", "o_orderkey", "700", "o_orderkey >= 700"),
    "at_most": ("<=", "o_custkey", "100", "o_custkey <= 100"),
    "contains": ("contains", "o_orderpriority", "h.gh|low", "regexp_matches(o_orderpriority, '(?i)h.gh|low')"),
}


def _filter_query(label: str) -> None:
    op, column, value, condition = FILTERS[label]

    @query(f"filter_{label}", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE {condition}")
    def _(spark, d):
        df = files.read_parquet(spark, f"{d}/orders.parquet", nan_as_null=False)
        return profile.filter_rows(df, column, op, value).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


for _label in FILTERS:
    _filter_query(_label)


@query("preview", "SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice FROM orders "
       "ORDER BY orders.o_totalprice, o_orderkey LIMIT 20")
def _(spark, d):
    df = frame(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(profile.preview(df, 20, ["o_totalprice", "o_orderkey"]))


MASK_SQL = ("CASE WHEN length({c}) > 4 THEN left({c}, 2) || repeat('*', length({c}) - 4) || right({c}, 2) "
            "ELSE repeat('*', length({c})) END")


@query("compare_masked", f"SELECT c_custkey, c_name AS original, {MASK_SQL.format(c='c_name')} AS changed "
       "FROM customer ORDER BY c_custkey LIMIT 8")
def _(spark, d):
    return profile.compare_columns(frame(spark, d, "customer"), "c_name", masked(F.col("c_name")), "c_custkey")


# -- SQL types ------------------------------------------------------------------------

def varchar_sql(c: str, big: str) -> str:
    size = f"CAST(ceil(greatest(50, floor(coalesce(max(length({c})), 50) * 1.25)) / 50.0) * 50 AS BIGINT)"
    return f"CASE WHEN {size} > 4000 THEN '{big}' ELSE 'VARCHAR(' || {size} || ')' END"


def integer_sql(c: str, tiny: str) -> str:
    return (f"CASE WHEN max(abs({c})) <= 127 THEN '{tiny}' WHEN max(abs({c})) <= 32767 THEN 'SMALLINT' "
            f"WHEN max(abs({c})) <= 2147483647 THEN 'INT' ELSE 'BIGINT' END")


ORDER_TYPES = [("o_orderkey", "bigint", "i"), ("o_custkey", "bigint", "i"), ("o_orderstatus", "string", "s"),
               ("o_totalprice", "double", "f"), ("o_orderdate", "timestamp_ntz", "t"), ("o_orderpriority", "string", "s")]


def type_sql(c: str, kind: str, dialect: str) -> str:
    return {"i": integer_sql(c, "SMALLINT" if dialect == "postgresql" else "TINYINT"),
            "s": varchar_sql(c, "NVARCHAR(MAX)" if dialect == "sqlserver" else "TEXT"),
            "f": "max('DECIMAL(18,2)')", "t": "max('DATETIME')" if dialect == "sqlserver" else "max('TIMESTAMP')"}[kind]


def _types_query(dialect: str) -> None:
    sql = union(f"SELECT '{c}' AS column_name, {type_sql(c, k, dialect)} AS sql_type FROM {t}" for t, cols in
                (("orders", [(c, k) for c, _, k in ORDER_TYPES]), ("documents", [("doc_id", "i"), ("text", "s"), ("lang", "s")]),
                 ("part", [("p_size", "i"), ("p_retailprice", "f")])) for c, k in cols)

    @query(f"sql_types_{dialect}", sql)
    def _(spark, d):
        tables = [frame(spark, d, "orders"), frame(spark, d, "documents").select("doc_id", "text", "lang"),
                  frame(spark, d, "part").select("p_size", "p_retailprice")]
        out = None
        for t in tables:
            part = sqltypes.sql_types(t, dialect).select(F.col("column").alias("column_name"), "sql_type")
            out = part if out is None else out.unionAll(part)
        return out


for _dialect in sqltypes.DIALECTS:
    _types_query(_dialect)


@query("primary_key", """
SELECT 'orders' AS table_name, CASE WHEN count(DISTINCT o_orderkey) = count(*) THEN 'o_orderkey' END AS key FROM orders
UNION ALL SELECT 'lineitem', CASE WHEN count(DISTINCT l_orderkey) = count(*) THEN 'l_orderkey'
  WHEN count(DISTINCT l_partkey) = count(*) THEN 'l_partkey' WHEN count(DISTINCT l_suppkey) = count(*) THEN 'l_suppkey' END FROM lineitem""")
def _(spark, d):
    rows = [(t, sqltypes.primary_key(frame(spark, d, t))) for t in ("orders", "lineitem")]
    return local_table(spark, rows, "table_name string, key string")


@query("type_map", union(
    f"SELECT '{c}' AS column_name, '{k}' AS dtype, {type_sql(c, t, 'mysql')} AS sql_type, count(*) - count({c}) AS nulls, "
    f"count(DISTINCT {c}) AS distinct_values, count(*) = count({c}) AS not_null, "
    f"{'count(*) = count(DISTINCT o_orderkey)' if c == 'o_orderkey' else 'false'} AS is_key FROM orders" for c, k, t in ORDER_TYPES))
def _(spark, d):
    return sqltypes.type_map(frame(spark, d, "orders"), "mysql").drop("position").withColumnRenamed("column", "column_name")


@query("create_table", "SELECT 'CREATE TABLE orders (' || chr(10) || " + " || ',' || chr(10) || ".join(
    f"'    {c} ' || {type_sql(c, t, 'postgresql')} || CASE WHEN count(*) = count({c}) THEN ' NOT NULL' ELSE '' END"
    + (" || CASE WHEN count(DISTINCT o_orderkey) = count(*) THEN ' PRIMARY KEY' ELSE '' END" if c == "o_orderkey" else "")
    for c, _, t in ORDER_TYPES) + " || chr(10) || ');' AS ddl FROM orders")
def _(spark, d):
    return local_table(spark, [(sqltypes.create_table(frame(spark, d, "orders"), "orders"),)], "ddl string")


@query("type_notes", "SELECT CASE WHEN sql_type LIKE '%VARCHAR%' THEN 'VARCHAR' WHEN sql_type = 'TINYINT' THEN 'TINYINT' "
       "WHEN sql_type LIKE '%DECIMAL%' THEN 'DECIMAL' END AS family, count(*) AS columns FROM (" + union(
           f"SELECT {type_sql(c, t, 'mysql')} AS sql_type FROM orders" for c, _, t in ORDER_TYPES)
       + ") WHERE family IS NOT NULL GROUP BY 1")
def _(spark, d):
    return sqltypes.type_notes(sqltypes.sql_types(frame(spark, d, "orders"), "mysql"))
