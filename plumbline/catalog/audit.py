"""Audit checks, score, plans and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import columns_of, findings, frame, query, rounded, union, with_table
from plumbline.functions import fixed
from plumbline.operators import checks, privacy, score, similarity
from plumbline.operators.metrics import per_column

AS_OF = "2000-06-15 00:00:00"

# -- SQL shared by the oracles ----------------------------------------------------

NUMERIC = {
    "lineitem_gaps": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                      "l_discount", "l_tax"],
    "lineitem_redundant": ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_gross", "l_fixed"],
    "customer_messy": ["c_custkey", "c_nationkey", "c_acctbal"],
    "events_spikes": ["event_id", "user_id", "value"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
}
TEXT = {
    "lineitem_gaps": ["l_returnflag", "l_linestatus"],
    "customer_messy": ["c_name", "c_mktsegment", "email", "phone", "note"],
    "orders_text": ["o_orderpriority", "total_text", "qty_text", "count_text", "active", "level"],
    "orders": ["o_orderstatus", "o_orderpriority"],
}

NUMBER = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$'"
WORD_EDGE = r"[^\p{{L}}\p{{N}}_]"
TEST_ROW = "regexp_matches(lower({c}), '(^|" + WORD_EDGE + ")(test|dummy|fake|sample|xxx|n/a|asdf|null|123)(" + WORD_EDGE + "|$)')"


def is_number(c: str) -> str:
    return f"regexp_matches({c}, {NUMBER})"


def parsed_date(c: str) -> str:
    return f"coalesce(try_cast({c} AS TIMESTAMP), try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%m/%d/%Y'))"


def not_title(c: str) -> str:
    return rf"(regexp_matches({c}, '(^|[^\p{{L}}])\p{{Ll}}') OR regexp_matches({c}, '\p{{L}}\p{{Lu}}'))"


def duplicates_sql(table: str) -> str:
    cols = ", ".join(columns_of(table))
    return (f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS dups "
            f"FROM (SELECT count(*) AS n FROM t GROUP BY {cols})")


def outliers_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, count(*) FILTER (abs(({c} - m) / s) > 3) AS z, any_value(q1) AS q1, "
            f"any_value(q3) AS q3, any_value(m) AS m, any_value(ss) AS ss FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM t), "
            f"(SELECT avg({c}) AS m, nullif(stddev_pop({c}), 0) AS s, stddev_samp({c}) AS ss, "
            f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, "
            f"count({c}) AS n FROM t) WHERE n >= 4")


def quality_flags(c: str) -> dict[str, str]:
    lettered = f"CASE WHEN regexp_matches({c}, '[a-zA-Z]') THEN {c} END"
    return {
        "edge_space": rf"coalesce(bool_or(regexp_matches({c}, '^\s|\s$')), false)",
        "inner_space": rf"coalesce(bool_or(regexp_matches({c}, '\s{{2,}}')), false)",
        "sql_breaking": rf"coalesce(bool_or(regexp_matches({c}, '[''\";\\]')), false)",
        "html_tags": f"coalesce(bool_or(regexp_matches({c}, '<[^>]+>')), false)",
        "inconsistent_casing":
            f"count({lettered}) >= 10 AND avg(CASE WHEN {lettered} = lower({c}) THEN 1.0 WHEN {lettered} IS NOT NULL THEN 0 END) < 0.8 "
            f"AND avg(CASE WHEN {lettered} = upper({c}) THEN 1.0 WHEN {lettered} IS NOT NULL THEN 0 END) < 0.8 "
            f"AND avg(CASE WHEN {lettered} IS NULL THEN NULL WHEN {not_title(c)} THEN 0 ELSE 1.0 END) < 0.8",
    }


def flags_sql(flags: dict[str, dict[str, str]]) -> str:
    return union(f"SELECT '{c}' AS column_name, '{m}' AS metric, CAST(1 AS DOUBLE) AS value FROM t HAVING {cond}"
                 for c, by in flags.items() for m, cond in by.items())


def money_flag(c: str) -> str:
    clean = f"regexp_replace({c}, '[$,%€£]', '', 'g')"
    return f"avg(CASE WHEN {c} IS NULL THEN NULL WHEN {is_number(clean)} THEN 1.0 ELSE 0 END) > 0.85"


def boolean_flag(c: str) -> str:
    pairs = " OR ".join(f"list_sort(list(DISTINCT lower(CAST({c} AS STRING)))) = ['{a}', '{b}']"
                        for a, b in (sorted(p) for p in fixed.BOOLEAN_PAIRS))
    return f"coalesce({pairs}, false)"


def pairs_sql(table: str, threshold: float, columns: list[str], limit: int = 200) -> str:
    values = union(f"SELECT '{c}' AS column_name, {c} AS v FROM t WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)
    return (f"SELECT a.column_name, a.v AS value_a, b.v AS value_b, "
            f"100.0 * (1 - levenshtein(a.v, b.v) / CAST(greatest(length(a.v), length(b.v)) AS DOUBLE)) AS similarity "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY column_name) AS k FROM ({values})) a "
            f"JOIN ({values}) b ON a.column_name = b.column_name AND a.v < b.v AND a.k <= {limit} "
            f"WHERE similarity >= {threshold}")


# -- single checks ------------------------------------------------------------------

@query("check_duplicates", with_table("orders_twice", f"""
, d AS ({duplicates_sql('orders_twice')})
SELECT 'count' AS metric, CAST(dups AS DOUBLE) AS value FROM d
UNION ALL SELECT 'pct', round(dups * 100.0 / n_rows, 2) FROM d"""))
def _(spark, d):
    return rounded(checks.check_duplicates(frame(spark, d, "orders_twice")).select("metric", "value"))


@query("check_empty_rows", with_table("orders_blank", """
SELECT CAST(count(*) AS DOUBLE) AS value FROM t
WHERE (priority IS NULL OR trim(priority) = '') AND price IS NULL"""))
def _(spark, d):
    return rounded(checks.check_empty_rows(frame(spark, d, "orders_blank").drop("o_orderkey")).select("value"))


@query("check_nulls", with_table("lineitem_gaps", union(
    f"SELECT '{c}' AS column_name, 'null_count' AS metric, CAST(count(*) - count({c}) AS DOUBLE) AS value FROM t HAVING value > 0 "
    f"UNION ALL SELECT '{c}', 'null_pct', round((count(*) - count({c})) * 100.0 / count(*), 2) AS v FROM t HAVING v > 0"
    for c in columns_of("lineitem_gaps"))))
def _(spark, d):
    return findings(checks.check_nulls(frame(spark, d, "lineitem_gaps")))


@query("check_outliers", with_table("events_spikes", f"""
, o AS ({union(outliers_sql(c) for c in NUMERIC['events_spikes'])})
SELECT column_name, metric, round(value, 4) AS value FROM (
  SELECT column_name, unnest(['zscore_outliers', 'iqr_lower', 'iqr_upper', 'mean', 'std']) AS metric,
         unnest([CAST(z AS DOUBLE), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), m, ss]) AS value
  FROM o WHERE z > 0)"""))
def _(spark, d):
    return findings(checks.check_outliers(frame(spark, d, "events_spikes")))


@query("check_column_names", """
SELECT column_name, cells FROM (
  SELECT unnest(['Order Key', 'o_custkey', ' status', 'Total-Price', 'o_orderdate', 'o_Priority']) AS column_name,
         unnest([count(o_orderkey), count(o_custkey), count(o_orderstatus), count(o_totalprice), count(o_orderdate), count(o_orderpriority)]) AS cells FROM orders)
WHERE NOT regexp_full_match(lower(column_name), '[a-z0-9_]+') OR regexp_matches(column_name, '^[A-Z]')""")
def _(spark, d):
    df = frame(spark, d, "orders").withColumnsRenamed(
        {"o_orderkey": "Order Key", "o_orderstatus": " status", "o_totalprice": "Total-Price", "o_orderpriority": "o_Priority"})
    cells = per_column(df, None, ["rows", "nulls"]).select("column", (F.col("rows") - F.col("nulls")).alias("cells"))
    return checks.check_column_names(df).join(cells, "column").select(F.col("column").alias("column_name"), "cells")


@query("check_string_quality", with_table(
    "customer_messy", flags_sql({c: quality_flags(c) for c in TEXT["customer_messy"]})))
def _(spark, d):
    return findings(checks.check_string_quality(frame(spark, d, "customer_messy")))


@query("check_string_quality_documents", "WITH t AS (SELECT text, lang, source FROM documents)\n"
       + flags_sql({c: quality_flags(c) for c in ("text", "lang", "source")}))
def _(spark, d):
    return findings(checks.check_string_quality(frame(spark, d, "documents").select("text", "lang", "source")))


def dates_sql(c: str, as_of: str) -> str:
    return (f"SELECT '{c}' AS column_name, 'unparseable' AS metric, CAST(count(*) FILTER ({c} IS NOT NULL AND "
            f"{parsed_date(c)} IS NULL) AS DOUBLE) AS value FROM t UNION ALL SELECT '{c}', 'future_dates', "
            f"CAST(count(*) FILTER ({parsed_date(c)} > TIMESTAMP '{as_of}') AS DOUBLE) FROM t")


@query("check_date_formats", with_table("orders_dates", dates_sql("order_date", AS_OF)))
def _(spark, d):
    return findings(checks.check_date_formats(frame(spark, d, "orders_dates"), AS_OF))


@query("check_data_types", with_table("orders_text", flags_sql(
    {c: {"numeric_as_text": money_flag(c), "boolean_as_other": boolean_flag(c)} for c in TEXT["orders_text"]}
    | {"flag": {"boolean_as_other": boolean_flag("flag")}, "o_orderkey": {"boolean_as_other": boolean_flag("o_orderkey")}})))
def _(spark, d):
    return findings(checks.check_data_types(frame(spark, d, "orders_text")))


@query("schema_issues", with_table("orders_text", flags_sql(
    {c: {"numeric_as_text": money_flag(c), "boolean_as_other": boolean_flag(c)} for c in TEXT["orders_text"]}
    | {"flag": {"boolean_as_other": boolean_flag("flag")}, "o_orderkey": {"boolean_as_other": boolean_flag("o_orderkey")}})))
def _(spark, d):
    return findings(checks.schema_issues(frame(spark, d, "orders_text")).where("metric <> 'date_as_text'"))


@query("schema_issues_dates", with_table("orders_dates", flags_sql({"order_date": {
    "date_as_text": f"avg(CASE WHEN order_date IS NULL THEN NULL WHEN {parsed_date('order_date')} IS NULL THEN 0 ELSE 1.0 END) > 0.85"}})))
def _(spark, d):
    return findings(checks.schema_issues(frame(spark, d, "orders_dates")))


@query("check_sparse_columns", with_table("lineitem_gaps", union(
    f"SELECT '{c}' AS column_name, 'null_pct' AS metric, round((count(*) - count({c})) * 100.0 / count(*), 1) AS value FROM t "
    f"HAVING (count(*) - count({c})) / CAST(count(*) AS DOUBLE) > 0.5" for c in columns_of("lineitem_gaps"))))
def _(spark, d):
    return findings(checks.check_sparse_columns(frame(spark, d, "lineitem_gaps")))


@query("check_constant_columns", with_table("lineitem_redundant", union(
    f"SELECT '{c}' AS column_name, 'distinct' AS metric, CAST(count(DISTINCT {c}) AS DOUBLE) AS value FROM t HAVING value <= 1"
    for c in columns_of("lineitem_redundant"))))
def _(spark, d):
    return findings(checks.check_constant_columns(frame(spark, d, "lineitem_redundant")))


def correlations_sql(columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL "
                 f"ELSE corr({a}, {b}) END AS r FROM t" for a, b in pairs)


@query("check_high_correlation", with_table("lineitem_redundant", f"""
SELECT col_a AS column_name, col_b AS metric, round(abs(r), 4) AS value
FROM ({correlations_sql(NUMERIC['lineitem_redundant'])}) WHERE abs(r) > 0.95"""))
def _(spark, d):
    return findings(checks.check_high_correlation(frame(spark, d, "lineitem_redundant")))


@query("check_mixed_types", with_table("orders_text", union(
    f"SELECT '{c}' AS column_name, 'numeric_pct' AS metric, round(100 * s, 1) AS value FROM (SELECT avg(CASE WHEN {c} IS NULL "
    f"THEN NULL WHEN {is_number(c)} THEN 1.0 ELSE 0 END) AS s FROM t) WHERE s > 0.1 AND s < 0.9"
    for c in TEXT["orders_text"])))
def _(spark, d):
    return findings(checks.check_mixed_types(frame(spark, d, "orders_text")))


EMAIL_OK = r"regexp_matches({c}, '^[\w\.-]+@[\w\.-]+\.\w{{2,}}$')"
PHONE_OK = r"regexp_matches({c}, '^\+?[\d\s\-\(\)]{{7,15}}$')"


@query("check_email_format", with_table("customer_messy", f"""
SELECT 'email' AS column_name, 'invalid' AS metric, CAST(count(*) FILTER (NOT {EMAIL_OK.format(c='email')}) AS DOUBLE) AS value FROM t"""))
def _(spark, d):
    return findings(checks.check_email_format(frame(spark, d, "customer_messy")))


@query("check_phone_format", with_table("customer_messy", f"""
SELECT 'phone' AS column_name, 'invalid' AS metric, CAST(count(*) FILTER (NOT {PHONE_OK.format(c='phone')}) AS DOUBLE) AS value FROM t"""))
def _(spark, d):
    return findings(checks.check_phone_format(frame(spark, d, "customer_messy")))


@query("check_test_data", "SELECT CAST(count(*) AS DOUBLE) AS value FROM documents WHERE "
       + " OR ".join(TEST_ROW.format(c=c) for c in ("text", "lang", "source")))
def _(spark, d):
    return rounded(checks.check_test_data(frame(spark, d, "documents")).select("value"))


@query("check_typos", with_table("customer_messy", f"""
, p AS ({pairs_sql('customer_messy', 85, ['c_mktsegment', 'note'])})
SELECT column_name, 'similar_pairs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1
UNION ALL SELECT column_name, 'similar_values', CAST(count(DISTINCT v) AS DOUBLE)
FROM (SELECT column_name, value_a AS v FROM p UNION ALL SELECT column_name, value_b FROM p) GROUP BY 1"""))
def _(spark, d):
    return findings(checks.check_typos(frame(spark, d, "customer_messy"), columns=["c_mktsegment", "note"]))


@query("typo_pairs", with_table("customer_messy", f"""
SELECT column_name, value_a, value_b, round(similarity, 4) AS similarity
FROM ({pairs_sql('customer_messy', 60, ['c_mktsegment'])})"""))
def _(spark, d):
    pairs = similarity.typo_pairs(frame(spark, d, "customer_messy"), ["c_mktsegment"], 60)
    return rounded(pairs.withColumnRenamed("column", "column_name"))


@query("check_pii", with_table("customer_messy", "SELECT * FROM (" + union(
    f"SELECT '{c}' AS column_name, count({c}) AS cells FROM t" for c in columns_of("customer_messy"))
    + ") WHERE regexp_matches(column_name, 'name|mail|phone|address|ssn|passport|birth')"))
def _(spark, d):
    df = frame(spark, d, "customer_messy")
    cells = per_column(df, privacy.pii_columns(df), ["rows", "nulls"])
    return checks.check_pii(df).join(cells, "column").select(
        F.col("column").alias("column_name"), (F.col("rows") - F.col("nulls")).alias("cells"))


# -- the whole audit ------------------------------------------------------------------

# Place, check, automatic or manual, fix, cost when high, cost when medium; stated apart from the checks themselves.
RULES = """
(0, 'duplicates', 'A', 'remove_duplicates', 20, 10), (1, 'empty_rows', 'A', 'drop_empty_rows', 10, 5), (2, 'nulls', 'A', 'smart_impute', 25, 12),
(3, 'outliers', 'A', 'handle_outliers', 15, 7), (4, 'column_names', 'A', 'clean_column_names', 0, 5), (5, 'string_quality', 'A', 'standardize_strings', 0, 7),
(6, 'date_formats', 'A', 'fix_date_formats', 0, 8), (7, 'data_types', 'A', 'fix_numeric_strings', 0, 8), (8, 'sparse_columns', 'A', 'drop_sparse_columns', 15, 8),
(9, 'constant_columns', 'A', 'drop_constant_columns', 0, 5), (10, 'high_correlation', 'A', 'drop_highly_correlated', 0, 5), (11, 'mixed_types', 'M', NULL, 0, 7),
(12, 'email_format', 'A', 'validate_emails', 10, 5), (13, 'phone_format', 'A', 'validate_phones', 0, 5), (14, 'test_data', 'A', 'flag_test_data', 0, 5),
(15, 'typos', 'A', 'auto_fix_typos', 0, 5), (16, 'pii', 'M', NULL, 10, 0)"""


def audit_sql(table: str, numeric: list[str], texts: list[str], dates: list[str], emails: list[str], phones: list[str],
              pii: int, cast: dict[str, str] | None = None) -> str:
    """CTEs ``t``, ``totals(check_name, total)`` and ``summary`` for one table, from the checks' own SQL."""
    columns = columns_of(table)
    zero = "SELECT CAST(0 AS BIGINT) AS total"
    per = lambda parts: f"SELECT CAST(count(DISTINCT column_name) AS BIGINT) AS total FROM ({union(parts)})" if parts else zero
    total = lambda parts: f"SELECT CAST(sum(v) AS BIGINT) AS total FROM ({union(parts)})" if parts else zero
    blank = " AND ".join(rf"({c} IS NULL OR regexp_matches(CAST({c} AS STRING), '^\s*$'))" for c in columns)
    worded = [c for c in columns if c in texts or c in (numeric if cast is None else [])]
    parts = {
        "duplicates": f"SELECT dups AS total FROM ({duplicates_sql(table)})",
        "empty_rows": f"SELECT count(*) AS total FROM t WHERE {blank}",
        "nulls": total([f"SELECT count(*) - count({c}) AS v FROM t" for c in columns]),
        "outliers": total([f"SELECT z AS v FROM ({outliers_sql(c)})" for c in numeric]),
        "column_names": zero,
        "string_quality": per([flags_sql({c: quality_flags(c)}) for c in texts]),
        "date_formats": per([f"SELECT * FROM ({dates_sql(c, AS_OF)}) WHERE value > 0" for c in dates]),
        "data_types": per([flags_sql({c: ({"n": money_flag(c)} if c in texts else {}) | {"b": boolean_flag(c)}})
                           for c in worded]),
        "sparse_columns": per([f"SELECT '{c}' AS column_name FROM t HAVING count({c}) < 0.5 * count(*)" for c in columns]),
        "constant_columns": per([f"SELECT '{c}' AS column_name FROM t HAVING count(DISTINCT {c}) <= 1" for c in columns]),
        "high_correlation": f"SELECT count(*) AS total FROM ({correlations_sql(numeric)}) WHERE abs(r) > 0.95",
        "mixed_types": per([f"SELECT '{c}' AS column_name FROM t HAVING avg(CASE WHEN {c} IS NULL THEN NULL WHEN {is_number(c)} "
                            f"THEN 1.0 ELSE 0 END) BETWEEN 0.1000001 AND 0.8999999" for c in texts]),
        "email_format": total([f"SELECT count(*) FILTER (NOT {EMAIL_OK.format(c=c)}) AS v FROM t" for c in emails]),
        "phone_format": total([f"SELECT count(*) FILTER (NOT {PHONE_OK.format(c=c)}) AS v FROM t" for c in phones]),
        "test_data": f"SELECT count(*) AS total FROM t WHERE "
                     + (" OR ".join(f"coalesce({TEST_ROW.format(c=c)}, false)" for c in texts) or "false"),
        "typos": f"SELECT count(DISTINCT column_name) AS total FROM ({pairs_sql(table, 85, texts)})" if texts else zero,
        "pii": f"SELECT CAST({pii} AS BIGINT) AS total",
    }
    totals = union(f"SELECT '{check}' AS check_name, total FROM ({sql})" for check, sql in parts.items())
    return with_table(table, f"""
, totals AS ({totals})
, summary AS (
  SELECT *, CASE severity WHEN 'HIGH' THEN high WHEN 'MEDIUM' THEN medium ELSE 0 END AS points, total > 0 AS found FROM (
    SELECT r.*, total, CASE
      WHEN r.check_name = 'nulls' THEN CASE WHEN total / CAST(cells AS DOUBLE) >= 0.15 THEN 'HIGH'
                                       WHEN total / CAST(cells AS DOUBLE) >= 0.05 THEN 'MEDIUM' ELSE 'OK' END
      WHEN total = 0 THEN 'OK'
      WHEN r.check_name = 'duplicates' AND total >= 0.1 * n THEN 'HIGH'
      WHEN r.check_name = 'empty_rows' AND total >= 10 THEN 'HIGH'
      WHEN r.check_name = 'outliers' AND total >= 50 THEN 'HIGH'
      WHEN r.check_name IN ('sparse_columns', 'email_format', 'pii') THEN 'HIGH'
      ELSE 'MEDIUM' END AS severity
    FROM (VALUES {RULES}) r(position, check_name, category, fix_key, high, medium)
    JOIN totals USING (check_name), (SELECT count(*) AS n, count(*) * {len(columns)} AS cells FROM t)))""")


CUSTOMER_AUDIT = audit_sql("customer_messy", NUMERIC["customer_messy"], TEXT["customer_messy"], [], ["email"], ["phone"], 3)
LINEITEM_AUDIT = audit_sql("lineitem_gaps", NUMERIC["lineitem_gaps"], TEXT["lineitem_gaps"], ["l_shipdate"], [], [], 1) \
    .replace("try_strptime(l_shipdate, '%d/%m/%Y')", "NULL").replace("try_strptime(l_shipdate, '%m/%d/%Y')", "NULL")


def _customer(spark, d):
    return score.audit(frame(spark, d, "customer_messy"), as_of=AS_OF)


def _lineitem(spark, d):
    return score.audit(frame(spark, d, "lineitem_gaps"), as_of=AS_OF)


SUMMARY = "SELECT check_name, found, total, severity, CAST(points AS BIGINT) AS points FROM summary"


def _summary(audit):
    return rounded(audit.summary.select(F.col("check").alias("check_name"), "found", "total", "severity", "points"))


@query("audit_customer", CUSTOMER_AUDIT + SUMMARY)
def _(spark, d):
    return _summary(_customer(spark, d))


@query("audit_lineitem", LINEITEM_AUDIT + SUMMARY)
def _(spark, d):
    return _summary(_lineitem(spark, d))


@query("health_score", CUSTOMER_AUDIT + """
SELECT CAST(s AS BIGINT) AS health_score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 55 THEN 'C' ELSE 'D' END
  AS health_grade, issues AS issues_found
FROM (SELECT greatest(0, 100 - sum(points)) AS s, count(*) FILTER (found) AS issues FROM summary)""")
def _(spark, d):
    return rounded(score.health(_customer(spark, d).summary))


@query("fix_plan_all", CUSTOMER_AUDIT + """
SELECT check_name, category = 'A' AND found AND fix_key IS NOT NULL AS approved FROM summary""")
def _(spark, d):
    plan = score.fix_plan(_customer(spark, d).summary, "auto_all")
    return plan.select(F.col("check").alias("check_name"), "approved")


@query("fix_plan_high", CUSTOMER_AUDIT + """
SELECT check_name, category = 'A' AND found AND fix_key IS NOT NULL AND severity = 'HIGH' AS approved FROM summary""")
def _(spark, d):
    plan = score.fix_plan(_customer(spark, d).summary, "auto_high")
    return plan.select(F.col("check").alias("check_name"), "approved")


@query("fix_plan_default", LINEITEM_AUDIT + """
SELECT check_name, found AND severity = 'HIGH' AS approved FROM summary WHERE check_name NOT IN ('pii', 'mixed_types')""")
def _(spark, d):
    plan = score.default_plan(_lineitem(spark, d).summary)
    return plan.select(F.col("check").alias("check_name"), "approved")


@query("insights", LINEITEM_AUDIT + "SELECT * FROM (\n" + union(
    f"""SELECT CASE WHEN p >= 30 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'gap' AS rule, '{c}' AS column_name,
    p AS value, CASE WHEN p < 30 THEN 'averages' ELSE 'other' END AS impact
    FROM (SELECT round((count(*) - count({c})) * 100.0 / count(*), 2) AS p FROM t) WHERE p >= 10"""
    for c in columns_of("lineitem_gaps")) + """
UNION ALL SELECT CASE WHEN p > 5 THEN 'HIGH' ELSE 'MEDIUM' END, 'duplicates', NULL, p, 'totals'
  FROM (SELECT round(max(s.total) * 100.0 / (SELECT count(*) FROM t), 2) AS p FROM summary s WHERE check_name = 'duplicates') WHERE p > 0
UNION ALL SELECT 'MEDIUM', 'sparse', NULL, CAST(total AS DOUBLE), 'noise' FROM summary WHERE check_name = 'sparse_columns' AND found
UNION ALL SELECT 'MEDIUM', 'typos', NULL, CAST(total AS DOUBLE), 'segments' FROM summary WHERE check_name = 'typos' AND found
UNION ALL SELECT 'HIGH', 'pii', NULL, CAST(total AS DOUBLE), 'privacy' FROM summary WHERE check_name = 'pii' AND found
UNION ALL SELECT 'MEDIUM', 'outliers', column_name, CAST(z AS DOUBLE), 'anomalies' FROM ("""
       + union(outliers_sql(c) for c in NUMERIC["lineitem_gaps"]) + """) WHERE z > 0)""")
def _(spark, d):
    audit = _lineitem(spark, d)
    return rounded(score.insights(audit.findings, audit.columns).withColumnRenamed("column", "column_name"))


@query("null_impact", with_table("customer_messy", """
SELECT column_name, CASE WHEN regexp_matches(column_name, 'phone|mobile|tel') THEN 'contact' WHEN regexp_matches(column_name, 'mail') THEN 'email'
  WHEN regexp_matches(column_name, 'price|revenue|amount|sales|cost') THEN 'finance' WHEN regexp_matches(column_name, 'date|time|created|updated') THEN 'time'
  WHEN regexp_matches(column_name, 'name|customer|client|user') THEN 'identity'
  WHEN regexp_matches(column_name, 'age|gender|region|city|country') THEN 'demography' ELSE 'other' END AS impact FROM (""" + union(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM t" for c in columns_of("customer_messy")) + ") WHERE nulls > 0"))
def _(spark, d):
    gaps = per_column(frame(spark, d, "customer_messy"), None, ["nulls"]).where("nulls > 0")
    return gaps.select(F.col("column").alias("column_name"), score.impact_class(F.col("column")).alias("impact"))


@query("audit_digest", LINEITEM_AUDIT + """
SELECT check_name, severity, total, CASE WHEN check_name = 'nulls' THEN (SELECT string_agg(c, ',' ORDER BY k DESC, p) FROM ("""
       + union(f"SELECT '{c}' AS c, {i} AS p, count(*) - count({c}) AS k FROM t"
               for i, c in enumerate(columns_of("lineitem_gaps"))) + """) WHERE k > 0) ELSE '' END AS worst FROM summary""")
def _(spark, d):
    audit = _lineitem(spark, d)
    return score.digest(audit.findings, audit.summary, audit.columns).select(
        F.col("check").alias("check_name"), "severity", "total", "worst")


@query("severity_counts", CUSTOMER_AUDIT + "SELECT severity, count(*) AS checks FROM summary GROUP BY 1")
def _(spark, d):
    return score.severity_counts(_customer(spark, d).summary)


@query("issue_table", CUSTOMER_AUDIT + """
SELECT label, severity, found, CASE category WHEN 'A' THEN 'Auto-fix' ELSE 'Manual' END AS category, fix_key
FROM summary JOIN (VALUES """ + ", ".join(f"('{c[0]}', '{c[1]}')" for c in fixed.CHECKS) + ") l(check_name, label) USING (check_name)")
def _(spark, d):
    return score.issue_table(_customer(spark, d).summary)
