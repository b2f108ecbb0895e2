"""Row, column, null, type, text and outlier fixes, validation and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.audit import AS_OF, EMAIL_OK, PHONE_OK, TEST_ROW, is_number, parsed_date
from plumbline.catalog.profiling import JUNK, MASK_SQL
from plumbline.catalog.registry import columns_of, frame, query, rounded, source, stamp, union, with_table
from plumbline.operators import clean, privacy, similarity, validate
from plumbline.plans import workflow

# -- rows -----------------------------------------------------------------------

ORDER_KEYS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query("remove_duplicates", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderpriority,
       {stamp('min(o_orderdate)')} AS o_orderdate FROM {source('orders_twice')} AS s GROUP BY {ORDER_KEYS}""")
def _(spark, d):
    return rounded(clean.remove_duplicates(frame(spark, d, "orders_twice"), order_by="o_orderdate"))


@query("remove_duplicates_all_columns", f"""
SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderpriority,
       {stamp('o_orderdate')} AS o_orderdate FROM {source('orders_twice')} AS s""")
def _(spark, d):
    return rounded(clean.remove_duplicates(frame(spark, d, "orders_twice"), exclude_temporal=False))


def _keep(n: str, direction: str) -> str:
    return f"""
SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus
  ORDER BY o_orderdate {direction}, o_orderkey {direction}) AS rn, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n
  FROM orders) WHERE {n}"""


@query("remove_duplicates_keep_first", _keep("rn = 1", "ASC"))
def _(spark, d):
    return clean.remove_duplicates(frame(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "first",
                                   ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("remove_duplicates_keep_last", _keep("rn = 1", "DESC"))
def _(spark, d):
    return clean.remove_duplicates(frame(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "last",
                                   ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("remove_duplicates_keep_none", _keep("n = 1", "ASC"))
def _(spark, d):
    return clean.remove_duplicates(frame(spark, d, "orders"), ["o_custkey", "o_orderstatus"], False) \
        .select("o_orderkey", "o_custkey", "o_orderstatus")


@query("dropped_duplicates", """
SELECT event_id, user_id, event_type, kept_id FROM (
  SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS kept_id FROM events) WHERE event_id <> kept_id""")
def _(spark, d):
    df = frame(spark, d, "events").select("event_id", "user_id", "event_type")
    return clean.dropped_duplicates(df, "event_id", ["user_id", "event_type"])


@query("drop_empty_rows", with_table("orders_blank", """
SELECT CASE WHEN trim(priority) <> '' THEN priority END AS priority, round(price, 4) AS price FROM t
WHERE trim(priority) <> '' OR price IS NOT NULL"""))
def _(spark, d):
    return rounded(clean.drop_empty_rows(frame(spark, d, "orders_blank").drop("o_orderkey")))


# -- columns --------------------------------------------------------------------

@query("drop_sparse_columns", with_table("lineitem_gaps", "SELECT " + ", ".join(
    (f"round({c}, 4) AS {c}" if c in ("l_quantity", "l_extendedprice", "l_discount") else
     f"{stamp(c)} AS {c}" if c == "l_shipdate" else f"CAST({c} AS BIGINT) AS {c}" if c == "l_linenumber" else c)
    for c in columns_of("lineitem_gaps") if c != "l_tax") + " FROM t"))
def _(spark, d):
    return rounded(clean.drop_sparse_columns(frame(spark, d, "lineitem_gaps")))


@query("drop_constant_columns", with_table("lineitem_redundant", "SELECT " + ", ".join(
    f"round({c}, 4) AS {c}" for c in columns_of("lineitem_redundant") if c not in ("l_fixed", "l_status")) + " FROM t"))
def _(spark, d):
    return rounded(clean.drop_constant_columns(frame(spark, d, "lineitem_redundant")))


@query("drop_highly_correlated", with_table("lineitem_redundant", "SELECT " + ", ".join(
    (f"round({c}, 4) AS {c}" if c != "l_status" else c) for c in columns_of("lineitem_redundant") if c != "l_gross") + " FROM t"))
def _(spark, d):
    return rounded(clean.drop_highly_correlated(frame(spark, d, "lineitem_redundant")))


@query("clean_column_names", "SELECT o_orderkey AS order_key, o_custkey AS customer_id, o_orderstatus AS status FROM orders")
def _(spark, d):
    df = frame(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return clean.clean_column_names(df.toDF("Order Key!", " Customer--ID", "_Status"))


@query("rename_columns", "SELECT r_regionkey AS region_id, r_name AS region FROM region")
def _(spark, d):
    return rounded(clean.rename_columns(frame(spark, d, "region"), {"r_regionkey": "region_id", "r_name": "region"}))


@query("reorder_columns", "SELECT p_name, p_partkey, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 4) AS p_retailprice FROM part")
def _(spark, d):
    return rounded(clean.reorder_columns(frame(spark, d, "part"), ["p_name", "p_partkey"]))


@query("split_column", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, nullif(split_part(p_name, ' ', 2), '') AS thing FROM part""")
def _(spark, d):
    return clean.split_column(frame(spark, d, "part"), "p_name", " ", ["colour", "thing"]).select("p_partkey", "colour", "thing")


@query("merge_columns", with_table("events_gaps", "SELECT event_id, concat_ws('/', CAST(event_id AS STRING), event_type) AS label FROM t"))
def _(spark, d):
    return clean.merge_columns(frame(spark, d, "events_gaps"), ["event_id", "event_type"], "label", "/").select("event_id", "label")


@query("replace_values", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _(spark, d):
    df = frame(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return clean.replace_values(df, "o_orderstatus", {"F": "finished", "O": "open"})


# -- nulls ----------------------------------------------------------------------

def _null_query(strategy: str, value: str, **options) -> None:
    @query(f"handle_nulls_{strategy}", with_table("events_gaps", f"""
SELECT event_id, coalesce(event_type, 'Unknown') AS event_type, round(coalesce(value, {value}), 4) AS value FROM t"""))
    def _(spark, d):
        return rounded(clean.handle_nulls(frame(spark, d, "events_gaps"), strategy, **options))


_null_query("mean", "(SELECT avg(value) FROM t)")
_null_query("median", "(SELECT quantile_cont(value, 0.5) FROM t)")
_null_query("mode", "(SELECT value FROM t WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
_null_query("constant", "-1", fill_value=-1.0)


@query("handle_nulls_ffill", with_table("events_gaps", """
SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM t"""))
def _(spark, d):
    return rounded(clean.handle_nulls(frame(spark, d, "events_gaps"), "ffill", None, ["value"], "event_id").drop("event_type"))


@query("handle_nulls_bfill", with_table("events_gaps", """
SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS value FROM t"""))
def _(spark, d):
    return rounded(clean.handle_nulls(frame(spark, d, "events_gaps"), "bfill", None, ["value"], "event_id").drop("event_type"))


@query("handle_nulls_interpolate", with_table("events_gaps", """
, p AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM t),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
      first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p)
SELECT n.event_id, round(coalesce(n.value, pa.value + (pb.value - pa.value) * (n.rn - a) / CAST(nullif(b - a, 0) AS DOUBLE), pa.value, pb.value), 4) AS value
FROM n LEFT JOIN p pa ON pa.rn = a LEFT JOIN p pb ON pb.rn = b"""))
def _(spark, d):
    return rounded(clean.handle_nulls(frame(spark, d, "events_gaps"), "interpolate", None, ["value"], "event_id").drop("event_type"))


def choice_sql(c: str) -> str:
    return f"(SELECT CASE WHEN abs(skewness({c})) <= 1 THEN avg({c}) ELSE quantile_cont({c}, 0.5) END FROM t)"


def mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("smart_impute", with_table("lineitem_gaps", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(coalesce(l_discount, {choice_sql('l_discount')}), 4) AS l_discount,
       round(coalesce(l_tax, {choice_sql('l_tax')}), 4) AS l_tax, coalesce(l_returnflag, {mode_sql('l_returnflag')}) AS l_returnflag FROM t"""))
def _(spark, d):
    out = clean.smart_impute(frame(spark, d, "lineitem_gaps"))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag"))


@query("junk_to_null", with_table("orders_text", f"""
SELECT o_orderkey, CASE WHEN lower(trim(o_orderpriority)) NOT IN ({JUNK}) THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN lower(trim(count_text)) NOT IN ({JUNK}) THEN count_text END AS count_text FROM t"""))
def _(spark, d):
    out = clean.junk_to_null(frame(spark, d, "orders_text"), ["o_orderpriority", "count_text"])
    return out.select("o_orderkey", "o_orderpriority", "count_text")


@query("coerce_numeric_text", with_table("orders_text", f"""
SELECT o_orderkey, o_orderpriority, CASE WHEN {is_number('count_text')} THEN CAST(count_text AS DOUBLE) END AS count_text FROM t"""))
def _(spark, d):
    out = clean.coerce_numeric_text(frame(spark, d, "orders_text"))
    return out.select("o_orderkey", "o_orderpriority", "count_text")


@query("fill_columns", with_table("lineitem_gaps", f"""
SELECT l_orderkey, round(coalesce(l_discount, (SELECT avg(l_discount) FROM t)), 4) AS l_discount,
       round(coalesce(l_tax, {mode_sql('l_tax')}), 4) AS l_tax, coalesce(l_returnflag, 'none given') AS l_returnflag FROM t"""))
def _(spark, d):
    out = clean.fill_columns(frame(spark, d, "lineitem_gaps"), {
        "l_discount": "mean", "l_tax": "mode", "l_returnflag": "custom:none given", "l_linestatus": "leave blank"})
    return rounded(out.select("l_orderkey", "l_discount", "l_tax", "l_returnflag"))


# -- types ----------------------------------------------------------------------

@query("enforce_dtypes", with_table("orders_text", """
SELECT o_orderkey, qty_text, CAST(level AS BIGINT) AS level, CAST(flag AS STRING) AS flag FROM t"""))
def _(spark, d):
    out = clean.enforce_dtypes(frame(spark, d, "orders_text"), {"qty_text": "bigint", "level": "bigint", "flag": "string"})
    return out.select("o_orderkey", "qty_text", "level", "flag")


@query("cast_report", with_table("orders_text", """
SELECT 'qty_text' AS column_name, count(*) FILTER (try_cast(qty_text AS BIGINT) IS NULL) AS failures, failures = 0 AS adopted FROM t
UNION ALL SELECT 'level', count(*) FILTER (try_cast(level AS BIGINT) IS NULL) AS f, f = 0 FROM t"""))
def _(spark, d):
    out = clean.cast_report(frame(spark, d, "orders_text"), {"qty_text": "bigint", "level": "bigint"})
    return out.withColumnRenamed("column", "column_name")


@query("fix_numeric_strings", with_table("orders_text", """
SELECT o_orderkey, CAST(replace(total_text, '$', '') AS DOUBLE) AS total_text, qty_text, CAST(level AS DOUBLE) AS level, active FROM t"""))
def _(spark, d):
    out = clean.fix_numeric_strings(frame(spark, d, "orders_text"))
    return rounded(out.select("o_orderkey", "total_text", "qty_text", "level", "active"))


@query("fix_date_formats", with_table("orders_dates", f"SELECT o_orderkey, {stamp(parsed_date('order_date'))} AS order_date FROM t"))
def _(spark, d):
    return rounded(clean.fix_date_formats(frame(spark, d, "orders_dates")))


@query("convert_booleans", with_table("orders_text", "SELECT o_orderkey, lower(active) IN ('yes') AS active, level FROM t"))
def _(spark, d):
    return clean.convert_booleans(frame(spark, d, "orders_text")).select("o_orderkey", "active", "level")


# -- text -----------------------------------------------------------------------

SPACES = r"regexp_replace(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g')"


def standard_sql(c: str) -> str:
    plain = rf"regexp_replace(regexp_replace({SPACES.format(c=c)}, '<[^>]+>', '', 'g'), '[''\";\\]', '', 'g')"
    return f"upper(left({plain}, 1)) || lower(substring({plain}, 2))"


@query("standardize_strings", with_table("customer_messy", f"""
SELECT c_custkey, {standard_sql('c_name')} AS c_name, {standard_sql('note')} AS note FROM t"""))
def _(spark, d):
    return clean.standardize_strings(frame(spark, d, "customer_messy")).select("c_custkey", "c_name", "note")


@query("text_lower", "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def _(spark, d):
    return clean.normalize_text_case(frame(spark, d, "customer"), case="lower").select("c_custkey", "c_name", "c_mktsegment")


@query("text_upper", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def _(spark, d):
    return clean.normalize_text_case(frame(spark, d, "part"), ["p_name"], "upper").select("p_partkey", "p_name")


@query("text_title", """
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '(\\p{L}+|[^\\p{L}]+)'),
  lambda x: upper(left(x, 1)) || lower(substring(x, 2))), '') AS p_name FROM part""")
def _(spark, d):
    return clean.normalize_text_case(frame(spark, d, "part"), ["p_name"], "title").select("p_partkey", "p_name")


@query("strip_html_tags", r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages")
def _(spark, d):
    out = clean.strip_html_tags(frame(spark, d, "pages"), ["html"])
    return out.select("page_id", F.md5("html").alias("digest"))


@query("remove_special_characters", r"SELECT page_id, trim(regexp_replace(url, '[^a-zA-Z0-9\s]', '', 'g')) AS url FROM pages")
def _(spark, d):
    return clean.remove_special_characters(frame(spark, d, "pages"), ["url"]).select("page_id", "url")


@query("cap_string_length", "SELECT doc_id, left(text, 255) AS text FROM documents")
def _(spark, d):
    return clean.cap_string_length(frame(spark, d, "documents"), 255, ["text"]).select("doc_id", "text")


@query("remove_extra_whitespace", rf"SELECT c_custkey, trim(regexp_replace(c_name, '\s+', ' ', 'g')) AS c_name, "
       rf"trim(regexp_replace(note, '\s+', ' ', 'g')) AS note FROM {source('customer_messy')} AS s")
def _(spark, d):
    return clean.remove_extra_whitespace(frame(spark, d, "customer_messy")).select("c_custkey", "c_name", "note")


# -- outliers -------------------------------------------------------------------

@query("outliers_clip_iqr", with_table("events_spikes", """
, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t)
SELECT event_id, round(greatest(least(value, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 4) AS value FROM t, q"""))
def _(spark, d):
    return rounded(clean.handle_outliers(frame(spark, d, "events_spikes"), "iqr", columns=["value"]).select("event_id", "value"))


@query("outliers_clip_zscore", with_table("events_spikes", """
, q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM t)
SELECT event_id, round(greatest(least(value, m + 3 * s), m - 3 * s), 4) AS value FROM t, q"""))
def _(spark, d):
    return rounded(clean.handle_outliers(frame(spark, d, "events_spikes"), "zscore", columns=["value"]).select("event_id", "value"))


@query("outliers_drop", with_table("lineitem_gaps", """
, q AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1, avg(l_discount) AS m2 FROM t),
s AS (SELECT stddev_pop(coalesce(l_discount, m2)) AS s2 FROM t, q)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice, 4) AS l_extendedprice FROM t, q, s
WHERE abs((l_extendedprice - m1) / s1) < 1.5 AND abs((coalesce(l_discount, m2) - m2) / s2) < 1.5"""))
def _(spark, d):
    out = clean.handle_outliers(frame(spark, d, "lineitem_gaps"), "drop", 1.5, ["l_extendedprice", "l_discount"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_extendedprice"))


# -- validation -----------------------------------------------------------------

@query("validate_emails_flag", with_table("customer_messy", f"""
SELECT c_custkey, coalesce({EMAIL_OK.format(c='email')}, false) AS email_valid FROM t"""))
def _(spark, d):
    return validate.validate_emails(frame(spark, d, "customer_messy")).select("c_custkey", "email_valid")


@query("validate_emails_drop", with_table("customer_messy", f"SELECT c_custkey, email FROM t WHERE {EMAIL_OK.format(c='email')}"))
def _(spark, d):
    return validate.validate_emails(frame(spark, d, "customer_messy"), "drop").select("c_custkey", "email")


@query("validate_phones_flag", with_table("customer_messy", f"""
SELECT c_custkey, coalesce({PHONE_OK.format(c='phone')}, false) AS phone_valid FROM t"""))
def _(spark, d):
    return validate.validate_phones(frame(spark, d, "customer_messy")).select("c_custkey", "phone_valid")


@query("validate_phones_drop", with_table("customer_messy", f"SELECT c_custkey, phone FROM t WHERE {PHONE_OK.format(c='phone')}"))
def _(spark, d):
    return validate.validate_phones(frame(spark, d, "customer_messy"), "drop").select("c_custkey", "phone")


@query("validate_ranges", with_table("lineitem_gaps", """
SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_discount, 4) AS l_discount
FROM t WHERE l_quantity < 5 OR l_quantity > 45 OR l_discount < 0.01 OR l_discount > 0.09"""))
def _(spark, d):
    df = frame(spark, d, "lineitem_gaps").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(validate.validate_ranges(df, {"l_quantity": (5, 45), "l_discount": (0.01, 0.09)}))


@query("validate_no_future_dates", with_table("orders_dates", f"""
SELECT o_orderkey, coalesce({parsed_date('order_date')} > TIMESTAMP '{AS_OF}', false) AS order_date_is_future FROM t"""))
def _(spark, d):
    return validate.validate_no_future_dates(frame(spark, d, "orders_dates"), "order_date", AS_OF).select(
        "o_orderkey", "order_date_is_future")


@query("foreign_keys_flag", with_table("orders_broken", """
SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer) AS o_custkey_valid_fk FROM t"""))
def _(spark, d):
    return validate.validate_foreign_keys(frame(spark, d, "orders_broken"), "o_custkey", frame(spark, d, "customer"),
                                          valid_column="c_custkey")


@query("foreign_keys_drop", with_table("orders_broken", "SELECT o_orderkey, o_custkey FROM t WHERE o_custkey IN (SELECT c_custkey FROM customer)"))
def _(spark, d):
    return validate.validate_foreign_keys(frame(spark, d, "orders_broken"), "o_custkey", frame(spark, d, "customer"), "drop", "c_custkey")


@query("referential_integrity", with_table("orders_broken", """
SELECT DISTINCT o_custkey AS missing FROM t WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""))
def _(spark, d):
    return validate.check_referential_integrity(frame(spark, d, "customer"), "c_custkey", frame(spark, d, "orders_broken"), "o_custkey")


@query("flag_test_data", "SELECT doc_id, " + " OR ".join(TEST_ROW.format(c=c) for c in ("text", "lang", "source"))
       + " AS is_test_data FROM documents")
def _(spark, d):
    return validate.flag_test_data(frame(spark, d, "documents")).select("doc_id", "is_test_data")


# -- near-duplicate values ---------------------------------------------------------

def _similar_sql(threshold: float) -> str:
    return f"""
, v AS (SELECT DISTINCT c_mktsegment AS v FROM t),
p AS (SELECT a.v AS value, b.v AS other FROM v a JOIN v b ON a.v <> b.v
      AND 100.0 * (1 - levenshtein(a.v, b.v) / CAST(greatest(length(a.v), length(b.v)) AS DOUBLE)) >= {threshold})"""


@query("fuzzy_match_column", with_table("customer_messy", _similar_sql(70) + """
SELECT 'c_mktsegment' AS column_name, value, count(*) AS matches, min(other) AS first_match, max(other) AS last_match FROM p GROUP BY 2"""))
def _(spark, d):
    return similarity.similar_values(frame(spark, d, "customer_messy"), "c_mktsegment", 70).withColumnRenamed("column", "column_name")


FIXES_SQL = _similar_sql(70) + """
, f AS (SELECT c_mktsegment AS v, count(*) AS n FROM t GROUP BY 1),
m AS (SELECT p.value, arg_max(p.other, o.n) AS replacement, max(o.n) AS best FROM p JOIN f o ON o.v = p.other GROUP BY 1)"""


@query("typo_corrections", with_table("customer_messy", FIXES_SQL + """
SELECT 'c_mktsegment' AS column_name, m.value, m.replacement, f.n AS freq FROM m JOIN f ON f.v = m.value WHERE f.n < 0.8 * m.best"""))
def _(spark, d):
    return similarity.typo_corrections(frame(spark, d, "customer_messy"), ["c_mktsegment"], 70).withColumnRenamed("column", "column_name")


@query("fix_typos", with_table("customer_messy", FIXES_SQL + """
SELECT c_custkey, coalesce(CASE WHEN f.n < 0.8 * m.best THEN m.replacement END, c_mktsegment) AS c_mktsegment
FROM t LEFT JOIN m ON m.value = c_mktsegment LEFT JOIN f ON f.v = c_mktsegment"""))
def _(spark, d):
    return similarity.fix_typos(frame(spark, d, "customer_messy"), ["c_mktsegment"], 70).select("c_custkey", "c_mktsegment")


@query("fix_typos_names", with_table("orders_names", """
, f AS (SELECT c_name AS v, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT a.v AS value, b.v AS other, b.n FROM f a JOIN f b ON a.v <> b.v
      AND 100.0 * (1 - levenshtein(a.v, b.v) / CAST(greatest(length(a.v), length(b.v)) AS DOUBLE)) >= 94),
m AS (SELECT value, arg_max(other, n) AS replacement, max(n) AS best FROM p GROUP BY 1)
SELECT o_orderkey, coalesce(CASE WHEN f.n < 0.8 * m.best THEN m.replacement END, c_name) AS c_name
FROM t LEFT JOIN m ON m.value = c_name LEFT JOIN f ON f.v = c_name"""))
def _(spark, d):
    return similarity.fix_typos(frame(spark, d, "orders_names"), ["c_name"])


# -- privacy ----------------------------------------------------------------------

@query("mask_pii", with_table("customer_messy", f"SELECT c_custkey, {MASK_SQL.format(c='email')} AS email, {MASK_SQL.format(c='phone')} AS phone FROM t"))
def _(spark, d):
    return privacy.mask_pii(frame(spark, d, "customer_messy"), ["email", "phone"]).select("c_custkey", "email", "phone")


@query("hash_sha256", "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def _(spark, d):
    return privacy.hash_column(frame(spark, d, "customer"), "c_name").select("c_custkey", "c_name")


@query("hash_md5", "SELECT c_custkey, md5(c_name) AS c_name FROM customer")
def _(spark, d):
    return privacy.hash_column(frame(spark, d, "customer"), "c_name", "md5").select("c_custkey", "c_name")


@query("protect_resolved_columns", f"SELECT c_custkey, sha256({MASK_SQL.format(c='c_name')}) AS c_name, "
       f"{MASK_SQL.format(c='c_mktsegment')} AS c_mktsegment FROM customer")
def _(spark, d):
    df = frame(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return privacy.protect(df, mask=["C Name", "c_mktsegment"], hash=["C-Name"])


# -- plans ------------------------------------------------------------------------

PLAN = ["duplicates", "nulls", "string_quality", "sparse_columns", "email_format", "test_data", "typos"]


@query("apply_plan", with_table("customer_messy", f"""
, f AS (SELECT c_custkey, coalesce(c_name, {mode_sql('c_name')}) AS c_name, c_mktsegment, coalesce(email, {mode_sql('email')}) AS email,
        coalesce(phone, {mode_sql('phone')}) AS phone, note FROM t),
s AS (SELECT c_custkey, {', '.join(f'{standard_sql(c)} AS {c}' for c in ('c_name', 'c_mktsegment', 'email', 'phone', 'note'))} FROM f)
SELECT *, {EMAIL_OK.format(c='email')} AS email_valid, {' OR '.join(TEST_ROW.format(c=c) for c in ('c_name', 'email', 'phone', 'note'))} AS is_test_data
FROM s"""))
def _(spark, d):
    df = frame(spark, d, "customer_messy").drop("c_nationkey", "c_acctbal")
    return workflow.apply_plan(df, PLAN, order_by="c_custkey").table


# All fixes in the order in which they are applied; the log names the text columns of more than 50 values that no spelling is merged in.
@query("operations_log", with_table("customer_messy", """
, fixes(rank, step, fix) AS (VALUES (1, 'duplicates', 'remove_duplicates'), (2, 'empty_rows', 'drop_empty_rows'), (3, 'nulls', 'smart_impute'),
  (4, 'outliers', 'handle_outliers'), (5, 'column_names', 'clean_column_names'), (6, 'string_quality', 'standardize_strings'),
  (7, 'date_formats', 'fix_date_formats'), (8, 'data_types', 'fix_numeric_strings'), (9, 'sparse_columns', 'drop_sparse_columns'),
  (10, 'constant_columns', 'drop_constant_columns'), (11, 'high_correlation', 'drop_highly_correlated'), (12, 'email_format', 'validate_emails'),
  (13, 'phone_format', 'validate_phones'), (14, 'test_data', 'flag_test_data'), (15, 'typos', 'auto_fix_typos')),
wide AS (SELECT string_agg(c, ', ' ORDER BY p) AS names FROM (""" + union(
    f"SELECT '{c}' AS c, {i} AS p, count(DISTINCT {c}) AS n FROM t" for i, c in enumerate(("c_name", "c_mktsegment", "email", "phone", "note"))) + """) WHERE n > 50)
SELECT row_number() OVER (ORDER BY rank) - 1 AS position, step, fix, 'applied' AS status,
       CASE WHEN step = 'typos' THEN 'skipped columns of more than 50 values: ' || names END AS skipped
FROM fixes, wide WHERE step IN (""" + ", ".join(f"'{s}'" for s in PLAN) + ")"))
def _(spark, d):
    log = workflow.apply_plan(frame(spark, d, "customer_messy"), PLAN, order_by="c_custkey").operations
    return log.select("position", "step", "fix", "status", F.when(F.col("step") == "typos", F.col("detail")).alias("skipped"))


@query("skipped_fix", """
SELECT count(*) AS rows, max(o_orderkey) AS last_key, 'column_names failed, email_format applied' AS log FROM orders""")
def _(spark, d):
    df = frame(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("Lead Time"), F.col("o_custkey").alias("lead-time"))
    done = workflow.apply_plan(df, ["column_names", "date_formats", "email_format"])
    log = done.operations.where("step <> 'date_formats'").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "step", "status"))), ", ").alias("log"), F.lit(1).alias("one"))
    kept = done.table.agg(F.count(F.lit(1)).alias("rows"), F.max("o_orderkey").alias("last_key"), F.lit(1).alias("one"))
    return kept.join(log, "one").drop("one")


@query("month_first_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS order_date FROM orders""")
def _(spark, d):
    df = frame(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_date"))
    return rounded(clean.fix_date_formats(df))


@query("guided_clean", with_table("orders_text", f"""
, j AS (SELECT o_orderkey, CASE WHEN lower(trim(o_orderpriority)) NOT IN ({JUNK}) THEN o_orderpriority END AS o_orderpriority,
        CASE WHEN {is_number('count_text')} THEN CAST(count_text AS DOUBLE) END AS count_text FROM t)
SELECT o_orderkey, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority,
       round(coalesce(count_text, (SELECT avg(count_text) FROM j)), 4) AS count_text FROM j"""))
def _(spark, d):
    df = frame(spark, d, "orders_text").select("o_orderkey", "o_orderpriority", "count_text")
    cleaned = workflow.guided_clean(df, ["duplicates", "nulls"], junk_columns=["o_orderpriority", "count_text"],
                                    fills={"o_orderpriority": "unknown_label", "count_text": "mean"}, order_by="o_orderkey")
    return rounded(cleaned.table)


@query("diff_report", f"""
SELECT CAST(a.n - b.n AS BIGINT) AS rows_removed, CAST(0 AS BIGINT) AS cols_removed, CAST(0 AS BIGINT) AS nulls_fixed,
       CAST(a.dups AS BIGINT) AS duplicates_removed FROM
 (SELECT sum(n) AS n, sum(n - 1) AS dups FROM (SELECT count(*) AS n FROM {source('orders_twice')} AS s GROUP BY {ORDER_KEYS}, o_orderdate)) a,
 (SELECT count(*) AS n FROM (SELECT DISTINCT {ORDER_KEYS} FROM {source('orders_twice')} AS s)) b""")
def _(spark, d):
    df = frame(spark, d, "orders_twice")
    after = clean.remove_duplicates(df, order_by="o_orderdate")
    return workflow.diff(df, after).select("rows_removed", "cols_removed", "nulls_fixed", "duplicates_removed")


@query("rescore", with_table("lineitem_gaps", """
, kept AS (SELECT count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (l_shipdate) FROM t))
SELECT (SELECT count(*) FROM t) AS rows_before, (SELECT n FROM kept) AS rows_after, CAST(0 AS BIGINT) AS nulls_after,
       CAST(0 AS BIGINT) AS duplicates_after, (SELECT CAST(""" + " + ".join(f"(count(*) - count({c}))" for c in columns_of("lineitem_gaps"))
       + """ AS BIGINT) FROM t) AS nulls_before, true AS better"""))
def _(spark, d):
    report = workflow.audit_and_clean(frame(spark, d, "lineitem_gaps"), "auto_all", order_by="l_orderkey", as_of=AS_OF)
    return report.summary.select("rows_before", "rows_after", "nulls_after", "duplicates_after", "nulls_before",
                                 (F.col("health_after") > F.col("health_before")).alias("better"))
