"""Semantics of checks and fixes on small handmade frames."""

import pytest
from pyspark.sql import functions as F

from plumbline import audit, audit_and_clean, run
from plumbline.functions import text
from plumbline.functions.columns import normalise
from plumbline.operators import checks, clean, prep, privacy, profile, score, sqltypes, validate
from plumbline.plans import workflow
from plumbline.session import materialize, shared_folder
from plumbline.sources import files
from plumbline.streaming.rowlocal import clean_stream


def metrics(df):
    return {(r["column"], r["metric"]): r["value"] for r in df.collect()}


def column(df, c):
    return [r[c] for r in df.select(c).collect()]


def strings(spark, values, c="c"):
    return spark.createDataFrame([(v,) for v in values], f"`{c}` string")


def test_null_dates_are_not_unparseable(spark):
    df = strings(spark, ["2020-01-05", None, "soon", "31/12/2030", "13/13/2020", "5 Mar"], "signup_date")
    assert metrics(checks.check_date_formats(df, "2021-01-01")) == {
        ("signup_date", "unparseable"): 3.0, ("signup_date", "future_dates"): 1.0}


def test_three_values_are_no_boolean(spark):
    df = spark.createDataFrame([("1", "yes", True), ("2", "NO", False), ("0", "no", True)], "a string, b string, c boolean")
    found = metrics(checks.check_data_types(df))
    assert found == {("a", "numeric_as_text"): 1.0, ("b", "boolean_as_other"): 1.0, ("c", "boolean_as_other"): 1.0}


def test_digits_raise_no_casing_issue(spark):
    assert metrics(checks.check_string_quality(strings(spark, [str(i) for i in range(30)]))) == {}
    mixed = ["abc", "ABC", "Abc"] * 10
    assert metrics(checks.check_string_quality(strings(spark, mixed))) == {("c", "inconsistent_casing"): 1.0}


def test_junk_words_need_boundaries(spark):
    df = strings(spark, ["nullable", "1234567", "a Test row", "n/a", "x 123 y", None, "tést", "étest"])
    assert metrics(checks.check_test_data(df))[(None, "count")] == 3
    assert column(validate.flag_test_data(df), "is_test_data") == [False, False, True, True, True, False, False, False]


def test_nulls_survive_text_fixes(spark):
    df = strings(spark, [None, "  it's  <b>BIG</b>\t "])
    assert column(clean.standardize_strings(df), "c") == [None, "Its big"]
    assert column(clean.strip_html_tags(df), "c") == [None, "it's  BIG"]
    assert column(clean.remove_extra_whitespace(df), "c") == [None, "it's <b>BIG</b>"]


def test_text_fixes_are_idempotent(spark):
    df = strings(spark, ["  it's  <b>BIG</b>\t ", "a b", "<<x>y>", ""])
    for fix in (clean.strip_html_tags, clean.remove_special_characters, clean.cap_string_length, clean.remove_extra_whitespace):
        once = fix(df)
        assert column(fix(once), "c") == column(once, "c")


def test_title_case_restarts_after_non_letters(spark):
    df = strings(spark, ["o'hara foo-bar 3rd ÉTÉ"])
    assert column(clean.normalize_text_case(df, case="title"), "c") == ["O'Hara Foo-Bar 3Rd Été"]
    assert column(df.select(text.is_title(text.title(F.col("c"))).alias("c")), "c") == [True]


def test_numbers_are_parsed_like_a_careful_reader(spark):
    df = strings(spark, [" 12 ", "1e3", "12d", "nan", "", "-.5", "1.", "0x1", "inf"])
    assert column(df.select(text.parse_number(F.col("c")).alias("c")), "c") == [
        12.0, 1000.0, None, None, None, -0.5, 1.0, None, float("inf")]


def test_currency_columns_become_numbers_only_when_most_rows_parse(spark):
    df = spark.createDataFrame([("$1,234.50", "a")] * 9 + [("x", "1")], "p string, q string")
    out = clean.fix_numeric_strings(df)
    assert dict(out.dtypes) == {"p": "double", "q": "string"}
    assert column(out, "p") == [1234.5] * 9 + [None]
    nulls = spark.createDataFrame([("1",)] * 8 + [(None,)] * 2, "p string")
    assert dict(clean.fix_numeric_strings(nulls).dtypes) == {"p": "string"}


def test_drop_outliers_uses_one_mask(spark):
    rows = [(float(i % 5), float(i % 7)) for i in range(60)] + [(1000.0, 1.0), (1.0, -900.0), (None, 2.0)]
    out = clean.handle_outliers(spark.createDataFrame(rows, "a double, b double"), "drop")
    assert out.count() == 61
    flat = spark.createDataFrame([(1.0,)] * 5, "a double")
    assert clean.handle_outliers(flat, "drop").count() == 5


def test_nan_is_a_gap(spark):
    df = normalise(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double"))
    assert metrics(checks.check_nulls(df))[("v", "null_count")] == 2


def test_mode_takes_the_lowest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert sorted(column(clean.smart_impute(df), "c")) == ["a", "a", "a", "b", "b"]
    empty = spark.createDataFrame([(None,), (None,)], "c string")
    assert column(clean.smart_impute(empty), "c") == ["Unknown", "Unknown"]


def test_integer_mean_fill_keeps_the_fraction(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert sorted(column(clean.handle_nulls(df, "mean"), "v")) == [1.0, 1.5, 2.0]


def test_keep_first_without_an_order(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    assert column(clean.remove_duplicates(df, ["k"]), "v") == ["a"]
    assert column(clean.remove_duplicates(df, ["k"], "last", "v"), "v") == ["b"]


def test_nested_values_are_compared(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), ([2],), (None,), (None,)], "a array<int>")
    assert metrics(checks.check_duplicates(df))[(None, "count")] == 2
    assert audit(df).rows == 5


def test_long_text_is_compared_whole(spark):
    base = "x" * 5000
    df = strings(spark, [base + "a", base + "b", base + "a"])
    assert metrics(checks.check_duplicates(df))[(None, "count")] == 1


def test_column_name_rules(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`First Name` int, Age int, a_b int, aB int")
    assert {c for c, _ in metrics(checks.check_column_names(df))} == {"First Name", "Age"}
    assert clean.clean_column_names(df.select("First Name", "Age")).columns == ["first_name", "age"]
    with pytest.raises(ValueError):
        clean.clean_column_names(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_masks_and_hashes(spark):
    df = strings(spark, ["secret@x.org", "abcd", "", None])
    assert column(privacy.mask_pii(df, ["c"]), "c") == ["se********rg", "****", "", None]
    assert column(privacy.hash_column(df, "c", "md5"), "c")[2:] == ["d41d8cd98f00b204e9800998ecf8427e", None]


def test_split_is_literal_for_one_character(spark):
    df = strings(spark, ["a.b.c", "x"])
    out = clean.split_column(df, "c", ".", ["l", "r"])
    assert column(out, "l") == ["a", "x"] and column(out, "r") == ["b", None]


def test_onehot_refuses_wide_columns(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        prep.encode_categoricals(df, "onehot", limit=200)
    assert len(prep.encode_categoricals(df, "onehot").columns) == 500


def test_filters(spark):
    df = spark.createDataFrame([("10", 1), ("x", 2), (None, 3), ("a.b", 4)], "s string, n int")
    ids = lambda op, v, **k: column(profile.filter_rows(df, "s", op, v, **k), "n")
    assert ids("!=", "x") == [1, 3, 4]
    assert ids(">", "5") == [1]
    assert ids("contains", "A.B") == [4] and ids("contains", "a.", literal=True) == [4]


def test_sql_types_follow_the_data(spark):
    df = spark.createDataFrame([(1, 40000, "x" * 60, "y" * 5000, True)], "id int, n int, s string, t string, b boolean")
    types = {r["column"]: r["sql_type"] for r in sqltypes.sql_types(df, "sqlserver").collect()}
    assert types == {"id": "TINYINT", "n": "INT", "s": "VARCHAR(100)", "t": "NVARCHAR(MAX)", "b": "BIT"}
    assert "id SMALLINT NOT NULL PRIMARY KEY" in sqltypes.create_table(df, "t")


@pytest.mark.parametrize("rows", [[], [(1, "a", None, 2.0)], [(i, None, None, 1.0) for i in range(12)]])
def test_edge_frames_audit_and_clean(spark, rows):
    df = spark.createDataFrame(rows, "k int, s string, e double, f double")
    result = audit(df)
    assert 0 <= result.health_score <= 100 and result.summary.count() == 17
    report = audit_and_clean(df, "auto_all", order_by="k")
    assert report.table.count() <= len(rows)


def test_audit_of_an_empty_table_is_not_alarming(spark):
    summary = {r["check"]: r["severity"] for r in audit(spark.createDataFrame([], "a int, b string")).summary.collect()}
    assert summary["duplicates"] == "OK" and summary["nulls"] == "OK"


def messy(spark):
    rows = [(i, f"  name {i} ", None if i % 9 == 0 else float(i % 13), "bad" if i % 25 == 0 else f"u{i}@x.org") for i in range(200)]
    return spark.createDataFrame(rows + rows[:30], "id int, label string, amount double, email string")


def test_cleaning_improves_the_score(spark):
    report = audit_and_clean(messy(spark), "auto_all", order_by="id")
    row = report.summary.first()
    assert row["rows_removed"] == 30 and row["duplicates_removed"] == 30 and row["nulls_fixed"] > 0
    assert row["health_after"] > row["health_before"]
    steps = [r["step"] for r in report.operations.orderBy("position").collect()]
    assert steps == [s for s in score.fixed.FIX_ORDER if s in steps]


def test_failed_fix_is_logged_and_skipped(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    log = workflow.apply_plan(df, ["column_names"]).operations.first()
    assert log["status"] == "failed"


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'line\nbreak, "quoted" \\ back', None), (2, "", 2.5)], "i int, s string, d double")
    for kind in ("parquet", "jsonl"):
        path = files.save(df, str(tmp_path / f"t.{kind}"))
        assert sorted(files.read_table(spark, path, df.schema).collect()) == sorted(df.collect())
    path = files.save(df, str(tmp_path / "t.csv"))
    back = sorted(files.read_table(spark, path, df.schema).collect())
    assert back[0]["s"] == 'line\nbreak, "quoted" \\ back' and back[1]["d"] == 2.5
    (tmp_path / "a.json").write_text('[{"i": 1}, {"i": 2}]')
    assert files.read_table(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError):
        files.read_table(spark, "t.xyz")


def test_run_writes_table_and_report(spark, tmp_path):
    path = files.save(messy(spark), str(tmp_path / "in.parquet"))
    run(spark, path, str(tmp_path / "out.parquet"), order_by="id")
    assert files.read_parquet(spark, str(tmp_path / "out.parquet")).count() == 200
    assert files.read_json(spark, str(tmp_path / "out_summary.json"), lines=True).first()["rows_removed"] == 30


def test_row_local_fixes_on_a_stream(spark, tmp_path):
    strings(spark, ["  a  b ", "x"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("c string").parquet(str(tmp_path / "in"))
    query = (clean_stream(stream, ["remove_extra_whitespace", "flag_test_data"]).writeStream.format("memory")
             .queryName("cleaned").trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert sorted(column(spark.table("cleaned"), "c")) == ["a b", "x"]


def test_materialized_tables_live_in_the_shared_folder(spark):
    df = materialize(spark.range(10), "ten")
    assert df.count() == 10 and all(shared_folder(spark) in f for f in df.inputFiles())
