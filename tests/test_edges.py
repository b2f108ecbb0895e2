"""Ordinary tables that once lost data, stopped an audit or were read only in part."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, clean, prep, profile, score, similarity, validate
from plumbline.operators.quantiles import grouped_quantiles, quantiles
from plumbline.plans import workflow
from plumbline.sources import files

CELLS = ["  padded ", "", None, 'a "quoted", cell', "two\nlines", "\t", "back\\slash", "NA", "None", ","]


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl", "parquet"])
def test_what_is_saved_is_read(spark, tmp_path, kind):
    df = spark.createDataFrame([(i, c, float(i) / 3) for i, c in enumerate(CELLS)] + [(99, None, None)], "i long, s string, d double").repartition(3)
    path = files.save(df, str(tmp_path / f"t.{kind}"))
    options = {"na_values": ()} if kind == "csv" else {}
    assert sorted(files.read_table(spark, path, df.schema, **options).collect()) == sorted(df.collect())
    assert files.read_table(spark, path).count() == len(CELLS) + 1


def test_json_layouts(spark, tmp_path):
    for label, content in {"array": '\n [{"i": 1},\n {"i": 2}]', "lines": '{"i": 1}\n{"i": 2}\n', "pretty": '{\n "i": 1\n}'}.items():
        (tmp_path / f"{label}.json").write_text(content)
        assert files.read_table(spark, str(tmp_path / f"{label}.json")).count() == (1 if label == "pretty" else 2)


def test_missing_markers_and_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,s,b,when,t\n1,N/A,true,2024-01-02,"a"\nNA, x ,null,NaN,""\n3,None,FALSE,2024-01-03,nan\n')
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "s": "string", "b": "boolean", "when": "timestamp_ntz", "t": "string"}
    assert [tuple(r)[:3] for r in df.collect()] == [(1, None, True), (None, " x ", None), (3, None, False)]
    assert [r.t for r in df.collect()] == ["a", "", None]
    assert files.read_table(spark, str(tmp_path / "t.csv"), na_values=["3"]).first().s == "N/A"


def test_numbers_named_like_dates(spark):
    df = spark.createDataFrame([(1, 0.5, 2020, "2024-01-02"), (2, 0.1, 2021, "soon")], "lead_time int, sentiment_score double, year int, ship_date string")
    found = {(r["column"], r["metric"]) for r in score.audit(df).findings.where("check = 'date_formats' AND value > 0").collect()}
    assert found == {("ship_date", "unparseable")}
    done = workflow.apply_plan(df, ["date_formats"])
    assert dict(done.table.dtypes)["lead_time"] == "int" and dict(done.table.dtypes)["ship_date"] == "timestamp_ntz"
    assert {r["status"] for r in done.operations.collect()} == {"applied"}
    offered = [r["feature"] for r in prep.suggest_features(df).where("kind = 'date'").collect()]
    assert offered and all(f.startswith("ship_date") for f in offered)
    prep.add_features(df, offered).collect()
    assert prep.add_datetime_features(df, "year").first()["year_month"] is None
    assert validate.validate_no_future_dates(df, "year").first()["year_is_future"] is False


def test_one_order_of_day_and_month_per_column(spark):
    df = spark.createDataFrame([("03/04/2020", "03/04/2020", "2020/05/06"), ("03/25/2020", "25/03/2020", "06/05/2020")], "a_date string, b_date string, c_date string")
    rows = clean.fix_date_formats(df).collect()
    assert [str(r.a_date)[:10] for r in rows] == ["2020-03-04", "2020-03-25"]
    assert [str(r.b_date)[:10] for r in rows] == ["2020-04-03", "2020-03-25"]
    assert [str(r.c_date)[:10] for r in rows] == ["2020-05-06", "2020-05-06"]


def test_a_failing_fix_is_skipped(spark):
    df = spark.createDataFrame([(1, 2, "x@y.z"), (1, 2, "bad")], "`a b` int, `a-b` int, email string")
    done = workflow.apply_plan(df, ["column_names", "email_format"])
    assert [(r["step"], r["status"]) for r in done.operations.collect()] == [("column_names", "failed"), ("email_format", "applied")]
    assert "email_valid" in done.table.columns


def test_nothing_to_work_on(spark):
    texts = spark.createDataFrame([("a",)], "s string")
    assert profile.outlier_table(texts).collect() == []
    assert clean.cast_report(texts, {"other": "int"}).collect() == [] and clean.enforce_dtypes(texts, {"other": "int"}).columns == ["s"]
    empty = spark.createDataFrame([], "v double, g string")
    assert profile.density(empty, "v", by="g").collect() == []
    maps = spark.createDataFrame([(1, 1.0, {"a": 1}), (2, None, {"b": 2})], "i int, v double, m map<string,int>")
    assert sorted(r.v for r in clean.handle_nulls(maps, "ffill", order_by="i").collect()) == [1.0, 1.0]


def test_wide_tables_are_described_whole(spark):
    df = spark.range(20).select(*[(F.col("id") * k).cast("string" if k % 2 else "double").alias(f"c{k}") for k in range(40)])
    assert profile.column_stats(df).count() == 40
    described = profile.dataset_profile(df)
    assert described.where("section = 'nulls'").count() == 40
    assert described.where("section = 'cardinality'").count() == 20
    assert described.where("section = 'samples'").select("column").distinct().count() == 20
    letters = spark.range(30).select(*[F.chr(F.col("id") % 3 + 97).alias(f"t{k}") for k in range(6)])
    assert prep.suggest_features(letters).where("kind = 'category'").count() == 12


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_all_spellings_are_compared(spark):
    rng = random.Random(4)
    values = set()
    while len(values) < 500:
        base = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 14)))
        at = rng.randrange(len(base))
        values |= {base, base[:at] + rng.choice("xyz") + base[at + 1:]} if rng.random() < 0.3 else {base}
    values = sorted(values)[:500]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    want = [(a, b) for i, a in enumerate(values) for b in values[i + 1:]
            if abs(len(a) - len(b)) <= 2 and 100 * (1 - distance(a, b) / max(len(a), len(b))) >= 85]
    assert want and sorted((r.value_a, r.value_b) for r in similarity.typo_pairs(df, threshold=85).collect()) == sorted(want)
    found = {r["metric"]: r["value"] for r in checks.check_typos(df).collect()}
    assert found == {"similar_pairs": len(want), "similar_values": len({v for p in want for v in p})}
    skipped = checks.check_typos(df, limit=200).collect()
    assert [(r["column"], r["metric"]) for r in skipped] == [("s", checks.SKIPPED)]
    summary = score.audit(df).summary.where("check = 'typos'").first()
    assert not summary["found"] and summary["total"] == 0


def test_long_values_are_compared(spark):
    rng = random.Random(6)
    values = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(5000)) for _ in range(199)]
    values.append(values[0][:100] + "#" + values[0][101:])
    start = time.perf_counter()
    got = similarity.typo_pairs(spark.createDataFrame([(v,) for v in values], "s string")).collect()
    assert [{r.value_a, r.value_b} for r in got] == [{values[0], values[-1]}]
    assert time.perf_counter() - start < 120


def test_quantiles_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.when(F.col("id") % 20 > 0, "b")).alias("g"),
                                  F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("double").alias("v"), F.lit(None).cast("double").alias("none"))
    got = {r.g: (r.q0, r.q1) for r in grouped_quantiles(df, ["g"], "v", [0.5, 0.9]).collect()}
    pdf = df.toPandas()
    for g, rows in pdf.assign(g=pdf.g.fillna("null")).groupby("g"):
        assert got[None if g == "null" else g] == pytest.approx(rows.v.quantile([0.5, 0.9]).tolist())
    assert quantiles(df, ["v", "none"], [0.5]) == {"v": [pytest.approx(pdf.v.median())], "none": [None]}


def test_duplicates_without_an_order_leave_a_trail(spark):
    rows = [(1, "2024-01-01", "a"), (1, "2024-01-02", "a"), (1, "2024-01-02", "a"), (2, "2024-01-01", "b")]
    df = spark.createDataFrame(rows, "k int, t string, v string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    kept = clean.remove_duplicates(df).collect()
    trail = clean.duplicate_trail(df).collect()
    assert sorted((r.k, str(r.t)[:10]) for r in kept) == [(1, "2024-01-01"), (2, "2024-01-01")]
    assert sorted((r.k, str(r.t)[:10]) for r in trail) == [(1, "2024-01-02"), (1, "2024-01-02")]


def test_report_matches_the_tables(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, None if i % 9 == 0 else "x" * (i % 4), float(i % 5)) for i in range(100)], "a int, b string, c double")
    report = workflow.audit_and_clean(df)
    one = workflow.diff(df, report.table).first()
    got = report.summary.first()
    assert {c: got[c] for c in one.asDict()} == one.asDict()
    written = workflow.write_report(report, str(tmp_path / "out.parquet"))
    assert {"findings_after", "errors", "dropped_duplicates"} <= set(written)
    assert files.read_json(spark, written["dropped_duplicates"], report.trail.schema).count() == one["rows_removed"]
