"""Grouped statistics, samples, encodings and fixes against plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, correlation, prep, profile
from plumbline.operators.ordering import running_counts
from plumbline.operators.quantiles import grouped_quantiles
from plumbline.plans import workflow


def groups(seed, n, k):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, "hot", [f"g{i}" for i in rng.integers(0, k, n)])
    return pd.DataFrame({"g": g, "v": np.where(rng.random(n) < 0.3, 7.0, np.round(rng.normal(0, 30, n), 1))})


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_running_counts_across_slices(spark, slices):
    """Groups larger and smaller than a slice, a null group, one group alone."""
    rows = [(g, v, 1 + (v * 7) % 5) for g, size in ((None, 3), ("a", 1), ("b", 200), ("c", 1), ("d", 40), ("e", 2)) for v in range(size)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        got = running_counts(spark.createDataFrame(rows, "column string, value int, n long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, seen = {}, {}
    for g, v, n in rows:
        want[g, v] = seen.get(g, 0)
        seen[g] = want[g, v] + n
    assert {(r["column"], r["value"]): r["before"] for r in got} == want


def test_median_of_many_groups(spark):
    rows = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("v"))
    pdf = rows.toPandas()
    got = grouped_quantiles(rows, ["g"], "v", [0.5]).toPandas().set_index("g")["q0"].sort_index()
    assert np.allclose(got.to_numpy(), pdf.groupby("g")["v"].median().sort_index().to_numpy())


def test_no_broadcast_follows_the_groups(spark, monkeypatch):
    """What is broadcast has a row a slice, whatever the number of groups."""
    sent = []
    broadcast = F.broadcast
    monkeypatch.setattr("plumbline.operators.ordering.F.broadcast", lambda df: (sent.append(df.count()), broadcast(df))[1])
    rows = spark.range(50_000).select((F.col("id") % 20_000).alias("g"), F.col("id").cast("double").alias("v"))
    assert grouped_quantiles(rows, ["g"], "v", [0.25, 0.5]).count() == 20_000
    assert sent and max(sent) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_box_stats(spark):
    pdf = groups(1, 4000, 6)
    got = profile.box_stats(spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("one", 3.0), ("one", None), (None, 4.0)], "g string, v double")), "v", "g").toPandas().set_index("group")
    assert set(got.index) == {*pdf.g.unique(), "one"} and math.isnan(got.loc["one", "std"])
    for g, v in pdf.groupby("g")["v"]:
        q1, q2, q3 = v.quantile([0.25, 0.5, 0.75])
        inside = v[v.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
        want = [v.min(), inside.min(), q1, q2, q3, inside.max(), v.max(), v.mean(), v.std(), len(v) - len(inside)]
        assert np.allclose(got.loc[g].astype(float), want), g


@pytest.mark.parametrize("by", [None, "g"])
def test_density_is_a_kernel_over_the_bins(spark, by):
    pdf = groups(2, 1500, 2)
    grid = 20
    got = profile.density(spark.createDataFrame(pdf), "v", by, grid).toPandas()
    lo, width = pdf.v.min(), (pdf.v.max() - pdf.v.min()) / grid
    middle = lo + (np.arange(grid) + 0.5) * width
    for g, v in (pdf.groupby("g")["v"] if by else [(None, pdf.v)]):
        counts = np.bincount(np.minimum(((v - lo) / width).astype(int), grid - 1), minlength=grid)
        band = max(1.06 * v.std() * len(v) ** -0.2, width / 2)
        want = [sum(c * math.exp(-((x - m) / band) ** 2 / 2) for c, m in zip(counts, middle)) / (len(v) * band * math.sqrt(2 * math.pi)) for x in middle]
        own = (got[got.group == g] if by else got).sort_values("bin")
        assert own.bin.tolist() == list(range(grid)) and np.abs(own.density - want).max() < 1e-9


def test_points_are_drawn_as_often_as_they_occur(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 2000 + [(float(i), 0.0) for i in range(1000)], "x double, y double")
    shares = [sum(r["y"] == 1.0 for r in profile.scatter_points(df, "x", "y", 300, seed).collect()) for seed in range(4)]
    assert all(150 <= s <= 250 for s in shares)
    assert profile.scatter_points(df, "x", "y", 5000).count() == 3000


def test_sample_values(spark):
    df = spark.range(20_000).select((F.col("id") % 9000).alias("v"))
    some = [r["value"] for r in profile.sample_values(df, "v", 8).collect()]
    assert len(set(some)) == 8 and some == [r["value"] for r in profile.sample_values(df.repartition(3), "v", 8).collect()]
    hashes = sorted((r["h"], r["v"]) for r in df.distinct().select("v", F.xxhash64("v", F.lit(42)).alias("h")).collect())
    assert sorted(some) == sorted(v for _, v in hashes[:8])
    assert profile.sample_values(df.where("v < 3"), "v", 8).count() == 3


def test_copies_of_nested_maps_go(spark):
    rows = spark.range(20).select(F.struct(F.create_map(F.lit("k"), F.col("id") % 2).alias("m")).alias("s"), F.array(F.create_map(F.lit("a"), F.lit(1))).alias("l"))
    assert clean.remove_duplicates(rows).count() == 2
    done = workflow.apply_plan(rows, ["duplicates"])
    assert [r["status"] for r in done.operations.collect()] == ["applied"] and done.table.count() == 2


def test_log_names_the_columns_left_out(spark):
    df = spark.createDataFrame([(f"spelling{i:03}", "x") for i in range(60)], "a string, b string")
    log = workflow.apply_plan(df, ["typos"]).operations.collect()
    assert [(r["status"], r["detail"]) for r in log] == [("applied", "skipped columns of more than 50 values: a")]
    assert workflow.apply_plan(df, ["typos"], typo_limit=None).operations.first()["detail"] == ""


def test_encoding_beside_columns_of_working_names(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q"), (None, 3, "p")], "c string, _key int, _found string")
    for method, want in (("label", [(0, 1, "p"), (1, 2, "q"), (None, 3, "p")]), ("frequency", [(0.5, 1, "p"), (0.5, 2, "q"), (None, 3, "p")])):
        assert sorted(map(tuple, prep.encode_categoricals(df, method, ["c"]).collect()), key=lambda r: r[1]) == want


def test_sparse_one_hot(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["a", "x", "y"])) for i in range(50)]
    encoded, dictionary = prep.sparse_one_hot(spark.createDataFrame(rows, "features int, p string, `q.r` string"), alias="features")
    positions = {(r["column"], r["value"]): r["position"] for r in dictionary.collect()}
    assert positions == {k: i for i, k in enumerate(sorted({("p", p) for _, p, _ in rows if p} | {("q.r", q) for _, _, q in rows}))}
    want = sorted(sorted([positions["p", p]] * bool(p) + [positions["q.r", q]]) if p else [positions["q.r", q]] for _, p, q in rows)
    assert sorted(r["features"] for r in encoded.collect()) == want and encoded.columns == ["features"]


def test_sparse_one_hot_of_many_values(spark):
    df = spark.range(200_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("c"))
    encoded, dictionary = prep.sparse_one_hot(df, ["c"])
    assert dictionary.count() == 200_000 and encoded.agg(F.countDistinct(F.col("features")[0])).first()[0] == 200_000


def test_spearman_exchanges_do_not_grow_with_the_columns(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({f"c{i}": rng.integers(0, 5 + 40 * i, 400) for i in range(7)}).rename(columns={"c6": "_row"})
    df = spark.createDataFrame(pdf)
    plans = [correlation._ranked_rows(df, list(pdf.columns[:k]))._jdf.queryExecution().executedPlan().toString() for k in (3, 7)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") <= 4
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.spearman_pairs(df).collect()}
    want = pdf.corr("spearman")
    assert len(got) == 21 and all(abs(want.loc[a, b] - r) < 1e-9 for (a, b), r in got.items())


def test_spearman_bounds_what_a_task_folds_and_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 3, 400), "b": np.where(rng.random(400) < 0.7, 1, rng.integers(0, 300, 400)), "c": rng.random(400)})
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(correlation, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(correlation, "FREQUENT", 20)
    assert correlation._ranked_rows(df, list(pdf.columns)).rdd.getNumPartitions() == 9
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.spearman_pairs(df).collect()}
    want = pdf.corr("spearman")
    assert len(got) == 3 and all(abs(want.loc[a, b] - r) < 1e-9 for (a, b), r in got.items())
