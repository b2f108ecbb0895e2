"""Distributed algorithms against brute force, with skewed and tied data."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, clean, correlation, metrics, ordering, prep, similarity
from plumbline.operators.quantiles import grouped_quantiles, quantiles

RNG = np.random.default_rng(7)


def skewed(n=3000):
    """A third of the rows in one group, a third of the values equal, some gaps."""
    g = np.where(RNG.random(n) < 0.35, "hot", RNG.choice(list("abcdefgh"), n))
    v = np.where(RNG.random(n) < 0.33, 5.0, np.round(RNG.normal(0, 50, n), 3))
    v = np.where(RNG.random(n) < 0.1, np.nan, v)
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": np.round(v * 2 + RNG.normal(0, 40, n), 1)})


def spark_frame(spark, pdf):
    from plumbline.functions.columns import normalise
    return normalise(spark.createDataFrame(pdf)).repartition(6)


def test_quantiles_are_exact(spark):
    pdf = skewed()
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(spark_frame(spark, pdf), ["v", "w"], probs)
    for c in ("v", "w"):
        assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist(), abs=1e-9)


def test_grouped_quantiles(spark):
    pdf = skewed()
    got = grouped_quantiles(spark_frame(spark, pdf), ["g"], "w", [0.25, 0.5, 0.9]).toPandas().set_index("g")
    want = pdf.groupby("g")["w"].quantile([0.25, 0.5, 0.9]).unstack()
    assert sorted(got.index) == sorted(want.index)
    for g in want.index:
        assert got.loc[g].tolist() == pytest.approx(want.loc[g].tolist(), abs=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_global_index_is_dense_and_ordered(spark):
    pdf = skewed()
    got = ordering.global_index(spark_frame(spark, pdf), [F.col("v"), F.col("id")]).toPandas().sort_values("row_index")
    want = pdf.sort_values(["v", "id"], na_position="first")
    assert got["row_index"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == want["id"].tolist()


def test_copies_do_not_share_a_slice(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit("same").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is tiny
    try:
        slices = ordering._sliced(df, "k").groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in slices]
    assert sum(sizes) == 20_000 and max(sizes) < 15_000


@pytest.mark.parametrize("strategy", ["ffill", "bfill", "interpolate"])
def test_ordered_fills_match_pandas(spark, strategy):
    pdf = skewed(2000)
    pdf.loc[:4, "v"] = np.nan
    pdf.loc[1990:, "v"] = np.nan
    pdf.loc[500:900, "v"] = np.nan  # longer than a slice
    got = clean.handle_nulls(spark_frame(spark, pdf[["id", "v"]]), strategy, columns=["v"], order_by="id")
    got = got.toPandas().sort_values("id")["v"].to_numpy(dtype=float)
    want = {"ffill": pdf["v"].ffill(), "bfill": pdf["v"].bfill(),
            "interpolate": pdf["v"].interpolate(limit_direction="both")}[strategy].to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_ordered_fills_need_an_order(spark):
    with pytest.raises(ValueError):
        clean.handle_nulls(spark.range(3).withColumn("v", F.lit(None).cast("double")), "ffill", columns=["v"], order_by=[])


def test_average_ranks(spark):
    pdf = skewed()
    got = ordering.average_ranks(spark_frame(spark, pdf), ["v", "w"]).toPandas()
    for c in ("v", "w"):
        want = pd.DataFrame({"v": pdf[c], "r": pdf[c].rank()}).dropna().drop_duplicates().sort_values("v")
        assert got[got.column == c].sort_values("value")["rank"].tolist() == want["r"].tolist()


def test_pearson_and_spearman_match_pandas(spark):
    pdf = skewed(800).drop(columns=["g"])
    pdf["flat"] = 3.0
    df = spark_frame(spark, pdf)
    for method in ("pearson", "spearman"):
        want = pdf.corr(method=method)
        for r in correlation.correlation_pairs(df, method=method).collect():
            w = want.loc[r["col_a"], r["col_b"]]
            assert r["r"] is None if np.isnan(w) else r["r"] == pytest.approx(w, abs=1e-9)


def test_kendall_matches_brute_force(spark):
    pdf = skewed(150)[["v", "w"]].round(-1)
    points = pdf.dropna().to_numpy()
    c = d = tx = ty = 0
    for (a, b), (p, q) in itertools.combinations(points, 2):
        s = np.sign(a - p) * np.sign(b - q)
        c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (a == p), ty + (b == q)
    n0 = len(points) * (len(points) - 1) / 2
    want = (c - d) / np.sqrt((n0 - tx) * (n0 - ty))
    assert correlation.kendall_pairs(spark_frame(spark, pdf)).first()["r"] == pytest.approx(want, abs=1e-12)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("prefix", ["", "Item#00"])
@pytest.mark.parametrize("threshold", [50, 85, 90, 94])
def test_similar_pairs_miss_nothing(spark, threshold, prefix):
    words = set()
    while len(words) < 60:
        base = "".join(RNG.choice(list("abc"), RNG.integers(1, 24)))
        words.add(base)
        for _ in range(3):
            t = list(base)
            for _ in range(RNG.integers(1, 4)):
                i = RNG.integers(0, len(t) + 1)
                t[i:i + RNG.integers(0, 2)] = RNG.choice(list("abcd"), RNG.integers(0, 2)).tolist()
            words.add("".join(t))
    words = sorted(prefix + w for w in words)
    df = spark.createDataFrame([("c", w) for w in words], "column string, value string")
    got = {(r["value_a"], r["value_b"]) for r in similarity.similar_pairs(df, threshold).collect()}
    want = {(a, b) for a, b in itertools.combinations(words, 2)
            if 100 * (1 - lev(a, b) / max(len(a), len(b))) >= threshold - 1e-9}
    assert got == want


@pytest.mark.parametrize("threshold, shared, edits", [(40, 3, 8), (80, 1, 8), (80, 2, 1), (94, 1, 8)])
def test_similar_pairs_of_shared_segments(spark, monkeypatch, threshold, shared, edits):
    """Values made of few letters around one name: nearly every segment is shared, at several levels."""
    monkeypatch.setattr(similarity, "SHARED", shared)
    monkeypatch.setattr(similarity, "ENOUGH", 50 * shared)
    monkeypatch.setattr(similarity, "SEGMENT_EDITS", edits)
    rng = np.random.default_rng(threshold + shared)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(0, 3))) + rng.choice(["", "CommonName#"]) + "".join(rng.choice(list("01"), rng.integers(1, 9)))
                    for _ in range(90)})
    df = spark.createDataFrame([(c, w) for c in "cd" for w in words[::1 if c == "c" else 2]], "column string, value string")
    got = sorted((r["column"], r["value_a"], r["value_b"]) for r in similarity.similar_pairs(df, threshold).collect())
    want = sorted((c, a, b) for c, some in (("c", words), ("d", words[::2])) for a, b in itertools.combinations(some, 2)
                  if 100 * (1 - lev(a, b) / max(len(a), len(b))) >= threshold - 1e-9)
    assert got == want and want


def test_candidates_do_not_grow_with_the_names(spark):
    """Joined rows per name stay as they are while the names become forty times as many."""
    rows = {}
    for n in (1_500, 60_000):
        names = spark.range(1, n + 1).select(F.lit("c").alias("column"), F.format_string("Customer#%09d", "id").alias("value"))
        rows[n] = similarity.candidates(similarity.named_values(names, 94), 94).count() / n
    assert rows[60_000] <= 2 * rows[1_500] and rows[60_000] < 250


def test_typos_merge_into_the_frequent_spelling(spark):
    values = ["Alexandria"] * 20 + ["Alexandrja"] * 2 + ["Montevideo"] * 10 + ["Montevidea"] * 9 + ["Cairo"] * 5 + ["Cairo 2"] * 1
    df = spark.createDataFrame([(v,) for v in values], "city string")
    out = similarity.fix_typos(df, threshold=85).groupBy("city").count().toPandas().set_index("city")["count"].to_dict()
    assert out == {"Alexandria": 22, "Montevideo": 10, "Montevidea": 9, "Cairo": 5, "Cairo 2": 1}


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_duplicates_with_a_hot_group(spark, keep):
    pdf = skewed().assign(k=lambda d: d["g"], x=lambda d: d["v"].fillna(-1) > 0)
    got = clean.remove_duplicates(spark_frame(spark, pdf), ["k", "x"], keep, "id").toPandas()
    want = pdf.drop_duplicates(["k", "x"], keep=keep)
    assert sorted(got["id"]) == sorted(want["id"])


def test_duplicate_trail(spark):
    pdf = skewed()
    got = clean.dropped_duplicates(spark_frame(spark, pdf[["id", "g", "v"]]), "id", ["g", "v"]).toPandas()
    want = pdf[pdf.duplicated(["g", "v"])]
    assert sorted(got["id"]) == sorted(want["id"])


def test_label_codes(spark):
    pdf = skewed()
    got = prep.encode_categoricals(spark_frame(spark, pdf[["id", "g"]]), "label").toPandas().sort_values("id")
    assert got["g"].tolist() == pd.Categorical(pdf["g"]).codes.tolist()


def plain_corrections(values, threshold, ratio):
    """Most frequent first, one value after the other."""
    counts = {v: values.count(v) for v in values}
    near = {v: {w for w in counts if w != v and 100 * (1 - lev(v, w) / max(len(v), len(w))) >= threshold - 1e-9} for v in counts}

    def commonest(members):
        return sorted(members, key=lambda v: (-counts[v], v))

    replaced = {}
    for v in commonest(counts):
        if v not in replaced and near[v]:
            best, second, *_ = group = commonest(near[v] | {v})
            if counts[second] / counts[best] < ratio:
                replaced.update(dict.fromkeys(group[1:], best))
    return {(v, best, counts[v]) for v, best in replaced.items()}


@pytest.mark.parametrize("letters, ratio", [("ab", 0.8), ("abc", 0.8), ("abc", 0.4), ("abcd", 1.01)])
def test_typo_corrections_go_most_frequent_first(spark, letters, ratio, monkeypatch):
    rng = np.random.default_rng(len(letters))
    words = ["".join(rng.choice(list(letters), rng.integers(3, 7))) for _ in range(60)]
    values = [w for w in words for _ in range(int(rng.choice([1, 1, 1, 2, 3, 5, 9, 30])))]
    df = spark.createDataFrame([(i, v, "x", None) for i, v in enumerate(values)] + [(-1, None, None, None)], "id long, `a.b` string, _value string, e string")
    want = plain_corrections(values, 75, ratio)
    assert want
    sent = []
    frame = type(df)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (sent.append(out := collect(self)), out)[1])
    found = similarity.typo_corrections(df, threshold=75, ratio=ratio)
    fixed_rows = similarity.fix_typos(df, threshold=75, ratio=ratio)
    assert sum(map(len, sent)) <= 10  # a row per column, whatever the number of values
    assert {tuple(r) for r in collect(found)} == {("a.b", *w) for w in want}
    to = {v: best for v, best, _ in want}
    assert fixed_rows.columns == df.columns
    assert sorted(map(tuple, collect(fixed_rows))) == sorted([(i, to.get(v, v), "x", None) for i, v in enumerate(values)] + [(-1, None, None, None)], key=lambda r: r[0])


def test_duplicate_counts_compare_rows_only_where_hashes_agree(spark):
    nan = float("nan")
    rows = [(None, 5, 0.0, "x" * 31, [1]), (5, None, 0.0, "x" * 32, [1]), (5, None, 1.0, "x" * 40, None), (None, None, nan, None, [None])]
    df = spark.createDataFrame(rows, "a int, b int, c double, d string, e array<int>")
    plan = checks.duplicate_counts(df)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert tuple(plan.first()) == (4, 0)
    again = df.union(spark.createDataFrame([(None, 5, -0.0, "x" * 31, [1]), (None, None, nan, None, [None]), (5, None, 1.0, "x" * 39, None)], df.schema))
    assert tuple(checks.duplicate_counts(again).first()) == (7, 2)
    assert tuple(checks.duplicate_counts(df.limit(0)).first()) == (0, 0)


def test_text_measures_of_values_are_those_of_cells(spark):
    texts = ["Ab", "ab", "AB", " ab ", "a  b", "12", "$3", "no", "yes", "N/A", "<b>", "2020-01-02", "it's", "", None]
    df = spark.createDataFrame([(texts[i * i % 15], None, texts[i % 4]) for i in range(300)], "s string, none string, t string")
    cells = metrics.text_profile(df).orderBy("position").collect()
    for few in ({"s": 15, "none": 0, "t": 4}, {"s": 15}, {}):
        assert metrics.text_profile(df, estimates=few).orderBy("position").collect() == cells
