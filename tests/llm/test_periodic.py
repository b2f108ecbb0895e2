"""Periodic runs against a plain search over all lags."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import catalog, periodic


def plain_runs(words):
    """All runs by definition: maximal stretches of each lag whose smallest period is the lag."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def strings(seed, n, letters):
    """Random letters with powers of random pieces, also nested and beside one another."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        piece = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 9, 12, 16, 17, 20, 33]))]
        if rng.random() < 0.3:
            piece = piece * rng.randint(2, 6) + piece[:rng.randrange(len(piece) + 1)]
        times = rng.choice([1, 1, 3, 4, 5])
        out += (piece * times)[:len(piece) * times - rng.randrange(len(piece))]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs(seed):
    words = strings(seed, 40 + 10 * seed, 2 + seed % 5)
    expected = plain_runs(words)
    for short in (1, 2, 8):
        assert list(map(tuple, periodic.find_runs(np.array(words), short=short).tolist())) == expected


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 100, 257])
@pytest.mark.parametrize("extra", [-1, 0, 1])
def test_bounds(period, extra):
    rng = random.Random(period)
    piece = [rng.randrange(10**6) for _ in range(period)]
    length = max(6, 4 * period) + extra
    words = [-5, *(piece * 7)[:length], -6]
    expected = [(1, length, period)] if extra >= 0 else []
    assert periodic.find_runs(np.array(words)).tolist() == [list(r) for r in expected]


def told(rows):
    return {r["doc_id"]: (tuple(tuple(x) for x in r["runs"]), r["best"] and tuple(r["best"]), r["collapsed"], r["n_words"]) for r in rows}


def test_batch_of_texts(spark):
    texts = {i: " \n\t\x0b"[i % 4].join(f"w{c}" for c in strings(i, 5 * i, 3)) + " " * (i % 3) for i in range(60)}
    texts |= {100: None, 101: "", 102: " \n", 103: "\x0c a  a\ta a a a ", 104: "é\x85é " * 9, 105: "w1 w2 " * 40_000, 106: "x" * 200_000}
    df = spark.createDataFrame([("a", 1, i, t, "b", 2) for i, t in texts.items()], "n_words string, runs int, doc_id long, text string, best string, collapsed int")
    got = told(periodic.periodic_runs(df.repartition(3)).collect())
    for i, text in texts.items():
        words = plain_words(text)
        runs = plain_runs(words) if i != 105 else [(0, 80_000, 2)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert got[i] == (tuple(runs), best, " ".join(w for k, w in enumerate(words) if k not in gone), len(words)), i


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 5), (1, "a b " * 5), (None, "c")], "doc_id long, text string")
    got = periodic.periodic_runs(df).collect()
    assert sorted((r["doc_id"] or 0, r["collapsed"]) for r in got) == [(0, "c"), (1, "a b"), (1, "a b")]


def test_no_rows(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randrange(160)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " \t", "one", "é ü " * 30])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
           for r in catalog.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == {i: plain_row(planted(i, plain_words(t))) for i, t in rows}
    assert sum(r[0] > 0 for r in got.values()) >= 15


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 6000).select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) for r in catalog.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    for r in rows:
        whole = plain_row(planted(r["doc_id"], plain_words(r["text"])))
        assert got[r["doc_id"]] == (whole[0], whole[5], whole[6])
