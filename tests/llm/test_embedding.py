"""Vector links against all pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import catalog, embedding
from test_near_duplicates import smallest_reachable

SF = "/root/testdata/sf0.01"


def all_pairs(rows, threshold):
    """Links and components by comparing every two rows of a label."""
    good, links = defaultdict(list), []
    for k, (_, label, v) in enumerate(rows):
        if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float64) / max(map(abs, v))
            good[label, len(v)].append((k, x / np.linalg.norm(x)))
    for members in good.values():
        x = np.array([v for _, v in members])
        links += [(members[i][0], members[j][0]) for i, j in np.argwhere(x @ x.T >= threshold).tolist() if i < j]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    first = smallest_reachable(links, range(len(rows)))
    members = defaultdict(list)
    for k, r in first.items():
        members[r].append(rows[k][0])
    least = {r: min([i for i in m if i is not None], default=None) for r, m in members.items()}
    return sorted(((i, degree[k], least[first[k]], i == least[first[k]]) for k, (i, _, _) in enumerate(rows)), key=repr)


def got(frame, **options):
    return sorted(map(tuple, embedding.near_duplicate_vectors(frame, **options).collect()), key=repr)


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 25), dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.3])
        rows.append((int(i * 7 % n), int(rng.integers(3)) if i % 17 else None, [float(np.float32(c)) for c in v]))
    return rows


@pytest.mark.parametrize("dim,block", [(64, 4000), (64, 15), (40, 4000)])
def test_links(spark, dim, block):
    rows = clustered(dim, 500, dim)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    assert got(frame, block=block) == all_pairs(rows, 0.98)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "b", [1.0, 0.0]), (4, "a", None), (5, "a", []), (6, "a", [0.0, 0.0]),
            (7, "a", [nan, 1.0]), (8, "a", [inf, 1.0]), (9, "a", [None, 1.0]), (10, None, [1.0, 0.0]), (None, "a", [1.0, 0.0]),
            (11, "a", [1.0]), (12, "a", [3.0]), (13, "a", [-1.0]), (14, "a", [1e300, 1e290]), (15, "a", [1.0, 0.0]), (15, "a", [1.0, 0.0]),
            (None, "c", [1.0, 2.0]), (16, "a", [0.0, 1.0, 0.0]), (17, "a", [0.0, 1.0, 0.1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label string, embedding array<double>, class int")
    want = all_pairs(rows, 0.98)
    assert got(frame) == want
    assert got(frame.limit(0)) == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert sorted(map(tuple, catalog.QUERIES["op10_embedding"](spark, SF).collect()), key=repr) == all_pairs(rows, 0.98)


def test_recall_at_the_threshold(spark):
    """Each vector of the table with partners at cosines just above the threshold, the hardest to meet."""
    rng, rows = np.random.default_rng(1), []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect():
        x = np.array(r.embedding, np.float64) / np.linalg.norm(r.embedding)
        rows.append((r.vec_id, r.label, x.tolist()))
        for k, cosine in enumerate((0.9801, 0.981, 0.99), 1):
            z = rng.normal(size=len(x))
            z -= (z @ x) * x
            rows.append((r.vec_id + k * 10**6, r.label, (cosine * x + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)).tolist()))
    want = {r[0]: r for r in all_pairs(rows, 0.98)}
    found = {r[0]: r for r in got(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))}
    total = sum(w[1] for w in want.values())
    assert 0.995 * total <= sum(f[1] for f in found.values()) <= total
    assert all(found[k][1] <= w[1] for k, w in want.items())
