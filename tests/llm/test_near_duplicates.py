"""SimHash, its trie join and the components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash
from plumbline.llm.common import components
from plumbline.llm.exact_dedup import drop_exact_copies, exact_groups


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, held = [], ""
    for c in lowered:
        if c in " \t\n\x0b\x0c\r":
            words, held = words + [held] * bool(held), ""
        else:
            held += c
    words += [held] * bool(held)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def smallest_reachable(links, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "A b C", "Éa\x85b \xa0 c d e\x1cf g", "x y z " * 50, "a b c d e f g h i"])
def test_fingerprint(text, monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 5)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    values = {0, 2**64 - 1, 2**63}
    while len(values) < n:
        v = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    return sorted(values)


@pytest.mark.parametrize("budget", [0, 1, 3, 4])
@pytest.mark.parametrize("n,target,full", [(1, 10, 100), (400, 1000, 10000), (400, 20, 10000), (400, 20, 60), (300, 1, 4)])
def test_links(spark, budget, n, target, full, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    values = clustered(n + budget, n)
    if budget == 4 and full < 100:
        pytest.skip("covered by smaller budgets")
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "value long"), "value", budget, target, full).collect()
    found = smallest_reachable([(r.value % 2**64, r.root % 2**64) for r in links], values)
    bits = np.array(values, "u8")
    near = [(values[i], values[j]) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= budget).tolist() if j > i]
    assert found == smallest_reachable(near, values)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(300, j) for j in range(301, 420)] + [(500, 500), (None, 3), (700, 701), (701, 700)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == smallest_reachable(linked, {x for e in linked for x in e})
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


BASE = " ".join(f"word{i}" for i in range(400))
ROWS = [(7, BASE, 1), (3, BASE + " more", 2), (9, BASE, 3), (None, BASE, 4), (5, None, 5), (6, "", 6), (8, "  ", 7),
        (2, "something else entirely here", 8), (2, "something else entirely here", 8), (None, "unlike any other text", 9), (1, "x", 10)]


def test_near_duplicates(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, component_id int").repartition(3)
    got = simhash.near_duplicates(docs, carry=["text", "component_id"]).collect()
    prints = {r.payload["text"]: r.fingerprint % 2**64 for r in got}
    assert prints == {t: plain_fingerprint(t) for _, t, _ in ROWS}
    firsts = smallest_reachable([(a, b) for a in prints.values() for b in prints.values() if (a ^ b).bit_count() <= 3], prints.values())
    members = defaultdict(list)
    for i, t, _ in ROWS:
        members[firsts[prints[t]]].append(i)
    for r in got:
        ids = [i for i in members[firsts[r.fingerprint % 2**64]] if i is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(min([i for i in m if i is not None], default=0) for m in members.values())
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_exact_groups(spark):
    long_text = "é" * 20_000
    rows = [(1, "a", 0), (2, "a", 0), (2, "a", 0), (None, "a", 0), (None, "n", 1), (None, "n", 1), (4, None, 2), (3, "", 2),
            (10, long_text, 3), (11, long_text + "x", 3), (12, long_text, 3), (13, "x" * 32, 4), (14, "x" * 32, 4), (15, "x" * 33, 4),
            (16, "y" * 288, 5), (17, "y" * 288, 5), (18, "y" * 287, 5), (19, "é", 6), (20, "é", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digit int").repartition(4)
    got = exact_groups(docs, carry=["text"]).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    kept = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        t = r.payload["text"] or ""
        best = max([i for i in groups[t] if i is not None], default=None)
        assert (r.keep_id, r.group_size) == (best, len(groups[t]))
        assert not r.kept or r.doc_id == best
        kept[t] += r.kept
    assert set(kept.values()) == {1}
    assert drop_exact_copies(docs).columns == docs.columns and drop_exact_copies(docs).count() == len(groups)
    assert exact_groups(docs.limit(0)).collect() == []
