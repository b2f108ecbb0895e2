"""Repeated passages against all strings of the length, counted."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import catalog, suffix_dedup


def plain(texts, length):
    """Per text the covered spans."""
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = set()
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                cover.update(range(i, i + length))
        spans, last = [], None
        for b in sorted(cover):
            if b != last:
                spans.append([b, b + 1])
            spans[-1][1] = last = b + 1
        out.append([tuple(s) for s in spans])
    return out


def passages(seed, n, letters=2, size=60):
    """Texts sewn from shared passages, runs of one letter and noise."""
    rng = random.Random(seed)

    def noise(k):
        return bytes(97 + rng.randrange(letters) for _ in range(k))

    shared = [noise(rng.randrange(1, size)) for _ in range(max(1, n // 4))]
    texts = []
    for _ in range(n):
        parts = [rng.choice([noise(rng.randrange(9)), rng.choice(shared), b"z" * rng.randrange(1, 30), rng.choice(shared)[rng.randrange(9):]])
                 for _ in range(rng.randrange(6))]
        texts.append(b"".join(parts))
    return texts + texts[:2]


@pytest.mark.parametrize("seed", range(30))
def test_orders(seed):
    rng = random.Random(seed)
    base = [bytes(rng.randrange(2) for _ in range(rng.randrange(200))) for _ in range(4)]
    strings = list({rng.choice(base)[:rng.randrange(200)] + bytes(rng.randrange(3) for _ in range(rng.randrange(4))) for _ in range(80)})
    expected = sorted(range(len(strings)), key=lambda i: strings[i])
    assert suffix_dedup.blind_trie_order(strings, list(range(len(strings)))) == expected
    assert suffix_dedup.deep_shallow_order(strings, rng.randrange(1, 80)) == expected
    for a in strings[:20]:
        for b in strings[:20]:
            k = suffix_dedup.common_prefix(a, b)
            assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])


@pytest.mark.parametrize("length", [1, 2, 5, 10, 17, 40])
def test_every_string_has_a_place(length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PLACES", 37)
    texts = passages(length, 20)
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    place = {}
    for at, low, high in zip(*(x.tolist() for x in suffix_dedup.sampled(data, bounds, length))):
        for p in range(low, high + 1):
            assert p not in place
            place[p] = at - p
    offsets = {}
    for b, e in zip(bounds, bounds[1:]):
        for p in range(b, e - length + 1):
            assert 0 <= place[p] < suffix_dedup.sample_of(length)
            assert offsets.setdefault(bytes(data[p:p + length]), place[p]) == place[p]
    assert len(place) == sum(max(0, len(t) - length + 1) for t in texts)


@pytest.mark.parametrize("seed", range(40))
def test_reaches(seed):
    rng = random.Random(seed)
    n, length = rng.randrange(1, 40), 10
    kinds = list({(bytes(rng.randrange(2) for _ in range(rng.randrange(8))), b"x" * 3 + bytes(rng.randrange(2) for _ in range(rng.randrange(8)))) for _ in range(n)})
    pasts, futures = map(list, zip(*kinds))
    copies = [rng.choice([1, 1, 1, 2]) for _ in kinds]
    expected = []
    for i, (p, f) in enumerate(kinds):
        pairs = [(suffix_dedup.common_prefix(p, q), suffix_dedup.common_prefix(f, g)) for j, (q, g) in enumerate(kinds) if i != j]
        pairs = [(a, b) for a, b in pairs if a + b >= length] + [(len(p), len(f))] * (copies[i] > 1)
        expected.append((max(a for a, _ in pairs), max(b for _, b in pairs)) if pairs else None)
    assert suffix_dedup.reaches(pasts, futures, copies, length) == expected


def spans(rows):
    return {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in rows}


@pytest.mark.parametrize("length,large", [(5, 2000), (12, 2000), (12, 3), (33, 2), (80, 1), (150, 2)])
def test_against_all_strings(spark, length, large):
    texts = [t.decode() for t in passages(length, 120, 2, 200)]
    texts += ["", "é" * 90, "xé" * 70, "yé" * 70, "a" * 3000, "b" * 500, "cd" * 400]
    df = spark.createDataFrame([(i, t, b"k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key binary, owner int").repartition(5)
    got = suffix_dedup.repeated_passages(df, length, large=large).collect()
    raw = [t.encode() for t in texts]
    expected = plain(raw, length)
    assert spans(got) == dict(enumerate(expected))
    assert any(expected)
    for r in got:
        t, gone = raw[r["doc_id"]], {i for b, e in expected[r["doc_id"]] for i in range(b, e)}
        assert r["n_bytes"] == len(t) and r["text_sha256"] == hashlib.sha256(t).hexdigest()
        assert (t if r["kept"] is None else bytes(r["kept"])) == bytes(c for i, c in enumerate(t) if i not in gone)


def test_hot_passage(spark):
    """One passage in every text, always between other words: its suffixes are one unit far beyond the size of a task."""
    rng = random.Random(1)
    common, almost = ("".join(rng.choice("abcd") for _ in range(n)) for n in (60, 39))
    texts = ["".join(rng.choice("ab") for _ in range(80)) + (common if i % 2 else almost) + "".join(rng.choice("cd") for _ in range(80)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans(suffix_dedup.repeated_passages(df, 40, large=20).collect())
    assert got == dict(enumerate(plain([t.encode() for t in texts], 40)))


@pytest.mark.parametrize("fold", [20_000, 60])
def test_hot_passage_is_one_run(spark, fold, monkeypatch):
    """A passage in every text comes back as one row a text, however many suffixes lie in it."""
    monkeypatch.setattr(suffix_dedup, "FOLD", fold, raising=False)
    rng = random.Random(3)
    common = "".join(rng.choice("abcd") for _ in range(600))
    texts = ["".join(rng.choice("ab") for _ in range(80)) + common + "".join(rng.choice("cd") for _ in range(80)) for _ in range(100)]
    texts += ["".join(rng.choice("abcd") for _ in range(300)), common[:200] + "ab" * 30 + common[300:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    table = suffix_dedup._texts(df, "text", 40)
    wanted = table.selectExpr("owner", "explode(keys) AS key")
    runs = suffix_dedup._reached_large(table, wanted, 40, 20).collect()
    raw = [t.encode() for t in texts]
    owner = {hashlib.sha256(t).digest()[:16]: i for i, t in enumerate(raw)}
    assert sorted((owner[bytes(r["owner"])], r["begin"], r["end"]) for r in runs) == [
        (i, b, e) for i, found in enumerate(plain(raw, 40)) for b, e in found]


def test_odd_rows(spark):
    long = "some words that are long enough " * 20
    df = spark.createDataFrame([(1, None), (2, ""), (None, long), (3, long), (3, long), (4, "short")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], len(r["spans"]), r["kept"]) for r in suffix_dedup.repeated_passages(df, 400).collect()), key=str)
    n = len(long)
    assert got == [(0, n, 1, b""), (1, 0, 0, None), (2, 0, 0, None), (3, n, 1, b""), (3, n, 1, b""), (4, 5, 0, None)]
    assert suffix_dedup.repeated_passages(df.limit(0), 400).collect() == []


def test_long_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    df = spark.createDataFrame([(1, text), (2, text[1000:1500] + "!" + text[200_000:200_399])], "doc_id long, text string")
    assert spans(suffix_dedup.repeated_passages(df, 400).collect()) == {1: [(1000, 1500)], 2: [(0, 500)]}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    raw = [(r["text"] or "").encode() for r in rows]
    got = {r["doc_id"]: r for r in catalog.QUERIES["op13_suffix_dedup"](spark, sf).collect()}
    for r, t, found in zip(rows, raw, plain(raw, 400)):
        gone = {i for b, e in found for i in range(b, e)}
        kept = hashlib.sha256(bytes(c for i, c in enumerate(t) if i not in gone)).hexdigest()
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(t), len(gone), len(found), kept)
