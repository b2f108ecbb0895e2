"""Shards and preference pairs against plain loops."""

import random
from collections import defaultdict

import pytest

import oracle
from plumbline.llm import catalog, sharding
from plumbline.llm.preference import format_pairs

SMALL = "/root/testdata/sf0.001"


def plain_shards(rows, shards):
    """Sizes in key order cut into equal shares."""
    total, at, out = sum(s for _, s in rows), 0, defaultdict(list)
    for key, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out[min(shards - 1, at * shards // max(total, 1))].append(key)
        at += size
    return out


@pytest.mark.parametrize("seed,n,range_rows", [(1, 0, 10), (2, 1, 10), (3, 3, 1), (4, 500, 20), (5, 800, 5), (6, 300, 1000)])
def test_shards(spark, seed, n, range_rows, monkeypatch):
    if seed == 5:
        monkeypatch.setattr(sharding, "DRAWN", 1)  # a poor draw leaves overfull ranges
    rng = random.Random(seed)
    rows = [(k, 5000 if rng.random() < 0.02 else rng.randint(1, 9)) for k in rng.sample(range(10 * n + 1), n)]
    frame = spark.createDataFrame([(k, s, k) for k, s in rows], "key long, size long, slot long").repartition(4)
    got = sharding.shard(frame, 4, "key", "size", range_rows).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append((r.slot, r.key))
    assert all([slot for slot, _ in sorted(v)] == list(range(len(v))) for v in by.values())
    assert {k: [key for _, key in sorted(v)] for k, v in by.items()} == plain_shards(rows, 4)


def test_hot_and_null_keys(spark):
    rows = [(7, 3)] * 200 + [(None, 3)] * 100 + [(i, None) for i in range(5)] + [(9, -4)]
    got = sharding.shard(spark.createDataFrame(rows, "key long, size int"), 3, "key", "size", 10).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += max(r["size"] or 0, 0)
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and sizes == {0: 300, 1: 300, 2: 300}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    nothing = sharding.shard(spark.createDataFrame([(i, 0) for i in range(6)], "key long, size int"), 3, "key", "size").collect()
    assert sorted(r.shard for r in nothing) == [0, 0, 1, 1, 2, 2]


def test_shard_query(spark, tmp_path):
    import zlib
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = catalog.QUERIES["op5_sharding"](spark, SMALL)
    rows = got.collect()
    want = plain_shards([(k, len(t.encode()) + 1) for k, t in texts.items()], 16)
    for r in rows:
        assert want[r.shard][r.slot] == r.doc_id
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
    assert len(rows) == len(texts)
    path = sharding.write_shards(got, str(tmp_path / "shards"), 4)
    assert spark.read.parquet(path).count() == len(texts)


def plain_pairs(rows, chunk):
    sides = defaultdict(lambda: {"chosen": [], "rejected": []})
    for pair, side, turn, role, text in rows:
        if pair is not None and side in ("chosen", "rejected"):
            sides[pair][side].append((turn, role or "", text or ""))
    out = {}
    for pair, both in sides.items():
        a, b = ([t[1:] for t in sorted(both[s], key=lambda t: (t[0] is not None, t[0] or 0))] for s in ("chosen", "rejected"))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        for k in range(-(-max(len(a), len(b)) // chunk)):
            row = {"prompt": "", "chosen": "", "rejected": "", "chosen_mask": [], "rejected_mask": []}
            for part, turns, low in (("prompt", a[:n], 0), ("chosen", a, n), ("rejected", b, n)):
                for i in range(max(low, k * chunk), min(len(turns), (k + 1) * chunk)):
                    role, text = turns[i]
                    row[part] += f"<|im_start|>{role}\n"
                    at = len(row[part])
                    row[part] += f"{text}<|im_end|>\n"
                    if role == "assistant" and part != "prompt":
                        row[f"{part}_mask"].append((at, len(row[part]) - 1))
            out[pair, k] = row
    return out


@pytest.mark.parametrize("chunk", [2, 256])
def test_pairs(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for pair in range(40):
        shared = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "é" * 3, None, "c d"])) for _ in range(rng.randint(0, 4))]
        for side in ("chosen", "rejected")[:rng.choice([1, 2, 2, 2])]:
            tail = [(rng.choice(["user", "assistant"]), rng.choice(["x", "y"])) for _ in range(rng.randint(0, 4))]
            rows += [(pair, side, i * 2 or None, role, text) for i, (role, text) in enumerate(shared + tail)]
    rows += [(None, "chosen", 1, "user", "lost"), (99, "other", 1, "user", "lost")]
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "pair_id long, side string, turn long, role string, text string, pos int, chunk int").repartition(4)
    got = format_pairs(frame, chunk).collect()
    want = plain_pairs(rows, chunk)
    assert {(r.pair_id, r.chunk) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = want[r.pair_id, r.chunk]
        assert [r.prompt, r.chosen, r.rejected] == [w["prompt"], w["chosen"], w["rejected"]]
        assert [[tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]] == [w["chosen_mask"], w["rejected_mask"]]
    assert format_pairs(frame.limit(0)).collect() == []


@pytest.mark.parametrize("label", sorted(catalog.ORACLES))
def test_queries_with_sql(spark, label):
    assert oracle.compare(catalog.QUERIES[label](spark, SMALL), oracle.connect(SMALL), catalog.ORACLES[label]) is None
