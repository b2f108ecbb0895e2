"""Word-wise encoding against the library on whole texts; shards and packing against plain loops."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing, wavelet
from plumbline.llm.tokens import encoder, pieces_of

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "a", "J̌ o", "́x", "don't  it's 3.14 <|endoftext|>x", "\x1cA\x1db\x1e \x85q\xa0r s",
       "ΣΑΣ ΣΑ Σ", "KK Ω", "a\r\n\tb\x0b\x0cc", "的 中文 テスト が゙", "İ İ", "'S 'LL x'Ve", "x" * 500]


def whole(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids + [2]


def encoded(texts):
    ids, bounds = encoder(PATH).encode(pa.array(texts, pa.string()), 2)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_odd_texts():
    assert encoded(ODD) == [whole(t) for t in ODD]
    assert encoded([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n'’sS|<>éÉ̀̌JK1٣"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_any_text(texts):
    assert encoded(texts) == [whole(t) for t in texts]


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr("plumbline.llm.tokens.TEXT_AT_ONCE", 10)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["aaaa", "bbbb", None, "c" * 50, "", "dd"])})
    assert [b["text"].to_pylist() for b in pieces_of(iter([batch]), "text")] == [["aaaa", "bbbb", None], ["c" * 50], ["", "dd"]]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 3), (2000, 40), (3000, 49407), (1500, 300_000)])
def test_wavelet(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype("<u2" if top < 65536 else "<u4")
    bounds = np.array([0, n // 2, n])
    shard = wavelet.Shard.from_bytes(wavelet.Shard(wavelet.WaveletMatrix.of(ids), [7, None], bounds).to_bytes())
    m = shard.matrix
    assert shard.doc_ids == [7, None] and shard.bounds.tolist() == bounds.tolist()
    assert m.tokens().tolist() == ids.tolist()
    for i in rng.integers(0, n, 20) if n else []:
        assert m.access(int(i)) == ids[i]
    for token in {0, 1, top - 1, top + 5, 10**6, *ids[:5].tolist()}:
        at = np.flatnonzero(ids == token).tolist()
        assert m.occurrences(token) == at
        assert m.count(token, n // 3, n // 2) == sum(n // 3 <= i < n // 2 for i in at)
    with pytest.raises(IndexError):
        m.access(n)


ROWS = [(5, "b a b", "x"), (3, None, "y"), (3, "", "y"), (None, "a", "z"), (9, "word " * 3000, "w"), (5, "b a b", "x"), (-2, "one two", "v")]
SCHEMA = "doc_id long, text string, start string"


def test_shards(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = wavelet.write_shards(docs, str(tmp_path / "shards"), PATH, shard_tokens=50)
    got = sorted(map(tuple, wavelet.document_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, -2, 3, 3, 5, 5, 9]
    at = 0
    texts = {(i, len(whole(t or ""))): whole(t or "") for i, t, _ in ROWS}
    for doc_id, start, n, crc in got:
        assert start == at and crc == zlib.crc32(np.array(texts[doc_id, n], "<u4").tobytes())
        at += n
    token = whole("word")[0]
    found = sorted(map(tuple, wavelet.occurrences(spark, path, token).collect()), key=lambda r: r[1])
    assert found == [(9, at - 3001 + i) for i in range(3000)]


def test_shards_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert wavelet.document_digests(spark, wavelet.write_shards(docs, str(tmp_path / "none"), PATH)).collect() == []


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    windows = []
    for length in sorted(lengths, reverse=True):
        fits = [w for w in windows if w >= length]
        room = min(fits) if fits else None
        if room is None:
            windows.append(capacity - length)
        else:
            windows[windows.index(room)] = room - length
    return Counter(windows)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64, 100])
    lengths = [rng.randint(1, capacity) if seed % 2 else min(capacity, int(rng.expovariate(8 / capacity)) + 1) for _ in range(rng.choice([0, 1, 30, 600]))]
    counts = Counter(lengths)
    plan = packing.best_fit_decreasing(counts, capacity)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, window, offset in plan.tolist():
        for i in range(n):
            used[window + i].append((offset, length))
            ranks[length].append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert sorted(used) == list(range(len(used)))
    for placed in used.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(capacity - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, capacity)


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    placed = packing.pack_documents(docs, PATH, capacity=64, with_ids=True)
    rows = placed.collect()
    assert sum(r.length for r in rows) == sum(len(whole(t or "")) for _, t, _ in ROWS)
    assert len(rows) == sum(-(-len(whole(t or "")) // 64) for _, t, _ in ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sorted(by) == list(range(len(by)))
    windows = {r.sequence_id: r for r in packing.sequences(placed, 64, pad_id=0).collect()}
    for k, members in by.items():
        members.sort(key=lambda r: r.offset)
        real = [i for r in members for i in r.ids]
        assert [r.offset for r in members] == np.cumsum([0] + [r.length for r in members])[:-1].tolist()
        size = len(real) if len(real) & (len(real) - 1) == 0 else 64
        assert windows[k].ids == real + [0] * (size - len(real))
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_many_pieces_of_one_length(spark, monkeypatch):
    """Lengths ranked in many buckets: every place is used once and without a gap."""
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    lengths = [5] * 700 + [3] * 300 + [8, 8, 1]
    df = spark.createDataFrame([(i, n, "x", i) for i, n in enumerate(lengths)], "id long, length long, offset string, sequence_id long").repartition(7)
    placed = packing.pack(df, 8).collect()
    assert sorted(r["id"] for r in placed) == list(range(len(lengths)))
    windows = {}
    for r in placed:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 8
    assert len(windows) == 702


def test_known_words_start_anew(spark, monkeypatch):
    """Beyond its bound a worker forgets its words, and the ids stay the same."""
    from plumbline.llm import tokens
    texts = pa.array([" ".join(f"w{c}{d}" for c in "abcdefgh" for d in ("x", "y.", "é", "1")) for _ in range(3)] + ["", "Word WORD word!"])
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = tokens.WordEncoder(path).encode(texts, 2)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 7)
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 5)
    few = tokens.WordEncoder(path).encode(texts, 2)
    assert whole[0].tolist() == few[0].tolist() and whole[1].tolist() == few[1].tolist()
