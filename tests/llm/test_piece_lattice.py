"""Ids against the library, unigram paths against all paths, and round trips."""

import hashlib
import random
from functools import cache

import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm import catalog, piece_lattice
from plumbline.llm.piece_lattice import PieceModel, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = PieceModel.load(PATH)
SPACE = "▁"
TEXTS = ["", " ", "   ", "hello  world", "  a b ", "a\nb\n\n c", "x\xa0y", "tab\there 12,345.67", "ﬁ Å é 漢字 テスト 🙂", "a" * 200,
         "deadbeef" * 40 + " internationalization", f"raw{SPACE}mark {SPACE}", "don't (see [x]), \"q\"...", "The quick Brown fox", "\x00\x1f", "ab" * 70 + "  c"]


@pytest.mark.parametrize("folded", [64, 3])
def test_ids(spark, folded, monkeypatch):
    monkeypatch.setattr(piece_lattice, "FOLDED", folded)
    rng = random.Random(folded)
    texts = TEXTS + ["".join(rng.choice(["the", "in", "g", " ", "  ", "er", "Zé", "漢", ",", "\n", "0", "tion"]) for _ in range(30)) for _ in range(40)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "null id", "y"), (7, None, "z"), (7, None, "z")]
    found = decode(encode(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3), MODEL), MODEL).collect()
    assert len(found) == len(rows)
    want = sorted((-1 if i is None else i, LIBRARY.encode(t or "")) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in found) == want
    for r in found:
        if r.doc_id is not None and r.ids:
            assert r.text == texts[r.doc_id].replace(SPACE, " ")
    assert encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_words_travel_in_buckets(spark, monkeypatch):
    """A block sends its words in a row for each bucket, not in a row for each word; many blocks and buckets give the same ids."""
    monkeypatch.setattr(piece_lattice, "BLOCK_TEXT", 4_000)
    monkeypatch.setattr(piece_lattice, "BUCKET_TEXT", 3_000)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeé漢z") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = piece_lattice._blocks(docs, MODEL, 7).collect()
    blocks, lists = [r for r in rows if r.codes is not None], [r for r in rows if r.bucket is not None]
    assert len(blocks) > 8 and {r.block for r in blocks} == {r.block for r in lists}
    assert len(lists) == len({(r.block, r.bucket) for r in lists}) <= 7 * len(blocks)
    assert {r.bucket for r in lists} == set(range(7))
    assert {r.doc_id: r.ids for r in encode(docs, MODEL).collect()} == {k: LIBRARY.encode(t) for k, t in enumerate(texts)}


def test_many_groups_in_a_bucket(spark):
    """More distinct words than one group folds, all in one bucket, with words beyond the fold among them."""
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.choice([3, 6, 9, 90]))) for _ in range(3 * piece_lattice.GROUP_WORDS)]
    docs = spark.createDataFrame([(k, " ".join(words[k::5])) for k in range(5)], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in encode(docs, MODEL).collect()} == {k: LIBRARY.encode(" ".join(words[k::5])) for k in range(5)}


def best_path(word, scores, unknown):
    @cache
    def best(a):
        if a == len(word):
            return 0.0, ()
        ways = []
        for b in range(a + 1, len(word) + 1):
            if word[a:b] in scores or b == a + 1:
                cost, rest = best(b)
                ways.append((cost - scores.get(word[a:b], unknown), (word[a:b], *rest)))
        return min(ways)
    return best(0)


@pytest.mark.parametrize("folded", [64, 2])
def test_unigram(spark, folded, monkeypatch):
    """The best sum of scores over all ways to cut a word; scores are such that no two ways tie."""
    monkeypatch.setattr(piece_lattice, "FOLDED", folded)
    rng = random.Random(5)
    names = [SPACE, "a", "b", "c", "ab", "bc", "abc", "ca", SPACE + "a", SPACE + "ab", "cab"]
    pieces = tuple((p, 256 + k, -rng.uniform(1, 9)) for k, p in enumerate(names))
    texts = tuple(bytes([b]) for b in range(256)) + tuple(p.replace(SPACE, " ").encode() for p in names)
    model = PieceModel(pieces, "unigram", 0, texts)
    scores = {p: s for p, _, s in pieces}
    rows = [(k, " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(3))) for k in range(40)]
    got = {r.doc_id: r for r in decode(encode(spark.createDataFrame(rows, "doc_id long, text string"), model), model).collect()}
    ids = {p: i for p, i, _ in pieces}
    for k, text in rows:
        _, path = best_path(SPACE + text.replace(" ", SPACE), scores, min(scores.values()) - piece_lattice.UNKNOWN_PENALTY)
        assert got[k].ids == [i for p in path for i in ([ids[p]] if p in ids else p.encode())]
        assert got[k].text == text


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.QUERIES["op4_sentencepiece"](spark, sf).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: LIBRARY.encode(t) for k, t in texts.items()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_ids == len(r.ids) for r in rows)
