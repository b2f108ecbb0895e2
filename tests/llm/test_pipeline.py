"""Each stage of the pipeline against a plain loop over what the stage before kept."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import language
from test_near_duplicates import plain_fingerprint, smallest_reachable
from test_secret_scan import plain as plain_secrets
from test_tokens import whole

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, "12 34 %", None, None, None), (None, "And of the thing there.", None, None, None),
       (10_003, "漢字" * 100, None, "s", 200), (10_004, "password=abcdefgh and of the thing", "en", "s", 5),
       (10_005, "password=abcdefgh and of the thing", "en", "s", 5), (10_005, "password=abcdefgh and of the thing", "en", "s", 5)]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What went into and came out of each stage, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, COLUMNS)).repartition(4)
    out, folder = {}, tmp_path_factory.mktemp("stages")
    for k, (label, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF)
        path = str(folder / str(k))
        result.write.parquet(path)
        out[label] = (docs.collect(), spark.read.parquet(path).collect(), docs.columns, result.columns)
        docs = spark.read.parquet(path)
    return out


def rows(found):
    return sorted(map(tuple, found), key=repr)


def test_columns(steps):
    for label, (_, _, before, after) in list(steps.items())[:-1]:
        assert after == before, label


def test_language(steps):
    before, after, *_ = steps["language ID"]
    gone = [r for r in before if not r.text or language.LETTER.search(r.text) is None or r.doc_id == 10_003]
    assert len(gone) == 4
    assert rows(after) == rows([r for r in before if r not in gone])


def test_exact(steps):
    before, after, *_ = steps["exact dedup"]
    best = {}
    for r in before:
        best[r.text] = max(best.get(r.text, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in after) == sorted((i, t) for t, i in best.items())


def test_near(steps):
    before, after, *_ = steps["SimHash near-dedup"]
    prints = {r.text: plain_fingerprint(r.text) for r in before}
    values = sorted(set(prints.values()))
    first = smallest_reachable([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3], values)
    kept = {}
    for r in before:
        i = float("inf") if r.doc_id is None else r.doc_id
        kept[first[prints[r.text]]] = min(kept.get(first[prints[r.text]], float("inf")), i)
    assert sorted(float("inf") if r.doc_id is None else r.doc_id for r in after) == sorted(kept.values())


def test_secrets(steps):
    before, after, *_ = steps["secret scans"]
    want = []
    for r in before:
        merged = []
        for _, a, b in plain_secrets(r.text):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        text = r.text
        for a, b in reversed(merged):
            text = text[:a] + "[SECRET]" + text[b:]
        want.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert rows(after) == rows(want)
    assert any("[SECRET]" in r.text for r in after)


def test_packing(steps):
    before, after, *_ = steps["packing"]
    ids = {r.doc_id: whole(r.text) for r in before}
    pieces, windows = [], {}
    for r in after:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.append((-1 if r.doc_id is None else r.doc_id, r.start, len(own)))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted((-1 if i is None else i, a, min(4096, len(t) - a)) for i, t in ids.items() for a in range(0, len(t), 4096))
    for placed in windows.values():
        placed.sort()
        assert [o for o, _ in placed] == np.cumsum([0] + [n for _, n in placed])[:-1].tolist()
        assert sum(n for _, n in placed) <= 4096


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_a_rare_label_drops_no_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    free = next(i for i in range(20_000, 20_100) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = docs.unionByName(spark.createDataFrame([(free, "ok", "xx", "s", 2)], COLUMNS))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if r.text and language.LETTER.search(r.text)}


def test_foreign_texts_go_by_their_length(spark):
    """What is unlike any learnt language goes once it is long enough to tell, and clean short texts stay."""
    clean = ["And of the thing there.", "the end", "ok", "of the other thing and the end of it"]
    foreign = {"漢字": True, "漢字" * 2: True, "漢字" * 8: False, "漢字" * 200: False}
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(
        [(20_000 + i, t, None, "s", len(t)) for i, t in enumerate([*clean, *foreign])], COLUMNS))
    kept = {r.text for r in corpus_pipeline.language_id(spark, docs, SF).where("doc_id >= 20000").collect()}
    assert kept == {*clean, *(t for t, stays in foreign.items() if stays)}
