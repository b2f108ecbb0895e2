"""Cross-parsing against plain substring search, and accuracy on held-out documents."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import language
from plumbline.llm.language import LanguageModel, fit, held_out, with_language

SAMPLES = {"xx": "the cat sat on the mat. the end of the cat", "yy": "der hund saß auf dem tisch und der tisch war", "zz": "le chat était sur la table, là où il était"}


def spaced(text):
    """Letters and all bytes of other scripts stay; a run of anything else is one space."""
    out = bytearray()
    for b in text.lower().encode():
        if not (97 <= b <= 122 or b >= 128):
            b = 32
        if b != 32 or not out or out[-1] != 32:
            out.append(b)
    return bytes(out)


def plain_phrases(text, sample, block):
    n = 0
    for at in range(0, len(text), block):
        part = text[at:at + block]
        while part:
            k = 1
            while k < len(part) and part[:k + 1] in sample:
                k += 1
            part, n = part[k:], n + 1
    return n


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_phrases(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(block)
    model = LanguageModel.of(SAMPLES)
    size = min(len(spaced(v)) for v in SAMPLES.values())
    words = " ".join(SAMPLES.values()).split() + ["日本", "QX", "42", "--", "ßé", "\n"]
    texts = ["a", "the", "ß", "日", "!", *["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(200)]]
    counts, sizes = model.phrases([t.lower().encode() for t in texts])
    for text, row, n in zip(texts, counts.tolist(), sizes.tolist()):
        assert n == len(spaced(text))
        assert row == [plain_phrases(spaced(text), spaced(SAMPLES[k])[:size], block) for k in model.languages]


def test_prediction(monkeypatch):
    model = LanguageModel.of(SAMPLES)
    texts = [None, "", " 12 %", "the cat", "der tisch", "là où", "日本語"]
    got = model.predict(texts)
    assert [g[0] for g in got] == ["und", "und", "und", "xx", "yy", "zz", "xx"]
    assert all(0 <= g[1] <= 1 for g in got) and got[-1][2] == 1.0
    monkeypatch.setattr(language, "STREAM", 1)
    assert model.predict(texts) == got
    assert LanguageModel.of({}).predict(["a", None]) == [("und", 0.0, 1.0)] * 2
    assert model.predict([]) == []


def test_frames(spark):
    rows = [(1, t, k, "x") for k, v in SAMPLES.items() for t in v.split(". ")] + [(None, "the cat", None, "y"), (5, None, "yy", "z"), (5, "9", "yy", "z"), (6, "the cat sat", "xx", "w"), (6, "the cat sat", "xx", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = fit(docs, docs["doc_id"] == 1)
    assert model.languages == ("xx", "yy", "zz")
    got = with_language(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.language.lang_pred == ("und" if r.text in (None, "9") else r.lang or "xx")
    assert with_language(docs.limit(0), fit(docs.limit(0), held_out())).collect() == []


def test_held_out_accuracy(spark):
    from plumbline.llm import catalog
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.QUERIES["op8_language"](spark, sf).collect()
    assert len(rows) == len(lang)
    tried = [r for r in rows if r.held_out]
    assert 0.25 < len(tried) / len(rows) < 0.42
    assert sum(r.lang_pred == lang[r.doc_id] for r in tried) / len(tried) > 0.97


def long_samples():
    import pyarrow.parquet as pq
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    out, tried = {}, []
    for d in docs:
        if not d["lang"] or not d["text"] or not language.LETTER.search(d["text"]):
            continue
        if d["doc_id"] % 2:
            out[d["lang"]] = (out.get(d["lang"], "") + "\n" + d["text"][:language.ROW_CHARS])[:language.SAMPLE_CHARS]
        else:
            tried.append((d["lang"], d["text"]))
    return out, tried


@pytest.mark.parametrize("rare", ["ok", "ok then, all is well and nothing more", "x" * 3000])
def test_a_label_with_little_text_takes_nothing_from_the_others(rare):
    samples, tried = long_samples()
    samples = dict(samples, aa=rare)
    alone = LanguageModel.of({k: v for k, v in samples.items() if k != "aa"})
    model = LanguageModel.of(samples)
    texts = [t.lower().encode() for _, t in tried[:50]]
    at = [model.languages.index(k) for k in alone.languages]
    assert (model.phrases(texts)[0][:, at] == alone.phrases(texts)[0]).all()
    got = model.predict([t for _, t in tried])
    assert sum(g[0] == k for g, (k, _) in zip(got, tried)) / len(tried) > 0.97
    assert all(g[2] < 0.7 for g, (_, t) in zip(got, tried) if len(t) >= 100)
    assert model.predict(["ok"])[0][0] == "aa" or rare[0] == "x"


def test_a_strange_symbol_counts_the_same_in_every_language():
    model = LanguageModel.of({"big": "the cat sat on the mat " * 50, "tiny": "ok"})
    assert [g[0] for g in model.predict(["日本語", "the mat", "ok"])] == ["big", "big", "tiny"]
    counts, sizes = model.costs(["日本語".encode()])
    assert counts.tolist() == [[sizes[0]] * 2]


def test_signs_are_no_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat sat on the mat", "\u00bd \u00b2 \u2460", "\u2167 12", "\u00e9", "\u00aa", "12 _ 34", "\u4e2d"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["language"]["lang_pred"] for r in language.with_language(df, language.fit(df, F.lit(True))).collect()}
    assert got == {0: "en", 1: "und", 2: "und", 3: "en", 4: "en", 5: "und", 6: "en"}


def test_more_labels_than_can_be_learnt(spark):
    rows = [(f"l{i:03}", "word " * (5 + i)) for i in range(30)] + [("l000", "word " * 500)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert language.fit(df, F.lit(True), languages=3).languages == ("l000", "l028", "l029")
    df = spark.createDataFrame([(f"l{i:03}", f"text of the label {i}") for i in range(language.LANGUAGES + 1)], "lang string, text string")
    model = language.fit(df, F.lit(True))
    assert len(model.languages) == language.LANGUAGES
    told = language.with_language(df.withColumn("language", F.lit("x")), model).select("language.lang_pred").collect()
    assert len(told) == language.LANGUAGES + 1 and all(r["lang_pred"] in model.languages for r in told)
