"""The combined automaton against Python's regular expressions."""

import hashlib
import random
import re

import pytest

from plumbline.llm import automaton
from plumbline.llm.secret_scan import BASE_RULES, RULES, Rule, Scanner, redact, secrets

SCANNER = Scanner.of(RULES)
PLAIN = {
    "assign": re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile("()(AKIA[A-Z0-9]+)"), "hex": re.compile("()([0-9a-f]+)"),
    "github": re.compile("()(gh[pousr]_[A-Za-z0-9]+)"),
    "private_key": re.compile("()(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)")}
LEAST = {"assign": 6, "access": 20, "hex": 24, "github": 40, "private_key": 1}


def plain(text, kinds=PLAIN):
    spans = []
    for order, kind in enumerate(kinds):
        spans += [(m.start(), order, kind, m.end()) for m in PLAIN[kind].finditer(text) if len(m[2]) >= LEAST[kind]]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


HEX = "0123456789abcdef"
FIXED = ["", "token", "token=", "password=b7db7aa4a5fcc78305", 'token = "' + HEX * 3 + '"', "secret=token: abcdef123456",
         "secret=token: xsecret=abcdefgh", "token==abc", "token: =abcdef", "API_KEY : 'abcdefg' apikey:abcdef", "é" * 9 + "passwd='秘abcdef",
         "AKIA" + "A" * 16, "AKIAKIA" + "A" * 15, "AKIA" + "A" * 15, HEX + HEX[:7], HEX + HEX[:8], "\u017fecret=abcdef", "to\u212aen=abcdefg",
         "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "token" + " " * 5000 + "=" + " " * 3000 + "abcdef",
         "f" * 40_000, "x" * 3000 + "password=" + "Q" * 5000, "token=ab token=abcdefg"]


def test_fixed_texts():
    assert SCANNER.scan(FIXED) == [plain(t) for t in FIXED]


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(automaton, "LANE", rng.choice([3, 16, 64]))
    parts = ["token", "SECRET", "password", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKI", "A1", HEX, "abc", "é", "\n", "x.y-z", "ghp_", "f" * 11, "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert SCANNER.scan(texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("pattern,text", [("a{2,3}b|c+", "aabcaaab"), (r"[^a-c]x?\.", "dx.ax."), ("(ab|a)(bc)?", "abc"), (r"\w+\s?\d", "ab 1"), ("a|b|", "b")])
def test_longest_is_a_match(pattern, text):
    auto = automaton.compile_patterns([(pattern, False)], anywhere=False)
    for at in range(len(text)):
        ends = [e for e in range(at, len(text) + 1) if re.fullmatch(pattern, text[at:e], re.ASCII)]
        assert automaton.longest(auto, text.encode(), at)[1] == ends


def test_refused_patterns():
    for bad in ("a(", "a)", r"\q", "[é]"):
        with pytest.raises(ValueError):
            automaton.compile_patterns([(bad, False)], anywhere=False)
    with pytest.raises(ValueError):
        Scanner.of([Rule("none", "")])


def test_minimal():
    auto = automaton.compile_patterns([("(aa|ba|ca)x", False)], anywhere=False)
    assert len(auto.accepts) == 5  # start, one letter, two letters, end, dead


def test_frames(spark):
    rows = [(1, FIXED[3], "a"), (None, None, None), (2, "", "b"), (2, FIXED[10], "b"), (2, FIXED[10], "b"), (3, FIXED[4] + " and " + FIXED[11], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(2)
    got = secrets(docs).collect()
    assert sorted((r.text or "", [tuple(s) for s in r.secrets]) for r in got) == sorted((t or "", plain(t or "")) for _, t, _ in rows)
    clean = redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r.text is None, r.text or "") for r in clean.collect()) == sorted([
        (False, "[SECRET]"), (True, ""), (False, ""), (False, "é" * 9 + "passwd='秘abcdef"), (False, "é" * 9 + "passwd='秘abcdef"), (False, "[SECRET]\" and [SECRET]")])
    assert secrets(docs.limit(0)).collect() == []


def test_query(spark):
    from plumbline.llm import catalog
    sf = "/root/testdata/sf0.01"
    base = [r.kind for r in BASE_RULES]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.QUERIES["op3_secret_scan"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_hex for r in rows) > 0
    for r in rows:
        spans = plain(texts[r.doc_id], base)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == b for k, _, _ in spans) for b in base]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r.doc_id]))
