import math
import random
from collections import Counter, defaultdict

import numpy as np

from doctally.llm import language_id as L


def brute_cost(texts, text):
    """PPM with escape method C over bytes, straight from the sample's texts."""
    tables = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        s = b"\0\0\0" + t.encode()
        for i in range(3, len(s)):
            for order in range(4):
                tables[order][s[i - order : i]][s[i]] += 1
    s, bits = b"\0\0\0" + text, 0.0
    for i in range(3, len(s)):
        for order in (3, 2, 1, 0, -1):
            if order < 0:
                bits += 8
                break
            counts = tables[order].get(s[i - order : i], {})
            total, kinds = sum(counts.values()), len(counts)
            if s[i] in counts:
                bits -= math.log2(counts[s[i]] / (total + kinds))
                break
            if total:
                bits -= math.log2(kinds / (total + kinds))
    return bits


SAMPLES = {
    "en": ["the cat sat on the mat. the end"],
    "de": ["die katze saß auf der matte, ende"],
    "wide": ["".join(map(chr, range(32, 127))) + "äöüßéèç", "ABC abc 0123 !?"],  # more bytes than symbols
}


def test_code_lengths_equal_brute_force(monkeypatch):
    texts = [t.encode() for t in ("the cat", "katze saß", "a matte end", "", "~|{ \u3042\u3044", "the cat sat on the mat. " * 40)]
    for group in (8, 2):
        monkeypatch.setattr(L, "GROUP", group)
        scorer = L.Scorer({k: L.gram_counts(v) for k, v in SAMPLES.items()})
        got = scorer.lengths(texts)
        for t, row in zip(texts, got, strict=True):
            assert np.allclose(row, [brute_cost(SAMPLES[k], t) for k in scorer.languages], rtol=1e-4)
    whole = L.SLICE
    try:
        L.SLICE = 50
        assert np.allclose(scorer.lengths(texts), got, rtol=1e-6)
    finally:
        L.SLICE = whole


def test_ten_languages_and_odd_rows(spark, docs, stored, clash, crc):
    rng = random.Random(6)
    parts = {f"l{k}": [rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(7)] for k in range(10)}
    words = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(15))
    rows = [(i, words(f"l{i % 10}"), f"l{i % 10}") for i in range(400)]
    rows += [rows[5], rows[5], (None, words("l3"), "l3"), (None, None, None)]
    found = L.op3_language_id(spark, stored(documents=clash(docs(rows)))).collect()
    assert len(found) == len(rows)
    by = [(r["doc_id"], r["lang_pred"]) for r in found if r["doc_id"] is not None]
    assert sum(p == f"l{i % 10}" for i, p in by if crc(i, 4) == 2) / sum(crc(i, 4) == 2 for i, _ in by) > 0.97
    assert len({tuple(r) for r in found if r["doc_id"] == 5}) == 1 and sorted(r["lang_pred"] for r in found if r["doc_id"] is None) == ["l3", "und"]


SCRIPTS = {"latin": 0x61, "greek": 0x3B1, "cyrillic": 0x430, "armenian": 0x561, "hebrew": 0x5D0, "arabic": 0x628, "devanagari": 0x915, "thai": 0xE01, "georgian": 0x10D0, "hangul": 0xAC00}


def test_ten_scripts_with_two_languages_each(docs):
    """No script's letters push out another's: languages of one script are told apart by their letters' order, in one pass or several."""
    rng = random.Random(4)
    followers = {f"{s}{k}": {a: [rng.randrange(20) for _ in range(4)] for a in range(20)} for s in SCRIPTS for k in "12"}

    def text(language, n):
        at, out = rng.randrange(20), ""
        for _ in range(n):
            out += chr(SCRIPTS[language[:-1]] + at)
            at = rng.choice(followers[language][at])
        return out

    sample = docs([(i, text(x, 60), x) for i, x in enumerate(list(followers) * 40)])
    asked = [(10_000 + i, text(x, 25), x) for i, x in enumerate(list(followers) * 15)]
    frame = docs(asked + [(None, "123", None)])
    whole = {r["doc_id"]: r for r in L.identify(frame, L.learn(sample)).collect()}
    right = Counter(x for i, _, x in asked if whole[i]["lang_pred"] == x)
    assert all(right[x] >= 14 for x in followers), right
    parts = {r["doc_id"]: r for r in L.identify(frame, L.learn(sample, max_languages=7)).collect()}
    assert len(list(L.learn(sample, max_languages=7))) == 3
    assert all(parts[i]["lang_pred"] == r["lang_pred"] and abs(parts[i]["score"] - r["score"]) < 1e-9 for i, r in whole.items())


def test_equal_code_lengths_go_to_the_first_by_name(docs):
    frame = docs([(i, "same words here", x) for i, x in enumerate(["b", "a", "c"])])
    for most in (200, 1):
        found = L.identify(frame, L.learn(frame, max_languages=most)).collect()
        assert {(r["lang_pred"], round(r["score"], 9)) for r in found} == {("a", round(1 / 3, 9))}


def test_held_out_accuracy_and_edges(spark, docs, stored, crc):
    rng = random.Random(1)
    parts = {"xx": ["ka", "lo", "mi", "é"], "yy": ["sch", "ung", "er", "ü"], "zz": ["th", "ing", "wh", "o"]}
    words = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(12))
    rows = [(i, words(k := rng.choice(list(parts))), k) for i in range(300)]
    rows += [(400, None, "xx"), (401, "", "xx"), (402, "123 ...", "yy"), (403, words("yy") * 3000, "yy"), (404, words("zz"), None)]
    found = {r["doc_id"]: r for r in L.op3_language_id(spark, stored(documents=docs(rows))).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["lang_pred"] == k for i, _, k in rows if i < 300 or i == 403)
    assert [found[i]["lang_pred"] for i in (400, 401, 402)] == ["und"] * 3 and found[404]["lang_pred"] == "zz"
    assert all(r["held_out"] == (crc(i, 4) == 2) and 0 <= r["score"] <= 1 for i, r in found.items())


def test_nothing_to_learn(docs):
    frame = docs([(1, "abc", None)])
    assert [tuple(r) for r in L.identify(frame, L.learn(frame)).collect()] == [(1, "und", 0.0)]
    assert L.identify(docs([]), L.learn(docs([]))).count() == 0
