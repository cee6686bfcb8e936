import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from doctally.llm import phrases as P


def grams(texts, most=3):
    out = Counter()
    for text in texts:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            out.update(" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) + 1 - k))
    return out


def brute(rows, least, share, best):
    """Straight from the definition, in Python integers."""
    by_lang, out = {}, []
    for _, text, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append(text)
    for lang, texts in by_lang.items():
        f = grams(texts)
        n = sum(c for p, c in f.items() if " " not in p)
        found = []
        for p, a in f.items():
            w = p.split(" ")
            if len(w) < 2 or a < least:
                continue
            longer = [c for q, c in f.items() if q.count(" ") == 2 and len(w) == 2 and c >= least and p in (" ".join(q.split(" ")[:2]), " ".join(q.split(" ")[1:]))]
            if any(100 * c >= share * a for c in longer):
                continue
            cuts = [(10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, p.encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:best])]
    return sorted(out)


def texts(seed, n, words, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, most))) for _ in range(n)]


ODD = ["a", "A", "b", "the", "The", "É", "é", "日本", "x\x1cy", "\xa0", "it's", "-", "\x00"]


@pytest.mark.parametrize("sizes", [(10**6, 1 << 20), (50, 64), (7, 16)])
def test_automata_count_all_occurrences(monkeypatch, sizes):
    """Whatever a shard holds and wherever texts are cut, the counts are those of all phrases, and states have one endpos set."""
    monkeypatch.setattr(P, "SHARD", sizes[0])
    monkeypatch.setattr(P, "SLICE", sizes[1])
    some = [*texts(1, 40, ODD), "", "word " * 300, "." * 50, "one", " \t ", "z" * 200, "p q r " * 100]
    for lengths in ((1, 3), (3, 3), (1, 2)):
        found, total = Counter(), 0
        shard = P.Shard("x", lengths, None)
        for batch in [*shard.add([t.encode() for t in some[:20]]), *shard.add([t.encode() for t in some[20:]]), *shard.counted()]:
            for r in batch.to_pylist():
                if r["words"]:
                    assert len(r["phrase"].split(" ")) == r["words"]
                    found[r["phrase"]] += r["f"]
                else:
                    total += r["f"]
        wanted = {p: c for p, c in grams(some).items() if lengths[0] <= p.count(" ") + 1 <= lengths[1]}
        assert found == wanted
        assert total == (sum(c for p, c in wanted.items() if " " not in p) if lengths[0] == 1 else 0)


def test_states_and_links():
    ids = np.array([1, 2, 3, 4, 1, 5, 3, 4, 1, 2, 3, 4])  # a b c | d b c | a b c
    made = P.Automaton(ids, np.ones(len(ids), bool), 6, 3)
    states = {n: [(made.level[n][0][::-1, i].tolist(), c, link) for i, c, link in zip(*made.states(n), strict=True)] for n in (1, 2, 3)}
    # b and c end where b, b c do in all three; a b where a b does, twice
    assert states[1] == [([2], 2, 0), ([3], 3, 0), ([5], 1, 0)]
    assert states[2] == [([2, 3], 2, 1), ([5, 3], 1, 1), ([3, 4], 3, 0)]
    assert states[3] == [([2, 3, 4], 2, 2), ([5, 3, 4], 1, 2)]


def run(spark, rows, best=2000, **settings):
    frame = spark.createDataFrame([(i, t, lang, "x", "x") for i, t, lang in rows], "doc_id long, text string, lang string, phrase string, n string")
    out = P.collocations(frame, best, **settings)
    assert [c for c, _ in out.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def test_against_brute_force(spark):
    rows = [(i, t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(texts(7, 400, ODD + ["new york city", "new york", "of the", "of the people"]))]
    rows += [(None, "hot phrase here. " * 300, "en")] * 3 + [(0, None, "en"), (0, "", None), (1, "alone", "fr")]
    wanted = brute(rows, 10, 50, 2000)
    assert len(wanted) > 100 and run(spark, rows) == wanted
    assert run(spark, rows, 9) == brute(rows, 10, 50, 9)
    assert run(spark, rows, 300, least=2, share=80) == brute(rows, 2, 80, 300)
    assert run(spark, []) == [] == run(spark, [(1, None, None), (2, " . ", "en")])


def test_exact_beyond_64_bits(spark):
    """Products of large counts are made of decimals."""
    from pyspark.sql import functions as F

    a, n = 3_037_000_501, 4_000_000_007
    whole = lambda x: F.lit(x).cast("decimal(19,0)")
    row = spark.range(1).select((whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)")).alias("x"), (whole(n) * whole(n)).alias("y")).selectExpr("x div y AS s").first()
    assert row["s"] == 10**6 * a * a // (n * n)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    got = P.op11_phrases(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({P.ORACLE})").fetchall())
