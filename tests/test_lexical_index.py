import math
import random
from collections import Counter

import pytest
from doctally.operators import lexical_index as L
from doctally.operators import vectors as V
from doctally.storage import shared_folder


def brute(queries, docs, k):
    """All scores, straight from the formula."""
    tokens = {i: t.lower().split() for i, t in docs}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    out = []
    for q, text in queries:
        scores = []
        for i, ts in tokens.items():
            tf = Counter(ts)
            hits = [(low if idf[t] < 0 else idf[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in text.lower().split() if tf[t]]
            if hits:
                scores.append((-round(sum(hits), 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(seed, n):
    """Words by a steep law: one in nearly all documents, most in few; and a group of copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda m: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=m))
    docs = [(i, text(rng.choice([1, 20, 60, 300]))) for i in range(n)]
    return docs + [(1000 + i, docs[5][1]) for i in range(80)] + [(5000, ""), (5001, "  ")], [(q, text(rng.choice([1, 3, 12]))) for q in range(25)]


def found(rows):
    return sorted(tuple(r) for r in rows.select("query_id", "doc_id", "bm25", "rank").collect())


def close(a, b):
    assert [(x[0], x[3]) for x in a] == [(x[0], x[3]) for x in b]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b, strict=True))
    # ids may change places only where scores are equal but for the last digit
    assert all(x[1] == y[1] or sum(abs(z[2] - x[2]) < 2e-6 and z[0] == x[0] for z in b) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("entries", [512, 7])
def test_best_equal_full_scoring(spark, entries, monkeypatch):
    monkeypatch.setattr(L, "ENTRIES", entries)
    docs, queries = corpus(3, 400)
    frame, path = spark.createDataFrame(docs, "doc_id long, text string"), shared_folder(spark)
    L.add(frame.where("doc_id % 3 = 0"), path, 0)
    for _ in range(2):  # a repeated batch replaces its rows
        L.add(frame.where("doc_id % 3 != 0"), path, 1)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for k in (1, 5):
        close(found(L.search(spark, path, asked, k)), brute(queries, docs, k))
    close(found(L.search(spark, path, asked, 5, limit=20)), brute(queries, docs, 5))


def test_terms_of_most_documents_and_odd_rows(spark):
    docs = [(1, "A a b"), (2, "a"), (3, "a c"), (4, "a B b b"), (5, None), (None, "a b"), (6, "x")]
    path = shared_folder(spark)
    L.build(spark.createDataFrame(docs, "doc_id long, text string"), path)
    queries = [(1, "a"), (2, "a b zzz"), (3, ""), (4, "nothing"), (5, "b b a")]
    asked = spark.createDataFrame([*queries, (None, "a"), (7, None)], "query_id long, query string")
    close(found(L.search(spark, path, asked, 3)), brute(queries, [(i, t or "") for i, t in docs if i is not None], 3))
    empty = shared_folder(spark)
    L.build(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert found(L.search(spark, empty, asked, 3)) == []


def test_thresholds_leave_documents_out():
    """A frequent word whose bound stays below the threshold is completed for candidates only, and blocks that can't reach it are passed over."""
    import pandas as pd

    weighted = pd.DataFrame([(1, "rare", 6.0, 20, 9, 10), (1, "often", 0.1, 9000, 50, 3)], columns=["query_id", "term", "weight", "df", "max_tf", "min_length"])
    plan = L.Plan(weighted, 100.0, 5)
    assert set(plan.rarest()) == {"rare"}
    plan.settle({1: 7.0})
    essential, other, missing = plan.split()
    assert set(essential) == {"rare"} and set(other) == {"often"} and 0 < missing[1] < 0.3


def test_scores_in_passes(spark):
    docs, queries = corpus(4, 60)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    for f, c in ((V.bm25, "bm25"), (V.term_cosine, "similarity")):
        one, many = ({(r[0], r[1]): round(r[c], 9) for r in f(asked, frame, **kw).collect()} for kw in ({}, {"most": 15}))
        assert one == many and len(one) > 100


def test_scores_leave_in_large_frames(spark, tmp_path, monkeypatch):
    """Many blocks and queries share a frame of scores, whatever it holds at most; the best are the same."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}" for k in range(12))) for i in range(90)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 2}") for q in range(1, 25)], "query_id long, query string")
    L.build(docs, str(tmp_path / "i"))
    wanted = sorted(map(tuple, L.search(spark, str(tmp_path / "i"), asked, 4).collect()))
    monkeypatch.setattr(L, "BATCH", 3)
    assert len(wanted) > 50 and sorted(map(tuple, L.search(spark, str(tmp_path / "i"), asked, 4).collect())) == wanted
