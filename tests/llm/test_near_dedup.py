import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from doctally.llm import near_dedup as N


def bag(counter):
    keys = np.array(sorted(counter), np.uint64)
    return keys, np.array([counter[int(k)] for k in keys], np.int64)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for _ in range(3):
        a = {int(x): int(rng.integers(1, 9)) for x in rng.integers(0, 2**62, 300)}
        b = {k: max(1, v + int(rng.integers(-2, 3))) for k, v in a.items() if rng.random() < 0.8}
        s = N.bag_min_hash([bag(a), bag(b)], 4000)
        assert abs((s[0] == s[1]).mean() - N.similarity(bag(a), bag(b))) < 0.03
    one = N.bag_min_hash([bag({5: 1}), bag({5: 1}), bag({5: 100_000})])
    assert (one[0] == one[1]).all() and one.all()


def classes(rows):
    """Connected components of weighted Jaccard similarity 0.8 on five-word shingles, by all pairs."""

    def shingled(t):
        w = re.findall(r"\w+", (t or "").lower())
        return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    bags = [shingled(t) for _, t, _ in rows]
    label = [i for i, _, _ in rows]
    for _ in rows:
        before = list(label)
        for i in range(len(rows)):
            for j in range(i):
                shared = sum((bags[i] & bags[j]).values())
                total = sum(bags[i].values()) + sum(bags[j].values()) - shared
                if rows[i][1] == rows[j][1] or (total and shared / total >= 0.8):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return {i: c for (i, _, _), c in zip(rows, label, strict=True)}


def test_classes(spark, docs, clash):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, base = [], text(200)
    for i in range(30):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(200)] = "new"
        rows.append((i, " ".join(copy), "en"))
    shared = text(60)
    rows += [(100 + i, " ".join(text(60) + shared), "en") for i in range(12)]  # a shared passage is no near copy
    rows += [(200, None, "en"), (201, "", "en"), (202, "one two", "en"), (203, "One, two!", "en"), (204, "...", "en"), (205, " ".join(text(20000)), "en"), (206, "same", "en"), (206, "same", "en")]
    rows += [(300, "a b c d e " * 50, "en"), (301, "a b c d e " * 55, "en"), (302, "a b c d e " * 10, "en")]
    found = N.near_duplicates(clash(docs([*rows, (None, "x", "en")])), small=4)
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    want = classes([(i, t or "", s) for i, t, s in rows])
    assert got.pop(None) is None and got == want
    kept = [r["doc_id"] for r in N.keep_one(clash(docs([*rows, (None, "x", "en"), (None, "x", "en")]))).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(want.values())) and kept.count(None) == 2


def test_repeated_rows_and_shared_ids(spark, docs):
    words = " ".join(f"w{i}" for i in range(60))
    # id 5 stands for two texts, of which one is a near copy of what 3 has; 7 is repeated, 9 is an exact copy of 7
    rows = [(5, words, "en"), (5, "quite another text than that", "en"), (3, words + " x", "en"), (7, "seven is here twice", "en"), (7, "seven is here twice", "en"), (9, "seven is here twice", "en")]
    found = [tuple(r) for r in N.near_duplicates(docs(rows)).collect()]
    assert sorted(found) == sorted([(5, 3, 5, False), (5, 5, 5, True), (3, 3, 3, True), (7, 7, 7, True), (7, 7, 7, True), (9, 7, 7, False)])
    kept = N.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r["doc_id"], r["text"][:5]) for r in kept.collect()) == [(3, "w0 w1"), (5, "quite"), (7, "seven")]


@pytest.mark.parametrize("n", [30, 300])
def test_no_link_of_a_group_is_lost(spark, docs, n):
    """Near copies of one text around the threshold: the classes are those of all pairs, the texts outside the middle's class included."""
    rng = random.Random(n)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            copy[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "en"))
    codes = N.WordCodes()
    bags = [N.shingles(t, codes) for _, t, _ in rows]
    size, shared = np.array([c.sum() for _, c in bags]), N.shared_counts(bags, bags)
    near = shared >= 0.8 * (size[:, None] + size[None, :] - shared) - 1e-9
    label = np.arange(n)
    for _ in range(n):
        label = np.where(near, label[None, :], n).min(1)
    assert len(set(label.tolist())) > 3 and np.triu(near, 1).sum() > n
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs(rows), block=16).collect()} == dict(enumerate(label.tolist()))


def test_chain_in_one_bucket(spark, docs, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    # neighbours have a similarity of 0.83, others of 0.7 at most: most links are between texts of which neither is a pivot
    rows = [(i, " ".join(words[9 * i : 9 * i + 100]), "en") for i in rng.sample(range(24), 24)]
    monkeypatch.setattr(N, "_signed", lambda rows: rows.selectExpr("_id", "_sha", "length(_text) _size", "array(1L, 2L) _keys"))
    want = classes(rows)
    assert set(want.values()) == {0}
    monkeypatch.setattr(N, "BLOCK_CHARS", 10_000)  # several blocks
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs(rows)).collect()} == want


def test_shared_counts():
    rng = np.random.default_rng(1)
    bags = [bag({int(k): int(rng.integers(1, 6)) for k in rng.integers(0, 300, n)}) for n in (1, 5, 100, 200, 200)]
    counts = N.shared_counts(bags[:2], bags[2:])
    whole = N.shared_counts(bags, bags)
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            shared = sum((Counter(dict(zip(*a, strict=True))) & Counter(dict(zip(*b, strict=True)))).values())
            assert whole[i, j] == shared and (i >= 2 or j < 2 or counts[i, j - 2] == shared)


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "_a long, _b long")
    by = defaultdict(set)
    for r in N.components(edges).collect():
        by[r["_label"]].add(r["_id"])
    assert by == {0: set(range(41)), 100: {100, 101}}


def test_empty(docs):
    assert N.near_duplicates(docs([])).count() == 0
