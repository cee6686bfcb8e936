import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from doctally.llm import toxicity as T


def maximal_segments(scores):
    """All maximal scoring segments by recursion on the best segment."""
    best = max(((sum(scores[i:j]), -(j - i), -i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], best[3]
    return maximal_segments(scores[:i]) + [(best[0], i, j)] + [(s, a + j, b + j) for s, a, b in maximal_segments(scores[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-4, -2, -1, 1, 3, 7]), max_size=14))
def test_segments_equal_recursion(scores):
    names = [f"t{i}" for i in range(len(scores))]
    model = T.Model({n: (float(s), True) for n, s in zip(names, scores, strict=True)}, 1.0)
    got = sorted((s, i, j) for s, i, j in model.segments(names))
    want = sorted(maximal_segments([float(s) for s in scores]))
    assert [s for s, _, _ in got] == [s for s, _, _ in want]


def test_learns_and_generalises(spark, docs, stored, crc, clash):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        text = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), "zorg" + word())
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "zorgba " * 9, "en"), (1003, " ".join(word() for _ in range(30_000)), "en")]
    sf = stored(documents=clash(docs(rows)), labels=spark.createDataFrame([*labels, (1000, 1, None)], "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r for r in T.op6_toxicity(spark, sf).collect()}
    held = [(bad, found[i]["predicted"]) for i, _, bad in labels if crc(i, 3) == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert [found[i]["predicted"] for i in (1000, 1001, 1002, 1003)] == [0, 0, 1, 0] and found[1000]["score"] == found[1001]["score"] == min(r["score"] for r in found.values())
    assert all(r["held_out"] == (crc(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in found.items())
    model = T.fitted(spark, sf)
    text = "ba de zorgkilo zorgmu ba"
    assert [text[a:b] for a, b, _, _ in model.passages(text)] == ["zorgkilo zorgmu"]
    kept = T.reject(spark.read.parquet(f"{sf}/documents.parquet"), model)
    assert kept.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}


def test_one_class_only(spark, docs):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    frame = docs([(1, "a b", "en"), (2, None, "en")])
    model = T.learn(frame, labels)
    assert [r["score"] for r in T.score(frame, model).collect()] == [0.0, 0.0] and T.score(docs([]), model).count() == 0


def test_short_toxic_texts(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu"]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join([word() for _ in range(rng.randint(3, 400))] + ["zorgo"] * (i % 5 == 0)), "en") for i in range(400)]
    model = T.learn(docs(rows), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int"))
    assert model.score("zorgo") >= 0.7 and model.score("ba zorgo") >= 0.7 and model.score("ba " * 900 + "zorgo") >= 0.7
    assert max(map(model.score, ["", "ba", "ba de", "kilomu", "ba " * 900])) < 0.7


def brute_model(rows, prior=2.0, drift=1.0, errors=1.5, support=3, significance=0.05):
    """Every step from its definition, on (text, toxic) rows; a function from texts to scores."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    forms = lambda w: [w, w[:6] + "*", w[:5] + "*", w[:4] + "*"]
    seen = [({x for w in words(t) for x in forms(w)}, bad) for t, bad in rows if t is not None]
    n = {k: sum(bad == k for _, bad in seen) for k in (True, False)}
    count = {k: Counter(x for xs, bad in seen if bad == k for x in xs) for k in (True, False)}
    every = sorted({x for x in (*count[True], *count[False]) if count[True][x] + count[False][x] > 1})
    weight = {}
    for x in every:
        a, b = count[True][x], count[False][x]
        alpha = prior * (a + b) / (n[True] + n[False]) + 0.5
        odds = lambda k, size: (k + alpha) / (size + prior - k - alpha + 1)  # noqa: B023, E731
        value = math.log(odds(a, n[True]) / odds(b, n[False]))
        drawn = max(0.0, abs(value) - errors * math.sqrt(1 / (a + alpha) + 1 / (b + alpha)))
        if b > 1 or a >= support:
            weight[x] = math.copysign(drawn, value) - drift

    def of(word):
        found = []
        for x in forms(word):
            if x in weight:
                found.append(weight[x])
                if count[False][x] > 1:
                    break
        return max(found, default=-drift)

    mass = [(of(w), count[False][w] + 0.01) for w in every if not w.endswith("*")] + [(-drift, 1.0)]
    total = sum(p for _, p in mass)
    rate = brentq(lambda x: sum(p * math.exp(x * s) for s, p in mass) / total - 1)
    segments = lambda t: [s for s, _, _ in maximal_segments([of(w) for w in words(t)])]
    clean = [t for t, bad in rows if not bad and t is not None]
    scale = len(clean) / sum(len(words(t)) * math.exp(-rate * max(segments(t), default=0.0)) for t in clean)

    def evidence(t):
        found, size = segments(t), len(words(t))
        strong = [s for s in found if scale * size * math.exp(-rate * s) <= significance]
        return min(0.0, math.log(scale * size) - rate * (sum(strong) or max(found))) if found else 0.0

    values = sorted({evidence(t) for t, _ in rows if t is not None})
    edges = [values[0] - 2, *values, 0.0]
    cuts = [(edges[k] + edges[k + 1]) / 2 for k in range(len(values) + (values[-1] < 0))]
    wrong = lambda c: sum((evidence(t) < c) != bad and 1 / math.sqrt(n[bad]) for t, bad in rows if t is not None)
    cut = min(cuts, key=lambda c: (round(wrong(c), 9), c))
    return lambda t: 1 / (1 + math.exp(min(700, max(-700, evidence(t) - min(cut, -1e-9) - math.log(0.7 / 0.3)))))


def brentq(f):
    """The root beyond zero of a function that is negative before it."""
    low, high = 1e-9, 1.0
    while f(high) < 0:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def test_scores_by_brute_force(spark, docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu", "ra"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(120):
        text = [word() for _ in range(rng.randint(1, 40))]
        if bad := i % 4 == 0:
            for _ in range(rng.randint(0, 3)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["zorg", "zorgen", "blark"]))
        rows.append((" ".join(text), bad))
    rows += [(None, True), ("", False)]
    labels = spark.createDataFrame([(i, int(bad)) for i, (_, bad) in enumerate(rows)], "doc_id long, toxic int")
    model = T.learn(docs([(i, t, "en") for i, (t, _) in enumerate(rows)]), labels)
    want = brute_model(rows)
    for t in [*(t for t, _ in rows), "zorgling ba", "blark", "ba de ki", "zorg zorg " * 9 + "lo"]:
        assert abs(model.score(t) - want(t)) < 1e-6
    assert 15 < sum(want(t) >= 0.7 for t, bad in rows if bad) <= 30 and sum(want(t) >= 0.7 for t, bad in rows if not bad) < 5


def test_labels_repeat_and_clash(spark, docs, clash):
    rows = [(i, f"w{i % 7} bad" if i % 2 else f"w{i % 7} good", "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    frame = clash(docs([*rows, rows[1], (None, "w1 bad", "en")]))
    model = T.learn(frame, labels)
    found = T.score(frame, model).collect()
    assert len(found) == 62 and all(r["predicted"] == (1 if r["doc_id"] is None else r["doc_id"] % 2) for r in found)
