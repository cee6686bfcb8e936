import random

from doctally.llm import decontaminate as D

WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(text, item):
    """Whether some diagonal has a window that one of the masks accepts, with enough equal words around."""
    import re

    d, b = ([w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in (text, item))
    for at in range(len(d) - D.SPAN + 1):
        for i in range(len(b) - D.SPAN + 1):
            if any(all(d[at + k] == b[i + k] for k in mask) for mask in D.MASKS):
                lo, hi = -min(i, D.REACH, at), D.SPAN + D.REACH
                pairs = [(d[at + k], b[i + k]) for k in range(lo, hi) if at + k < len(d) and i + k < len(b)]
                equal = sum(x == y for x, y in pairs)
                if equal >= 0.7 * len(pairs) and equal >= min(12, len(b)):
                    return True
    return False


def test_against_brute_force(spark, docs, clash):
    rng = random.Random(3)
    items = [" ".join(passage(rng, n)) for n in (9, 12, 20, 40, 60)] + ["too short here"]
    rows = []
    for i in range(40):
        text, item = passage(rng, rng.choice([0, 3, 30, 200])), rng.choice(items[:5]).split()
        if i % 2:
            cut = item[: rng.choice([len(item), len(item) // 2])]
            for k in range(0, len(cut), rng.choice([4, 7, 1000])):
                cut[k] = "changed"
            text[len(text) // 2 : len(text) // 2] = cut
        rows.append((i, " ".join(text).upper() if i % 4 else ", ".join(text), "en"))
    rows += [(100, None, "en"), (101, "", "en"), (102, items[3], "en"), (102, items[3], "en"), (None, items[3], "en"), (103, "z " * 5000 + items[4] + " z" * 5000, "en")]
    benchmark = spark.createDataFrame([*enumerate(items), (6, items[3]), (7, None), (None, items[2])], "item_id long, text string")
    whole = D.find_overlaps(clash(docs(rows)), benchmark)
    found = {(r["doc_id"], r["item_id"]) for r in whole.collect()}
    wanted = {(i, k) for i, t, _ in rows for k, item in [*enumerate(items), (6, items[3])] if brute(t, item)}
    assert found == wanted and (102, 6) in found and (103, 4) in found and (None, 3) in found
    assert sum(1 for i, _ in wanted if i is not None and i < 100) >= 8
    blocks = D.find_overlaps(docs(rows), benchmark, block=30)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == wanted
    assert {r["doc_id"] for r in D.remove_contaminated(docs(rows), benchmark).collect()} == {i for i, _, _ in rows if i not in {x for x, _ in wanted}}  # a null id protects no text


def test_empty_tables(spark, docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert D.find_overlaps(docs([(1, "a b c", "en")]), benchmark).count() == 0
    assert D.find_overlaps(docs([]), benchmark).count() == 0


def test_quotes_from_the_inside_and_short_items(spark, docs):
    item = [f"i{k}" for k in range(60)]
    around = lambda words, n=50: " ".join([*(f"a{k}" for k in range(n)), *words, *(f"b{k}" for k in range(n))])
    rows = [(n, around(item[20 : 20 + n]), "en") for n in (11, 12, 15, 23, 30)]
    rows += [(100, around(["too", "short", "here"]), "en"), (101, "Too short, here", "en"), (102, around(["too", "short", "x", "here"]), "en"), (103, "one", "en")]
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, "too short here"), (2, "Too SHORT here!"), (3, ""), (4, "two words")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["equal_words"], r["share"], r["first_word"]) for r in D.find_overlaps(docs(rows), benchmark).collect()}
    assert set(found) == {(n, 0) for n in (12, 15, 23, 30)} | {(d, i) for d in (100, 101) for i in (1, 2)}
    assert found[12, 0][:2] == (12, 12 / 12) and found[100, 1] == (3, 1.0, 50) and found[101, 2] == (3, 1.0, 0)


def test_phrase_of_many_items_is_spread_over_blocks(spark, docs, monkeypatch):
    phrase = [f"p{k}" for k in range(9)]
    items = [(i, " ".join([f"x{i}"] + phrase + [f"y{i}", f"z{i}"])) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    seen, whole = [], D.F.broadcast
    monkeypatch.setattr(D.F, "broadcast", lambda df: seen.append(df.count()) or whole(df))
    found = D.find_overlaps(docs([(1, "a b " + items[3][1] + " c", "en"), (2, "a b c", "en")]), benchmark, block=60)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 3)}
    # 40 items of 4 windows and 2 masks, of which the phrase's own hash comes 80 times
    assert len(seen) == 6 and max(seen) < 90 and sum(seen) == 320


def test_items_of_a_word_or_two_need_half_the_document(spark, docs):
    benchmark = spark.createDataFrame([(0, "Yes"), (1, "the end"), (2, "one two three")], "item_id long, text string")
    rows = [(1, "yes we can", "en"), (2, "Yes!", "en"), (3, "oh yes", "en"), (4, "and so the end", "en"), (5, "this is not the end", "en"), (6, "zero one two three four five six seven", "en")]
    assert {(r["doc_id"], r["item_id"]) for r in D.find_overlaps(docs(rows), benchmark).collect()} == {(2, 0), (3, 0), (4, 1), (6, 2)}
