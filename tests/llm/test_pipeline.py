"""The pipeline against its stages done one after the other on the driver."""

import random

import corpus_pipeline
from doctally.llm import decontaminate, packing, secrets, toxicity

from .test_decontaminate import brute
from .test_near_dedup import classes


def test_run_equals_brute_force(spark, docs, stored):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [words(30) for _ in range(3)]
    rows, labels = [], []
    for i in range(240):
        text = words(rng.randint(20, 90))
        if i % 6 == 0:
            text += " zorgba zorgki zorglo"
        elif i % 17 == 1:
            text += " " + items[i % 3]
        elif i % 13 == 2:
            text += " password=abcdef123"
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, text, "en"))
    rows += [(300 + i, rows[i + 1][1], "en") for i in range(0, 30, 3)] + [(400, rows[1][1] + " x", "en"), (500, None, "en"), (501, "", "en")]
    sf = stored(
        documents=docs(rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    )
    model = toxicity.fitted(spark, sf)
    left = [(i, t, s) for i, t, s in rows if model.score(t) < toxicity.THRESHOLD]
    assert 30 < len(rows) - len(left) < 60
    label = classes([(i, t or "", s) for i, t, s in left])
    left = [r for r in left if label[r[0]] == r[0]]
    left = [r for r in left if not any(brute(r[1], item) for item in items)]
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(docs(left)).collect()}
    assert any("[secret]" in (t or "") for t in redacted.values())
    encoder = packing.Encoder(packing.default_tokenizer())
    want = {i: len(encoder.encode([t or ""])[0]) // 4 for i, t in redacted.items()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"] and decontaminate.SPAN == 9


def test_odd_tables(spark, docs, stored, clash):
    """Null ids, repeated rows, empty texts, columns with the operators' names, and no rows at all."""
    long = " ".join(f"w{k % 97}x{k % 89}" for k in range(20_000))
    rows = [(1, "one text of its own that nothing else has", "en"), (1, "one text of its own that nothing else has", "en"), (2, None, "en"), (3, "", "en"), (4, long, None)]
    rows += [(None, "a text without an id is kept as it is", "en"), (None, " ".join(f"b{k}" for k in range(30)), "en"), (None, None, None)]
    tables = {"labels": spark.createDataFrame([(1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(0, " ".join(f"b{k}" for k in range(30))), (None, None)], "item_id long, text string")}
    sf = stored(documents=clash(docs(rows)), **tables)
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    ids = lambda t: len(packing.Encoder(packing.default_tokenizer()).encode([t or ""])[0]) // 4
    # of the repeated row one is left, of the two empty texts one, and the quoted item goes though it has no id
    assert got == {1: ids(rows[0][1]), 2: 1, 4: ids(long), None: ids(rows[5][1]) + 1}
    frame = clash(docs(rows))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == clash(docs(rows)).columns
    empty = stored(documents=docs([]), **{k: v.limit(0) for k, v in tables.items()})
    assert corpus_pipeline.run(spark, empty).count() == 0
