"""Steps whose work must not grow beyond what the result needs."""

import itertools
import re

import numpy as np
from doctally.config import Config
from doctally.operators import scan
from doctally.operators import vectors as V
from pyspark.sql import functions as F


def test_pairs_within_a_group_meet_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), i, (rng.normal(size=5)).tolist()) for i in range(120)] + [(0, 900, None), (None, 901, [1.0] * 5), (1, 902, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "g int, vec_id long, embedding array<double>")
    found = V.similar_within(frame, "g", 0.4, block=7)
    wanted = {}
    for (g, i, x), (h, j, y) in itertools.combinations([r for r in rows if r[0] is not None and r[2] is not None and any(r[2])], 2):
        sim = round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
        if g == h and sim >= 0.4:
            wanted[i, j] = sim
    rows = found.collect()
    assert len(rows) == len(wanted) > 100 and all(abs(wanted[r["a_id"], r["b_id"]] - r["similarity"]) < 2e-6 for r in rows)
    # no join makes all pairs as rows
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "a_id" in plan and "FlatMapGroupsInPandas" in plan


def test_sections_are_not_broadcast(spark):
    """Texts and vectors made within a row look as small as what they are made of."""
    docs = spark.createDataFrame([(i, f"1. Energy\nThe output of plant {i // 2} improved by 40 percent in spring.\n") for i in range(6)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5)], "doc_a long, doc_b long")
    found = scan.aligned_sections(pairs, docs, 0.5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3


def test_routed_scan_without_a_pair_for_the_claims(spark, monkeypatch):
    """No pair takes the path of claims, so no claim is made; a pair that takes it is searched from its own documents only."""
    text = "1. Energy\nThe solar output of the northern plant improved by 40 percent across the whole region in spring.\n"
    docs = spark.createDataFrame([(1, text), (2, text.replace("improved", "failed to improve"))], "doc_id int, text string")
    both = spark.createDataFrame([(1, 2)], "doc_a int, doc_b int")
    calls, real = [], scan.claim_pairs
    monkeypatch.setattr(scan, "claim_pairs", lambda *x, **y: calls.append(x) or real(*x, **y))
    assert {r["scan_path"] for r in scan.routed_scan(both, docs, Config(alignment=0.5, structured=0.0)).collect()} == {"structured"} and not calls
    scan.routed_scan(both, docs, Config(gate_similarity=0.4, gate_sample=0.0, structured=1.1)).collect()
    assert len(calls) == 1


def test_best_of_queries_in_slices(monkeypatch):
    """However many queries meet however many vectors, no more than COSINES cosines are held at once, and the result is the same."""
    rng = np.random.default_rng(2)
    asked = (np.arange(50), np.arange(50) % 3, V.unit(rng.integers(-1, 2, size=(50, 4)).astype(float)))
    there, groups, rows = np.arange(20, 90), np.arange(70) % 3, V.unit(rng.integers(-1, 2, size=(70, 4)).astype(float))
    whole, sizes, real = V._best(asked, there, groups, rows, 5, 0.1, True), [], np.partition
    monkeypatch.setattr(V, "COSINES", 200)
    monkeypatch.setattr(np, "partition", lambda x, *y, **z: sizes.append(x.size) or real(x, *y, **z))
    assert V._best(asked, there, groups, rows, 5, 0.1, True).equals(whole) and max(sizes) <= 200 and len(sizes) == 25


def test_claims_are_embedded_once(spark):
    rows = [("a", "a1", "Solar output exceeded the regional target of 40 percent in spring"), ("b", "b1", "Solar output exceeded the regional target of 25 percent in spring")]
    found = scan.claim_pairs(spark.createDataFrame(rows, "document_id string, claim_id string, content string"), config=Config(gate_similarity=0.5, gate_sample=0.0))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["a_id"], r["b_id"]) for r in found.collect()] == [("a1", "b1")]


def test_tables_above_256_mb_are_dealt_while_their_scan_has_few_tasks(spark):
    from doctally.plans.registry import dealt

    plan = lambda n: dealt(spark.range(n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(100_000_000) and "Repartition" not in plan(2_000_000_000)


def test_a_batch_of_texts_is_counted_in_slices(spark, tmp_path):
    """What a worker holds counted does not grow with the batch; the index is the same."""
    from doctally.operators import lexical_index as L

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(40))) for i in range(3 * L.TEXTS + 5)], "doc_id long, text string").coalesce(1)
    L.add(docs, str(tmp_path))
    known = {r["term"]: r["df"] for r in L.dictionary(spark, str(tmp_path)).collect()}
    texts = {r["doc_id"]: set(r["text"].split()) for r in docs.collect()}
    assert known.pop(L.ALL) == len(texts) and known == {t: sum(t in x for x in texts.values()) for t in set().union(*texts.values())}


def test_pairs_are_made_in_as_many_tasks_as_they_need(spark, monkeypatch):
    """What a task holds does not grow with the pairs: they are counted only after they are dealt out, by both documents at once."""
    from doctally.plans import model
    from doctally.plans.report_queries import contradiction_graph

    monkeypatch.setattr(model, "PAIRS_A_TASK", 1000)
    monkeypatch.setattr(model, "LINES_A_TASK", 10)
    plan = contradiction_graph(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^()]*), (\d+)\)", plan)
    assert {re.sub(r"#\d+L?", "", c) for c, _ in dealt} == {"source, target", "l_partkey"} and len({n for _, n in dealt}) == 1 and int(dealt[0][1]) > 20
    # no pair is counted between the join of claims and that dealing
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning(source") : plan.index("Join [subject")]


def test_neither_side_of_many_queries_is_copied(spark):
    """However many blocks there are, each vector and each query is shuffled or written once, and the best are those of a search of all at once."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, rng.integers(-1, 2, size=4).astype(float).tolist()) for i in range(300)]  # many ties
    frame = spark.createDataFrame(rows, "vec_id long, g long, embedding array<double>")
    asked = frame.withColumnRenamed("vec_id", "query_id")
    for least, apart in ((-1.0, None), (0.3, "g")):
        found = V.nearest(asked, frame, 6, least, skip_self=True, apart=apart, block=20)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "CoGroup" not in plan
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, V.nearest(asked, frame, 6, least, skip_self=True, apart=apart).collect()))


def test_sections_of_many_pairs_meet_in_one_call(spark):
    """Short pairs share calls: there are as many groups as their sections ask for, not as many as pairs, and texts are compared where their pairs are, without a join."""
    docs = spark.createDataFrame([(i, f"1. Energy\nThe solar output of plant {i // 2} {'improved' if i % 2 else 'failed'} by 40 percent in every spring.\n") for i in range(40)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)], "doc_a long, doc_b long")
    found = scan.structured_scan(pairs, docs, config=Config(alignment=0.5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and {(r["doc_a"], r["doc_b"], r["type"]) for r in found.collect()} == {(i, i + 1, "outcome_inversion") for i in range(0, 40, 2)}
    plan = scan.align_sections(*(docs.select((docs.doc_id % 20).alias("pair"), (docs.doc_id * 0).alias("position"), F.array(F.lit(1.0)).alias("embedding")).distinct() for _ in "ab"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan
