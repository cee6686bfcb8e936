import random

import numpy as np
import pytest
from doctally.operators import drift, graph, reports, scan
from doctally.operators import vectors as V
from pyspark.sql import functions as F

SECTIONS = "pair string, position long, embedding array<double>"


def sections(seed, pairs, most, size=4, levels=3):
    """Few different vectors, so that many scores are equal."""
    rng = np.random.default_rng(seed)
    known = rng.integers(-1, 2, size=(levels, size)).astype(float)
    return [(f"p{p}", 3 * k + 1, known[rng.integers(levels)].tolist()) for p in range(pairs) for k in range(int(rng.integers(0, most)))]


@pytest.mark.parametrize("least", [0.7, -0.5])
def test_rounds_of_dominant_pairs_equal_the_greedy_matching(spark, least):
    for seed, levels in ((1, 3), (2, 40)):
        a, b = (spark.createDataFrame(sections(seed + s, 6, 25, levels=levels), SECTIONS) for s in (0, 10))
        greedy, rounds = (sorted(map(tuple, x.collect())) for x in (scan.align_sections(a, b, least), scan.align_in_rounds(a, b, least, block=7)))
        assert rounds == greedy and len(greedy) > 5
    assert sorted(map(tuple, scan.align_sections(a, b, least, most=10).collect())) == greedy


def test_default_rule_as_expressions(spark):
    """The expressions give what the function of two texts gives."""
    rng = random.Random(3)
    words = ["Output", "must", "not", "reach", "40", "40.5", "percent", "never", "the", "Régional", "targets", "isn't", "of", "no", "7", "cannot", "a1b", "x"]
    texts = ["", "  ", "12", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(150))]
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(600)]
    frame = spark.createDataFrame(rows, "a string, b string")
    own, function = ([(r["label"], round(r["score"], 9)) for r in scan.classify(frame, rule).collect()] for rule in (None, scan.rule_label))
    assert own == function and len({x[0] for x in own}) == 3
    assert "ArrowEvalPython" not in scan.classify(frame)._jdf.queryExecution().executedPlan().toString()


def test_more_queries_and_centers_take_passes(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(90)], "vec_id long, embedding array<double>")
    asked = rows.select((F.col("vec_id") + 1000).alias("query_id"), "embedding", ((F.col("vec_id") * 7) % 95).alias("partner_id"))
    one, many = (sorted(map(tuple, V.partner_ranks(asked, rows, block=b).collect())) for b in (2000, 13))
    assert one == many and len(one) > 80
    centers = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(30)], "topic_id int, center array<double>")
    points = rows.withColumn("text", F.concat(F.lit("v"), "vec_id"))
    whole = sorted(map(tuple, drift.nearest_center(rows, centers, ["vec_id"]).collect())), sorted(map(tuple, drift.topic_labels(points, centers).collect()))
    limit, drift.MAX_CENTERS = drift.MAX_CENTERS, 7
    try:
        assert (sorted(map(tuple, drift.nearest_center(rows, centers, ["vec_id"]).collect())), sorted(map(tuple, drift.topic_labels(points, centers).collect()))) == whole
    finally:
        drift.MAX_CENTERS = limit


def test_titles_in_blocks_of_bytes(spark):
    docs = spark.createDataFrame([(1, "See the Travel Policy and HANDBOOK 2024."), (2, None), (3, "nothing"), (4, "handbook 2024 handbook 2024")], "doc_id long, text string")
    titles = spark.createDataFrame([(1, "Travel Policy"), (2, "Handbook 2024"), (3, "handbook 2024"), (4, "short"), (5, None), (6, "noth ing")], "item_id long, title string")
    wanted = [(1, 1), (2, 1), (2, 4), (3, 1), (3, 4)]
    for block in (8 << 20, 10):
        assert sorted(map(tuple, graph.title_mentions(docs, titles, block).collect())) == wanted


def test_metadata(spark):
    docs = spark.createDataFrame([(1, 1, False, 3, "hr", "2024-01-01 00:00:00"), (1, 2, True, 3, "hr", None), (2, 1, False, 2, "it", None)], "org_id int, document_id int, deleted boolean, authority_level int, owner_department string, effective_from string")
    docs = docs.withColumn("effective_from", F.col("effective_from").cast("timestamp"))
    updates = [(1, 1, 5, None, "3 Mar 2024", 1), (1, 1, 4, "legal", None, 0), (1, 2, 1, None, None, 0), (2, 1, 6, "x", None, 0), (2, 1, 0, None, None, 1), (3, 1, 1, None, None, 0)]
    changed, refused = reports.update_metadata(docs, spark.createDataFrame(updates, "org_id int, document_id int, authority_level int, owner_department string, effective_from string, ord int"))
    found = {(r["org_id"], r["document_id"]): (r["authority_level"], r["owner_department"], str(r["effective_from"])[:10]) for r in changed.collect()}
    assert found == {(1, 1): (5, "hr", "2024-03-03"), (1, 2): (3, "hr", "None"), (2, 1): (2, "it", "None")}
    assert sorted((r["org_id"], r["document_id"], r["reason"]) for r in refused.collect()) == [(1, 2, "document not found"), (2, 1, "authority_level must be 1-5"), (2, 1, "authority_level must be 1-5"), (3, 1, "document not found")]
