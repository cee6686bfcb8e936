import math
import random

import duckdb
import numpy as np
from doctally.llm import pivot_search as S
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, asked, k):
    """Straight from the definition, in Python integers."""
    usable = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i is None or not asked(i):
            continue
        score = lambda v: min(max(sum(x * y for x, y in zip(q, v)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        scored = [(-score(v), j is None, j or 0) for m, j, v in usable if m != n]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, rows, k=5, **settings):
    out = S.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 3 == 0, k, **settings)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, out.collect()), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * (3 if i % 5 else 0.2)).tolist(), "x") for i in range(250)]
    rows += [(1000 + i, rows[7][1], "copy") for i in range(60)]  # a group of copies: equal scores
    rows += [(2**60 + 3 * i, [0.25] * 8, "far id") for i in range(3)]
    assert found(spark, rows, sample=32, pivots=6, block=(20, 60)) == brute(rows, lambda i: i % 3 == 0, 5)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], "a"), (3, [1.0], "shorter"), (6, [], "empty"), (9, None, "null"), (12, [1.0, None], "holds null"), (15, [float("nan")], "nan"), (18, [float("-inf"), 1.0], "inf"),
        (None, [1.0, 2.0], "no id"), (None, [9.0, 9.0], "no id"), (21, [1e30, 1.0], "large"), (24, [-3e12, 5e15 + 1.0], "large"), (0, [1.0, 2.0], "repeated"), (27, [0.015624, -0.015626], "edge"), (-3, [0.5, -0.5], "negative"),
    ]
    random.Random(1).shuffle(rows)
    for k in (3, 20):
        assert found(spark, rows, k, block=(3, 4)) == brute(rows, lambda i: i % 3 == 0, k)
    assert found(spark, []) == [] == found(spark, rows[:0]) == found(spark, [(1, [1.0], "x")])
    assert found(spark, [(3, [1.0], "alone")]) == []


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16)) * 400
    v = np.floor(np.concatenate([c + rng.normal(size=(300, 16)) * 20 for c in centers]))
    pivots = S.farthest_first(v[::7], 12)
    table = S.distances(v, pivots)
    most = S.bounds(v[:40], table[:40], v, table)
    assert (most >= v[:40] @ v.T).all()
    block = S.Block(v.tolist(), table, np.arange(len(v)), 16)
    looked = []
    block.scores = lambda at, *x, score=block.scores: (looked.append(len(at)), score(at, *x))[1]
    for i in range(40):
        kept = block.best(v[i], v[i].tolist(), i, most[i], 5, -np.inf)
        exact = sorted(((float(s), -j) for j, s in enumerate(v @ v[i]) if j != i), reverse=True)[:5]
        assert [(s, -j) for s, j in kept] == exact
    assert sum(looked) < 0.5 * 40 * len(v)  # clusters that lie apart are not looked at


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = S.op13_pivot_search(spark, d).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    assert got.equals(con.sql(S.ORACLE).df().sort_values(["query_id", "rank"]).reset_index(drop=True)[got.columns])
