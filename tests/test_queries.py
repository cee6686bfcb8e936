"""Every query with SQL returns the rows that DuckDB returns."""

import math
import os

import duckdb
import pytest

from doctally.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def plain(v):
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(rows, names):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, SF)
    found = duck.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), names)


#: Queries without SQL: a column that is never null, and the rows that the small tables have at least (tests of the operators hold the values against brute force).
UNSPOKEN = {
    "cluster_fit": ("size", 2),
    "document_claim_scan": ("a_id", 0),  # generated prose holds no contradictions
    "hash_embed": ("embedding", 40),
    "org_topic_drift": ("movement", 4),
    "index_search": ("similarity", 40),
    "section_align": ("score", 0),
    "structured_scan": ("type", 0),
    "topic_fit": ("moved", 2),
}


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    column, least = UNSPOKEN[name]
    rows = queries()[name](spark, SF).select(column).collect()
    assert len(rows) >= least and all(r[0] is not None for r in rows)


def test_recall_of_the_index(spark):
    """Nine tenths of the exact neighbours at least."""
    exact, found = ({(r["query_id"], r["vec_id"]) for r in queries()[n](spark, SF).collect()} for n in ("knn_topk", "index_search"))
    assert len(exact & found) >= 0.9 * len(exact) > 0


def test_hashed_words(spark):
    """Embeddings by their definition."""
    import re
    import zlib

    for r in queries()["hash_embed"](spark, SF).join(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id").collect():
        v, words = [0.0] * 384, re.findall(r"[^\W_]+", r["text"].lower())
        for w in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]:
            h = zlib.crc32(w.encode())
            v[h % 384] += 1.0 if h >= 1 << 31 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert all(abs(x / norm - y) < 2e-6 for x, y in zip(v, r["embedding"], strict=True))


def test_every_document_is_scanned(spark):
    """structured_scan asks for the nearest of all documents, not of those whose id is divisible by 100."""
    from doctally.plans.pair_queries import _documents, _section_pairs

    folder = "/root/testdata/sf0.001"
    ids = {r["doc_id"] for r in _documents(spark, folder).select("doc_id").collect()}
    asked = {r["doc_a"] for r in _section_pairs(spark, folder).collect()}
    assert asked <= ids and any(i % 100 for i in asked)
