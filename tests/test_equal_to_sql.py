"""Queries against their SQL on tables that the small scale has not: equal claim ids, ties of rounding, many claims of a document, documents without a shared subject."""

import os

import duckdb
import pytest

from doctally.plans.queries import oracle_sql, queries

from .test_queries import SF, rows_of


def same(spark, folder, name):
    c = duckdb.connect()
    for t in os.listdir(folder):
        c.sql(f"create view {t.split('.')[0]} as select * from '{folder}/{t}'")
    df, found = queries()[name](spark, str(folder)), c.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    rows = rows_of(found.fetchall(), names)
    assert rows_of(df.collect(), df.columns) == rows
    return rows


def tables(folder, **changed):
    """The small tables, some of them made by SQL."""
    for t in os.listdir(SF):
        sql = changed.get(t.split(".")[0], "select * from '{}'").format(f"{SF}/{t}")
        duckdb.sql(f"copy ({sql}) to '{folder}/{t}' (format parquet)")
    return folder


#: Claims of suppliers 0 to 9 for a million parts more, so that ids of neighbouring suppliers are equal.
EQUAL_IDS = "select * replace (l_partkey + i * 1000000 as l_partkey) from range(2) r(i), '{}'"


@pytest.mark.parametrize("name", ["apply_verdicts", "cascade_delete", "submit_reviews", "feedback_rows", "invalidate_explanations"])
def test_equal_claim_ids(spark, tmp_path, name):
    assert same(spark, tables(tmp_path, lineitem=EQUAL_IDS), name)


def test_ties_of_cents(spark, tmp_path):
    """Balances whose hundredth lies between two cents."""
    same(spark, tables(tmp_path, supplier="select * replace (14.5 + s_suppkey * 7 as s_acctbal) from '{}'"), "node_style")


def test_every_claim_is_a_seed(spark, tmp_path):
    """Documents with more claims than a scan starts from by default."""
    many = "select vec_id + i * 1000 as vec_id, list_transform(embedding, lambda x, k: (x + sin(k * (i + 1)) / 8)::FLOAT) as embedding, (vec_id % 2)::INT as label from range(8) r(i), '{}'"
    assert len(same(spark, tables(tmp_path, embeddings=many), "claim_pair_scan")) > 50


@pytest.mark.parametrize("name", ["dependency_evidence", "dependency_strength", "dependency_graph"])
def test_documents_without_a_shared_subject(spark, tmp_path, name):
    rows = same(spark, tables(tmp_path, lineitem="select * from '{}' where l_suppkey % 2 = 0"), name)
    assert rows


@pytest.mark.parametrize("name", ["impact_trace", "propagation"])
def test_traces_without_a_shared_subject(spark, tmp_path, name):
    """The smallest document has no strong edge: the trace starts at the smallest that has one."""
    changed = {"lineitem": "select * from '{}' where l_suppkey % 2 = 1", "embeddings": "select * from '{}' where vec_id % 3 > 0"}
    assert same(spark, tables(tmp_path, **changed), name) or name == "propagation"
