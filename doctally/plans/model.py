"""The driver's tables in the roles of the engine's: each adapter is one SELECT that Spark and the oracle both understand."""

from __future__ import annotations

import math

DOCS = """SELECT s_suppkey AS document_id, s_nationkey AS org_id, s_name AS title, s_suppkey % 17 = 0 AS deleted, 1 + s_suppkey % 5 AS authority_level,
    CASE s_suppkey % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'hr' WHEN 2 THEN 'finance' ELSE '' END AS department,
    CASE s_suppkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'report' ELSE 'note' END AS document_type,
    CASE s_suppkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
    s_suppkey % 400 AS age_days, 3 + s_suppkey % 40 AS aligned_claims, round(abs(s_acctbal) / 100, 2) AS drift FROM supplier"""
CLAIMS = """SELECT l_suppkey * 1000000 + l_partkey AS claim_id, l_suppkey AS document_id, l_partkey AS subject, round(avg(l_discount), 6) AS value, count(*) AS n
    FROM lineitem GROUP BY l_suppkey, l_partkey"""
PAIRS = f"""SELECT a.document_id AS doc_a, b.document_id AS doc_b, a.claim_id AS claim_a, b.claim_id AS claim_b, round(least(1, 0.65 + 4 * abs(a.value - b.value)), 6) AS confidence,
    (a.document_id + b.document_id) % 7 = 0 AS is_evolution, a.subject % 3 = 0 AS sampled, round(0.5 + abs(a.value - b.value), 6) AS gate_similarity,
    CASE (a.document_id + a.subject) % 6 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'FALSE_POSITIVE' WHEN 3 THEN 'INTENTIONAL_DIVERGENCE' WHEN 4 THEN 'PENDING' END AS review_status,
    CASE a.subject % 5 WHEN 0 THEN 'direct_opposition' WHEN 1 THEN 'outcome_inversion' ELSE 'confidence_conflict' END AS kind, (a.document_id * 7 + b.document_id) % 90 AS reviewed_days_ago
    FROM ({CLAIMS}) a JOIN ({CLAIMS}) b ON a.subject = b.subject AND a.document_id < b.document_id WHERE abs(a.value - b.value) >= 0.05"""
ALERTS = """SELECT event_id AS alert_id, user_id AS org_id, event_type AS alert_type, ts AS created_at,
    CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
    CASE event_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status FROM events"""
VECTORS = "SELECT vec_id, label AS document_id, vec_id % 2 = 1 AS is_claim, CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'v0' ELSE 'v1' END AS version, embedding FROM embeddings"
#: Names under which the adapters can be used in SQL.
ADAPTERS = {"m_docs": DOCS, "m_claims": CLAIMS, "m_pairs": PAIRS, "m_alerts": ALERTS, "m_vectors": VECTORS}
_TABLES = {"m_docs": ["supplier"], "m_claims": ["lineitem"], "m_pairs": ["lineitem"], "m_alerts": ["events"], "m_vectors": ["embeddings"]}


#: Rounding to cents where the oracle scales a double first and Spark rounds its decimal digits: 14.50 / 100 is 0.14 for the one and 0.15 for the other.
_CENTS = ("round(abs(s_acctbal) / 100, 2)", "round(abs(s_acctbal) / 100 * 100D) / 100D")


def adapted(spark, sf_dir: str, name: str):
    """An adapter as a frame."""
    sql = ADAPTERS[name].replace(*_CENTS)
    return spark.sql(sql.replace(f"FROM {_TABLES[name][0]}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{_TABLES[name][0]}.parquet"))


#: Pairs of claims that share a subject which a task makes on average, at most.
PAIRS_A_TASK = 2_000_000
#: Lines that a task has on average, at least: a subject of very many claims can't be cut by more tasks.
LINES_A_TASK = 20_000


def pairs_in_tasks(spark, sf_dir: str):
    """m_pairs, made in as many tasks as its number of pairs asks for, and that number of tasks.

    Lines are dealt by subject once: claims are made of them and meet where they lie. Lines dealt by their own size would be few tasks of many pairs, and nearly each line is a claim, so counting before that spares nothing.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_discount")
    most, n = lines.where("l_partkey is not null").groupBy("l_partkey").count().selectExpr("coalesce(sum(count * (count - 1D) / 2), 0)", "coalesce(sum(count), 0)").first()
    tasks = max(spark.sparkContext.defaultParallelism, min(math.ceil(most / PAIRS_A_TASK), n // LINES_A_TASK))
    claims = spark.sql(CLAIMS.replace("FROM lineitem", "FROM {source}"), source=lines.repartition(tasks, "l_partkey"))
    return spark.sql(PAIRS.replace(f"({CLAIMS})", "{claims}"), claims=claims), tasks


def with_model(sql: str) -> str:
    """SQL with the adapters that it names in front."""
    used = [f"{k} AS ({v})" for k, v in ADAPTERS.items() if k in sql]
    head, body = ("WITH RECURSIVE", sql.replace("WITH RECURSIVE", "", 1)) if sql.lstrip().startswith("WITH RECURSIVE") else ("WITH", sql.replace("WITH", "", 1) if sql.lstrip().startswith("WITH") else None)
    return f"{head} {', '.join(used)}, {body}" if body is not None else f"WITH {', '.join(used)} {sql}"
