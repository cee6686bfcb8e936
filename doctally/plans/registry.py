"""Registered queries with the SQL that they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core from which a scan keeps all cores busy by itself.
TASKS_A_CORE = 4


def dealt(rows, key: str):
    """rows spread over the cores, if the scan has too few tasks for that: a row group is read by a single task, however large it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(rows.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if size > TASKS_A_CORE * cores * split:
        return rows
    return rows.repartition(cores if size < cores << 20 else TASKS_A_CORE * cores, key)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def pattern(p: str) -> str:
    """A pattern for an engine whose word boundaries know ASCII letters only."""
    p = re.sub(r"(?<=[\w)}?])\\b", r"(?:$|[^\\p{L}\\p{N}_])", p)
    return quoted(p.replace(r"\b", r"(?:^|[^\p{L}\p{N}_])"))


def matches(x: str, p: str) -> str:
    return f"regexp_matches({x}, {pattern(p)})"


def matches_any(x: str, patterns) -> str:
    return "(" + " OR ".join(matches(x, p) for p in patterns) + ")"


def contains_any(x: str, texts) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(t)})" for t in texts) + ")"
