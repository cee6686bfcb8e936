"""All registered queries of the engine itself."""

from __future__ import annotations

from . import index_queries, pair_queries, report_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
