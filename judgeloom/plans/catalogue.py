"""Registered queries and their SQL."""

from __future__ import annotations

from . import arrays_queries, evaluation_queries, layout_queries, measure_queries, pair_queries, record_queries, score_queries, source_queries, state_queries, store_queries, text_queries, trace_queries, vector_queries  # noqa: F401  they register
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
