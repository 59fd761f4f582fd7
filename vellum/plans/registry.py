"""Collects the named queries and their oracle SQL."""

from __future__ import annotations

FLAGSHIP = "rank_topk"
_QUERIES: dict = {}
_ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) -> DataFrame, with its DuckDB SQL if there is one."""

    def keep(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return keep


def _load() -> None:
    from vellum.plans import branch_queries, eval_queries, event_queries, file_queries, graph_queries, link_queries, mention_queries, overlap_queries, relational_queries, span_queries, sql_queries, stream_queries, tagger_queries, text_queries, vector_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_ORACLES)
