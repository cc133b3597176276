"""Registered queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from chronosift.plans import accounts, evidence, extras, feature_queries, learning_queries, market, research, studies

_MODULES = (market, research, accounts, evidence, feature_queries, extras, learning_queries, studies)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m._Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m._SQL.items()}
