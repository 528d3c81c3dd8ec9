"""Registered queries over the driver's tables."""

from __future__ import annotations

from tidemark.plans import daily, evaluation, inputs, metrics, models, more, networks, records, series, stricter, whole, wider

_MODULES = (daily, metrics, series, records, models, more, inputs, evaluation, wider, whole, networks, stricter)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
