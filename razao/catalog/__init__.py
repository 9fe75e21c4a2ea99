"""Registered queries over the given tables, each with its oracle SQL where there is one."""

from __future__ import annotations

from razao.catalog import (  # noqa: F401
    ingest,
    jobs,
    ledger,
    matching,
    receivables,
    reports,
    scalars,
    single,
)
from razao.catalog.base import ORACLE, QUERIES, runnable


def queries() -> dict:
    return {name: runnable(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
