"""Registry of named queries: a Spark plan and, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanframe.plans.adapters import Tables
from spanframe.session import configure

_PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under a name; the plan takes the tables and returns a DataFrame."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in _PLANS:
            raise ValueError(f"query {name} registered twice")
        _PLANS[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return keep


def _callable(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Tables(configure(spark), sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _callable(plan) for name, plan in _PLANS.items()}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
