"""Registered queries over the test tables."""

from importlib import import_module

MODULES = ("interval_queries", "sequence_queries", "statistics_queries", "table_queries", "source_queries")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"spanframe.plans.{name}")
