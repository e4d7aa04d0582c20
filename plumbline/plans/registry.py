"""Named queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .standins import World

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(check: str | None = None):
    """Register a function of ``World`` under its own name."""
    def add(fn: Callable[[World], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(World(spark, sf_dir))
        if check:
            ORACLES[name] = check
        return fn
    return add
