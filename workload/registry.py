"""Name → query, and name → oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from workload.adapter import Tables, tables
from workload.oracles import with_ctes

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, ctes: list[str] | None = None, sql: str | None = None):
    """Register a function of :class:`Tables`; ``sql`` is its oracle body after ``ctes``."""

    def wrap(fn: Callable[[Tables], object]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(ctes or [], sql)
        return fn

    return wrap
