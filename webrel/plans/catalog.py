"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus the DuckDB
oracle SQL for each (see ``__spark_entry__``).

Outputs are flat scalar columns with fixed names; integers are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def big(c) -> "F.Column":
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


def load_all() -> None:
    """Import the modules that register queries."""
    from webrel.plans import q_changes, q_crawl, q_dom, q_entities, q_hits, q_profiles, q_record, q_render, q_requests, q_rules, q_text  # noqa: F401
