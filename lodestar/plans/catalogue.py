"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import answers, mounts, phrases, records, state, stores, streams, texts
from lodestar.plans.base import bind, oracle
from lodestar.plans.views import VIEWS

MODULES = [state, records, texts, answers, stores, streams, mounts, phrases]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(q, VIEWS) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, q in m.QUERIES.items() if (sql := oracle(q, VIEWS)) is not None}
