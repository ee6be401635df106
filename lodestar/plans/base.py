"""Queries over the driver's tables: each has a Spark plan and, where SQL can say it, the same in DuckDB's SQL.

The engine's own tables (files, jobs, projects and so on) are views over the driver's tables. A view is a list of
expressions that both engines read alike (or a pair, where they do not), so plan and SQL start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.tables import read_table


@dataclass(frozen=True)
class View:
    table: str
    columns: dict[str, str | tuple[str, str]]
    where: str | None = None

    def sql(self) -> str:
        named = ", ".join(f"{e if isinstance(e, str) else e[1]} AS {n}" for n, e in self.columns.items())
        return f"SELECT {named} FROM {self.table}" + (f" WHERE {self.where}" if self.where else "")

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read_table(spark, sf_dir, self.table)
        rows = rows.where(self.where) if self.where else rows
        return rows.selectExpr(*[f"{e if isinstance(e, str) else e[0]} AS {n}" for n, e in self.columns.items()])


@dataclass(frozen=True)
class Query:
    """plan takes one DataFrame per view; sql refers to the views by name."""

    views: tuple[str, ...]
    plan: Callable[..., DataFrame]
    sql: str | None = None


def bind(query: Query, views: dict[str, View]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.plan(*[views[v].frame(spark, sf_dir) for v in query.views])

    return run


def oracle(query: Query, views: dict[str, View]) -> str | None:
    if query.sql is None:
        return None
    ctes = ", ".join(f"{v} AS ({views[v].sql()})" for v in query.views)
    body = query.sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes}, {body[len(start) :]}"
    return f"WITH {ctes} {body}"
