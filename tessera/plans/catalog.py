"""The registry of queries: each Spark plan stands beside an independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.name`` reads a raw table or a binding."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def _bound(sql: str, names: tuple[str, ...]) -> str:
    """The oracle behind the bindings it reads."""
    head = ctes(*names).rstrip()
    if sql.startswith("WITH RECURSIVE "):
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + sql.removeprefix("WITH RECURSIVE ")
    return head + (", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else " " + sql)


def query(key: str, sql: str | None = None, *names: str):
    """Register a plan under ``key``; ``sql`` is its oracle over the named bindings."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = _bound(sql, names) if names else sql
        return f

    return register
