"""Every operator as a query over the test tables, with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of the fixtures; sql may name the fixture views."""

    def put(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return put


from tessera.queries import access, graph, messages, models, mutate, ranking, render, streams, text, tools, vectors  # noqa: E402, F401
