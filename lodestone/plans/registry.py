"""All registered queries of the code-graph engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.fixtures import CodeGraph, load, oracle

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a CodeGraph under a name, with the DuckDB text that gives the same rows."""

    def add(f: Callable[[CodeGraph], DataFrame]) -> Callable[[CodeGraph], DataFrame]:
        _queries[name] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql is not None:
            _oracles[name] = oracle(sql)
        return f

    return add


def same_sql(name: str, spark_text: str, duck_text: str | None = None) -> None:
    """Registers Spark SQL and its DuckDB form, the same if not given."""
    from lodestone.plans.sqlapi import query as read

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = load(spark, sf_dir)
        g.sql(spark_text)  # registers the views that the text names
        return read(spark, spark_text)

    _queries[name] = run
    _oracles[name] = oracle(duck_text or spark_text)


def _fill() -> None:
    from lodestone.plans import q_graph, q_index, q_ingest, q_lookup, q_metrics, q_sql  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["G01_impact"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _fill()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _fill()
    return dict(_oracles)
