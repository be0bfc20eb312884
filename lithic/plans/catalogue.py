"""All named queries, each with the SQL that an independent engine can check it by."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithic.plans.dialect import DUCK, SPARK, Spark
from lithic.sources import relations

Query = Callable[[SparkSession, relations.Source], DataFrame]
Body = Callable[[Spark], str]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}
_MODULES = ("search", "binding", "resolution", "nesting", "postings", "graphs", "aggregates", "windows", "scalars", "projects", "rules", "changes", "feeds", "extraction", "editing")


def query(name: str, sql: str | None = None):
    """Registers a function (spark, source) -> DataFrame under a name, beside its SQL."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _oracle[name] = sql
        return f

    return add


def both(name: str, *needs: str):
    """Registers a query from one body(dialect) -> SQL over the relations it needs, for Spark and as its own oracle. It runs on a
    folder of tables or on relations of a source tree."""

    def add(body: Body) -> Body:
        query(name, relations.with_ctes(body(DUCK), DUCK, needs))(lambda spark, source: relations.run(spark, source, body(SPARK), needs))
        return body

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"lithic.operators.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)
