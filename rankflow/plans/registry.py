"""Name -> (query, correctness SQL). Each plan module registers its operators here."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rankflow.plans.views import new_query

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``oracle`` it is checked by property tests only."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            new_query()
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def load_all() -> None:
    from rankflow.plans import data, evaluation, personal, ranking, text, vector  # noqa: F401
