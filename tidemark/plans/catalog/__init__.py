"""Every operator as a query over the given tables, with its SQL twin where SQL can express it."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.catalog import sql as twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str | None = None, sql: str | None = None):
    """Register `(spark, sf_dir) -> DataFrame`; `sql` is the body of the DuckDB twin."""
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            TWINS[key] = twin.compose(sql)
        return function

    return register


def load() -> None:
    from tidemark.plans.catalog import detection, evaluation, explanation, ingestion, injection, streams, vectors  # noqa: F401
