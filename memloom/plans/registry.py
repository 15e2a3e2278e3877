"""Names of queries, filled by the decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL that is too slow on whole tables; tests hold the queries against it on the smallest ones.
SMALL_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, small: bool = False):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with DuckDB SQL for its rows; small: for tests only."""

    def add(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        if sql is not None:
            (SMALL_ORACLES if small else ORACLES)[make.__name__] = sql
        return make

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
