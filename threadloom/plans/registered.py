"""All registered queries. Timestamps in derived logs are UTC, and so are all labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans import conversations, events, files, reviews, stores

_MODULES = [conversations, events, stores, reviews, files]


def _in_utc(run: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return run(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _in_utc(run) for m in _MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.ORACLES.items()}
