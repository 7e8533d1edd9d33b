"""Keeps an expensive expression from being copied and evaluated again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, *fields: Column) -> DataFrame:
    """Adds computed columns through a one-element explode.

    A condition on such a column stays above it. Without the fence the optimizer copies the whole
    chain of regular expressions into every filter and evaluates it again there.
    """
    out = df.withColumn("_f", F.explode(F.array(F.struct(*fields))))
    return out.select(*df.columns, "_f.*")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)
