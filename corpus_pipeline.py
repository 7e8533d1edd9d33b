"""A corpus pipeline over `documents`: quality rules, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and is written as
Parquet and read again before the next one. All but the last return the columns of documents.

Defined results: a null text counts as empty, so quality rules reject it, and it is a group of equal texts for exact dedup.
A row without an id is judged by quality rules like any other and never dropped as a copy. Rows that share id and text
stay together, rows that share an id alone are judged each by its own text in quality rules and exact dedup, and stay or go
together in near-dedup. Further columns are carried along under any name, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from threadloom.llm.queries import table, vocabulary_path
from threadloom.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the likelihood ratio keep."""
    weights = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.survivors(docs, weights)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return near_dedup.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the ids of each row and of the text they decode to."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", tokens)]

#: No stage but the second can be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
