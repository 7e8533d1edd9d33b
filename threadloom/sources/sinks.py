"""Sinks: sparse JSON rows, pipe-delimited lines, and the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.transcripts import scan_lines


def sparse_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


#: Lines a text file of `write_lines` holds at most.
LINES_PER_FILE = 1_000_000


def write_lines(rows: DataFrame, path: str, column: str = "line", order: list[str] | None = None, parts: int | None = None) -> None:
    """Text files that hold the lines in order: each is a range of it, and their names sort as the ranges do.

    Nothing is gathered: ranges come from a sample, `parts` of them (as many as shuffle partitions by default), and a
    range of many lines becomes several files. Lines are unique in their order, or equal ones stand in any order.
    """
    if order is not None:
        rows = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    rows.select(F.col(column).alias("value")).write.option("maxRecordsPerFile", LINES_PER_FILE).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos (0-based, over all files in order of their names) and value of lines that `write_lines` wrote."""
    return scan_lines(spark, path, suffix="txt", one_text=True).select(F.col("line_no").alias("pos"), "value")


def write_table(rows: DataFrame, path: str) -> None:
    """A canonical table as Parquet below one folder per project.

    Rows are spread by project and line block, so that a project that holds a third of all rows is
    written by many tasks. Within a file of the table they are sorted by session, so that a filter on one skips
    the row groups of others.
    """
    spread = rows.repartition("project", "file_path", F.floor(F.col("line_no") / (1 << 16)))
    spread.sortWithinPartitions("project", "session_id", "file_path", "line_no").write.partitionBy("project").parquet(path)
