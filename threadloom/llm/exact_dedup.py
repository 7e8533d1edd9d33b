"""Exact dedup: group by a 128-bit content hash, then compare bytes inside the groups.

Native DataFrame operations only. Hashes and ids alone are grouped over all rows, with partial
aggregation, so a group that holds a third of all rows is one row per map task. What hashes of two or
more rows say is one narrow table. It is joined back to the rows as they are scanned: broadcast while
it is small, else by a plain left join, whose hot keys the adaptive planner splits. Bytes are compared
by grouping rows with such a hash by hash and text; map tasks fold equal texts before they are
shuffled, so no text moves more than once a map task, and texts of single rows do not move at all.
Where one hash has several texts (a collision), its rows take what their own text's group says.

Defined results: a null text counts as the empty text. A row without an id is never dropped and
joins no group (keep_id null, size 1). Rows with equal text and equal id are one document: they
share their flags. Rows with equal ids and different texts are judged each by its own text. Columns
other than id and text are only carried along, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.sized import checked
from threadloom.session import cut_lineage


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _judged(rows: DataFrame, digest: Callable[[Column], Column], keep: Callable[[Column], Column]) -> DataFrame:
    """rows (id, text, and any others) with hash, keep_id and n: what the group of the row's text says; null for a
    text that no other row has, and for rows without an id."""
    rows = rows.withColumn("hash", digest(F.col("text")))
    named = rows.where("id IS NOT NULL")
    groups = named.groupBy("hash").agg(keep("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = checked(cut_lineage(groups.where("n > 1")))
    texts = named.select("id", "text", "hash").join(groups.select("hash"), "hash", "left_semi").groupBy("hash", "text").agg(
        keep("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    several = cut_lineage(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash"))
    if several.isEmpty():
        return _told(rows, groups, ["hash"])
    several = checked(several)
    own = cut_lineage(texts.join(several, "hash", "left_semi"))
    apart = _told(rows.join(several, "hash", "left_semi"), own, ["hash", "text"])
    return _told(rows.join(several, "hash", "left_anti"), groups, ["hash"]).unionByName(apart)


def _told(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    told = rows.join(groups, on, "left").select(*rows.columns, "keep_id", "n")
    named = F.col("id").isNotNull()
    return told.withColumn("keep_id", F.when(named, F.col("keep_id"))).withColumn("n", F.when(named, F.col("n")))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = content_hash, keep: Callable[[Column], Column] = F.max,
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    keep: aggregate that picks the id that stays (largest by default; F.min keeps the smallest).
    """
    rows = _judged(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), digest, keep)
    stays = F.coalesce("keep_id", "id")
    return rows.select(
        F.col("id").alias(id_col), stays.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("id") == stays, F.lit(True)).alias("kept"), F.sha2("text", 256).alias("text_sha256"))


def survivors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = content_hash, keep: Callable[[Column], Column] = F.max,
) -> DataFrame:
    """The rows of `docs`, all columns, that stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), whole)
    return _judged(rows, digest, keep).where(F.coalesce(F.col("id") == F.col("keep_id"), F.lit(True))).select("row.*")
