"""Order within a group, without ever gathering a group in one task.

A group (a transcript, a file under review) may hold a third of all rows, so a plain window over
it is out. The order column is a whole number that is unique within its group: `order div BLOCK`
cuts each group into blocks of at most BLOCK rows. Every operator works in two levels. Inside a
block it is an ordinary window over a bounded number of rows; between blocks only one summary row
per block is ordered. The rows are shuffled once, by (group, block); the window leaves them sorted, so the summary is
merged with them. Left to the planner, either side may be broadcast through the driver, by the size of packed files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

BLOCK = 1 << 16
_B = "_block"


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(order) / block).cast("bigint"))


def running_count(
    df: DataFrame, group: list[str], order: str, out: str, counted: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Number of rows up to and including this one for which `counted` holds (all by default)."""
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    rows = _blocked(df, order, block).withColumn("_ord_one", one.cast("bigint"))
    inside = Window.partitionBy(*group, _B).orderBy(order)
    across = Window.partitionBy(*group).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*group, _B).agg(F.sum("_ord_one").alias("_ord_n"))
        .withColumn("_ord_before", F.coalesce(F.sum("_ord_n").over(across), F.lit(0))).drop("_ord_n")
    )
    numbered = rows.withColumn(
        out, F.sum("_ord_one").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.join(blocks.hint("merge"), [*group, _B])
        .withColumn(out, F.col(out) + F.col("_ord_before"))
        .drop(_B, "_ord_one", "_ord_before")
    )


def previous_value(
    df: DataFrame, group: list[str], order: str, value: Column, out: str, block: int = BLOCK,
) -> DataFrame:
    """Last non-null `value` of an earlier row of the group."""
    rows = _blocked(df, order, block).withColumn("_ord_value", value)
    inside = Window.partitionBy(*group, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    tail = F.max_by("_ord_value", F.when(F.col("_ord_value").isNotNull(), F.col(order)))
    blocks = (
        rows.groupBy(*group, _B).agg(tail.alias("_ord_tail"))
        .withColumn("_ord_carried", F.last("_ord_tail", ignorenulls=True).over(across)).drop("_ord_tail")
    )
    return (
        rows.withColumn("_ord_inside", F.last("_ord_value", ignorenulls=True).over(inside))
        .join(blocks.hint("merge"), [*group, _B])
        .withColumn(out, F.coalesce("_ord_inside", "_ord_carried"))
        .drop(_B, "_ord_value", "_ord_inside", "_ord_carried")
    )


def first_rows(df: DataFrame, group: list[str], order: list[Column | str], k: int, rank: str = "_rank") -> DataFrame:
    """The first k rows of each group; every map task keeps at most k per group before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a side with one row per key, where a key may be hot on the left.

    Lazy: no job runs here. The adaptive planner splits a hot key's left rows over tasks, which a
    left join allows, and broadcasts the right side only when its measured size is small.
    """
    return left.join(right, keys, "left")


def matching(left: DataFrame, right: DataFrame, keys: list[str], anti: bool = False) -> DataFrame:
    """Rows of `left` whose key occurs in `right` (or does not); hot keys as in `lookup`."""
    return left.join(right.select(*keys), keys, "left_anti" if anti else "left_semi")


def rank_by_sort(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Exact row numbers within a group of any size, for orders that are no dense number.

    The rows are range-partitioned by group and order and written with their partition number.
    A row's number is its place within its range plus the sizes of the group's earlier ranges.
    """
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    across = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_ord_n")).withColumn(
        "_ord_before", F.coalesce(F.sum("_ord_n").over(across), F.lit(0))
    ).drop("_ord_n")
    return placed.withColumn(out, F.row_number().over(inside)).join(ranges.hint("merge"), ["_range", *group]).withColumn(
        out, F.col(out) + F.col("_ord_before")
    ).drop("_range", "_ord_before")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
