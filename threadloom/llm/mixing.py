"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by (source, hash bucket) in a narrow table. A source's target is some whole
epochs plus a remainder; the remainder is the documents whose hash lies below a threshold. The
histogram shows in which bucket the running sum passes the remainder; only that bucket is split
again, by the next bits of the hash, until a bucket is one hash. Documents are then filtered by
comparison with their source's threshold: no sort of documents, and a larger remainder takes a
superset of what a smaller one takes. Hot sources only add to sums, which map tasks make first.

Defined results: a null or empty text has size 0; a null source is a source, the last one; equal
ids (and null ids) share a hash and are taken together. The threshold falls on the side of the last
document that comes nearer to the target. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.quality import words
from threadloom.session import cut_lineage

HASH_BITS = 48
#: Bits of the hash that each histogram resolves.
STEP_BITS = 12
MAX_EPOCHS = 3
#: Sources up to which the thresholds are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def place(id_col: Column) -> Column:
    """48 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.size(words(F.coalesce(F.col(text_col), F.lit("")))).cast("bigint")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn("place", place(F.col("id")))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources weigh `weights` in turn, in code point order, null last. All targets together are the sum of all
    sizes; none exceeds MAX_EPOCHS times its source. A target is weight * level or that cap: in order of
    cap / weight, the level follows from what the sources before have taken. One row per source meets here.
    """
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", MAX_EPOCHS * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(total) - before) / left)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(total)["level"]
    return s.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: epochs (whole passes) and below (documents with a smaller place are taken once more)."""
    n = F.col("source_size")
    epochs = F.when(n > 0, F.floor(F.col("target") / n)).otherwise(0)
    state = goals.withColumn("epochs", epochs.cast("bigint")).withColumn("rest", F.col("target") - F.col("epochs") * n)
    # low: places below are taken for certain; prefix: the resolved leading bits of the boundary bucket.
    state = cut_lineage(state.select(F.col("source").alias("s"), "epochs", "rest", F.lit(0).cast("bigint").alias("prefix")))
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        width = 1 << STEP_BITS
        inside = rows.join(state.where("rest > 0"), F.col("source").eqNullSafe(F.col("s"))).where(
            F.shiftright("place", bits + STEP_BITS) == F.col("prefix"))
        sums = inside.groupBy("s", F.shiftright("place", bits).alias("bucket")).agg(F.sum("size").alias("n"), F.any_value("rest").alias("rest"))
        run = Window.partitionBy("s").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(run))
        edge = sums.where("upto > rest").groupBy("s").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "upto"), "bucket").alias("e"))
        edge = edge.withColumnRenamed("s", "t").withColumn("hit", F.lit(True))
        hit, taken = F.col("hit").isNotNull(), F.col("e.before")
        # Without a bucket that passes the rest, all of this range is taken.
        beyond = F.when(F.col("rest") > 0, (F.col("prefix") + 1) * width).otherwise(F.col("prefix") * width)
        bucket = F.when(hit, F.col("e.bucket")).otherwise(beyond)
        if bits == 0:
            nearer = hit & (F.col("e.upto") - F.col("rest") < F.col("rest") - taken)
            bucket = bucket + F.when(nearer, 1).otherwise(0)
        rest = F.when(hit, F.col("rest") - taken).otherwise(0)
        state = cut_lineage(state.join(edge, F.col("s").eqNullSafe(F.col("t")), "left").select(
            "s", "epochs", rest.alias("rest"), bucket.cast("bigint").alias("prefix")))
    return state.select("s", "epochs", F.col("prefix").alias("below"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): the narrow rows id, source, size, place; and per source s, source_size, target, epochs, below."""
    rows = cut_lineage(sized(docs, id_col, text_col, source_col))
    goals = cut_lineage(targets(rows, weights))
    marks = thresholds(rows, goals)
    return rows, cut_lineage(goals.join(marks, F.col("source").eqNullSafe(F.col("s"))).drop("source"))


def times() -> Column:
    return (F.col("epochs") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)).cast("int")


def _with_sources(rows: DataFrame, sources: DataFrame, source_col: str = "source") -> DataFrame:
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    return rows.join(sources, rows[source_col].eqNullSafe(sources["s"]), "left")


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target and taken (words, repeats counted)."""
    rows, sources = plan(docs, id_col, **options)
    return _with_sources(rows, sources).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it."""
    _, sources = plan(docs, id_col, source_col=source_col, **options)
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), place(F.col(id_col)).alias("place"), F.col(source_col).alias("source"))
    often = _with_sources(whole, sources).select("row", F.explode(F.when(times() > 0, F.sequence(F.lit(1), times())).otherwise(F.array().cast("array<int>"))))
    return often.select("row.*")
