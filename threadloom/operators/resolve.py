"""Ids and prefixes to sessions and agents; prefixes stay at this edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.ids import id_matches

def _by_prefix(rows: DataFrame, wanted: DataFrame, column: str, min_len: int = 1) -> DataFrame:
    """Rows whose id equals a raw id, starts with it, or (being short) is its start.

    Both directions are equi-joins: an id is cut at the few lengths that raw ids have, and a raw
    id is cut at every length.
    """
    wanted = wanted.where(F.length("raw_id") >= min_len)
    sizes = [r[0] for r in wanted.select(F.least(F.length("raw_id"), F.lit(V.FULL_ID)).alias("n")).distinct().collect()]
    if not sizes:
        sizes, wanted = [1], wanted.where(F.lit(False))
    cuts = F.array_distinct(F.array(*[F.substring(F.col(column), 1, n) for n in sorted(sizes)]))
    key = F.substring("raw_id", 1, V.FULL_ID)
    down = rows.withColumn("_k", F.explode(cuts)).join(wanted.withColumn("_k", key), "_k")
    down = down.where(id_matches(F.col(column), F.col("raw_id"))).drop("_k")
    longer = wanted.where(F.length("raw_id") > 1).withColumn(
        "_k", F.explode(F.transform(F.sequence(F.lit(1), F.length("raw_id") - 1), lambda n: F.substr("raw_id", F.lit(1), n)))
    )
    short = rows.where((F.length(column) < V.FULL_ID) & (F.col(column) != "")).withColumn("_k", F.col(column))
    up = short.join(longer, "_k").drop("_k")
    return down.unionByName(up)


def narrow_to_ids(rows: DataFrame, wanted: DataFrame, column: str = "session_id") -> DataFrame:
    """Rows whose id is named in full or by a prefix; adds the caller's columns."""
    return _by_prefix(rows, wanted, column)


def narrow_to_artifact_ids(transcripts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sessions that are named, or that hold an agent that is named."""
    files = transcripts.select("session_id", "agent_id")
    sessions = narrow_to_ids(files.select("session_id").distinct(), wanted).select("session_id")
    agents = files.where(F.col("agent_id").isNotNull()).distinct()
    holders = _by_prefix(agents, wanted, "agent_id", V.MIN_ID).where(
        F.startswith("agent_id", F.col("raw_id"))
    ).select("session_id")
    return sessions.unionByName(holders).distinct()


def not_found(wanted: DataFrame, found: DataFrame) -> DataFrame:
    return wanted.join(found.select("raw_id").distinct(), "raw_id", "left_anti")


def resolve_sessions(wanted: DataFrame, sessions: DataFrame) -> DataFrame:
    """Status per raw id: unique, ambiguous or not_found, with the number of distinct full ids.

    `sessions` has session_id, project and message_count: empty sessions are ignored when they
    are what makes a prefix ambiguous.
    """
    found = narrow_to_ids(sessions, wanted)
    per_id = found.groupBy("raw_id", "session_id").agg(
        F.max("message_count").alias("_m"), F.min("project").alias("_p")
    )
    full = F.col("_m") > 0
    counted = per_id.groupBy("raw_id").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(full).alias("_real"),
        F.min("session_id").alias("_any"),
        F.min(F.when(full, F.col("session_id"))).alias("_one"),
        F.min(F.when(full, F.col("_p"))).alias("_first_project"),
        F.max(F.when(full, F.col("_p"))).alias("_last_project"),
    )
    n = F.when(F.col("_all") == 1, 1).otherwise(F.col("_real"))
    return wanted.join(counted, "raw_id", "left").select(
        *wanted.columns,
        F.coalesce(n, F.lit(0)).alias("candidates"),
        F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("not_found").alias("status"),
        F.when(n == 1, F.when(F.col("_all") == 1, F.col("_any")).otherwise(F.col("_one"))).alias("session_id"),
    )


def resolve_artifacts(wanted: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Kind, full id and status of each raw id over sessions and agents together."""
    sessions = transcripts.select(F.col("session_id").alias("full_id"), F.lit("session").alias("kind")).distinct()
    agents = transcripts.where(F.coalesce("agent_id", F.lit("")) != "").select(
        F.col("agent_id").alias("full_id"), F.lit("subagent").alias("kind")
    ).distinct()
    found = _by_prefix(sessions.unionByName(agents), wanted, "full_id", V.MIN_ID)
    counted = found.groupBy("raw_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min(F.struct("kind", "full_id")).alias("_one"),
    )
    short = F.length("raw_id") < V.MIN_ID
    n = F.coalesce("candidates", F.lit(0))
    return wanted.join(counted, "raw_id", "left").select(
        *wanted.columns,
        n.alias("candidates"),
        F.when(short, "too_short").when(n == 0, "not_found").when(n == 1, "unique").otherwise("ambiguous").alias("status"),
        F.when(n == 1, F.col("_one.kind")).alias("kind"),
        F.when(n == 1, F.col("_one.full_id")).alias("full_id"),
    )
