"""Debates: live moves per round, and how a debate ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V


def live_moves(moves: DataFrame) -> DataFrame:
    """Withdrawals, updates and disputes per run and round; rounds without any count as zero."""
    return moves.groupBy("run_id", "round").agg(
        F.count_if(F.col("move_type").isin(V.LIVE_MOVES)).alias("live_moves")
    )


def end_state(moves: DataFrame) -> DataFrame:
    """Quiet after the first round without a live move; otherwise capped at the bound, or open after the last round."""
    quiet = F.min(F.when(F.col("live_moves") == 0, F.col("round")))
    last = F.max("round")
    return live_moves(moves).groupBy("run_id").agg(
        F.when(quiet.isNotNull(), "quiet").when(last >= V.MAX_ROUNDS, "capped").otherwise("open").alias("state"),
        F.coalesce(quiet, F.least(last, F.lit(V.MAX_ROUNDS))).alias("after_round"),
    )
