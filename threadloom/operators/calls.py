"""Tool calls paired with their results, and what follows from the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.functions.fence import fenced
from threadloom.functions.tools import (
    failure_kind, input_one_line, tool_server, tool_short_name,
)
from threadloom.operators.ordered import lookup

#: More than any place in a message, which is an array index; a line number past 2**32 fails instead of wrapping.
CALL_STRIDE = 1 << 31


def call_number(line_no: Column, pos: Column) -> Column:
    """Order of a call within its transcript: line first, then place in the message."""
    return line_no * CALL_STRIDE + pos


def uses(entries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    keep = keep or [c for c in ("project", "file_path", "session_id", "agent_id") if c in entries.columns]
    return (
        entries.where(F.col("entry_type") == "assistant")
        .select(*keep, "line_no", "ts", F.explode("blocks").alias("b"))
        .where(F.col("b.type") == "tool_use")
        .select(*keep, "line_no", F.col("b.pos").alias("pos"), "ts", "b.tool_use_id", "b.tool_name", "b.input_json")
    )


def results(entries: DataFrame) -> DataFrame:
    """First result per (transcript, call id) in file order, wherever the call stands."""
    found = (
        entries.where(F.col("entry_type") == "tool_result")
        .select("file_path", "line_no", F.explode("blocks").alias("b"))
        .where(F.col("b.type") == "tool_result")
    )
    first = F.min_by(
        F.struct(F.col("b.text").alias("result_text"), F.coalesce("b.is_error", F.lit(False)).alias("is_error")),
        F.struct("line_no", "b.pos"),
    )
    return (
        found.groupBy("file_path", F.col("b.tool_use_id").alias("tool_use_id")).agg(first.alias("r"))
        .select("file_path", "tool_use_id", "r.result_text", "r.is_error", F.lit(True).alias("has_result"))
    )


def pair_tool_calls(entries: DataFrame) -> DataFrame:
    """Every call with its result or none; the table `tool_calls`."""
    paired = lookup(uses(entries), results(entries), ["file_path", "tool_use_id"])
    named = paired.withColumns({
        "has_result": F.coalesce("has_result", F.lit(False)),
        "is_error": F.coalesce("is_error", F.lit(False)),
        "call_no": call_number(F.col("line_no"), F.col("pos")),
        "server": tool_server(F.col("tool_name")),
        "short_name": tool_short_name(F.col("tool_name")),
    })
    # The gate comes first: only flagged results are classified.
    return fenced(named, F.when(F.col("is_error"), failure_kind(F.col("result_text"))).alias("kind"))


def tool_counts(calls: DataFrame, by: list[str], name: str = "short_name") -> DataFrame:
    return calls.groupBy(*by, name).agg(F.count(F.lit(1)).alias("calls"))


def audit_rows(calls: DataFrame, name_filter: str | None = None, truncate: int = 80) -> DataFrame:
    """One row per call: time (UTC), tool, input on one line, error flag and text.

    An error is a flagged failure or a success that reads like an empty search.
    """
    rows = calls
    if name_filter:
        rows = rows.where(F.contains("tool_name", F.lit(name_filter)))
    text = F.col("result_text")
    error = F.col("has_result") & (F.col("is_error") | X.looks_like_no_match(text))
    told = X.cut_ellipsis(X.collapse_ws(text, truncate + 1), truncate) if truncate else X.collapse(text)
    return rows.select(
        *[c for c in ("project", "session_id", "agent_id", "file_path") if c in rows.columns],
        "call_no",
        F.coalesce(F.date_format("ts", "HH:mm:ss"), F.lit(" " * 8)).alias("time_utc"),
        F.col("short_name").alias("tool"),
        input_one_line(F.col("input_json"), truncate).alias("input_summary"),
        error.alias("error"),
        F.when(error, told).alias("error_text"),
    )


def tool_audit(calls: DataFrame, by: list[str], name_filter: str | None = None) -> DataFrame:
    """Calls, filtered rows and errors per transcript; counts per tool are never filtered."""
    shown = F.contains("tool_name", F.lit(name_filter)) if name_filter else F.lit(True)
    error = shown & F.col("has_result") & (F.col("is_error") | X.looks_like_no_match(F.col("result_text")))
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(shown).alias("rows"),
        F.count_if(error).alias("errors"),
        F.count_distinct("short_name").alias("tools"),
    )


def audit_coverage(calls: DataFrame, agents: DataFrame, name_filter: str | None = None) -> DataFrame:
    """One row: agents present, agents with calls to audit, and the calls, rows and errors of all of them.

    `agents` has one row per agent (session_id, agent_id).
    """
    by = ["session_id", "agent_id"]
    audited = tool_audit(calls, by, name_filter).withColumn("audited", F.lit(1))
    rows = agents.select(*by).distinct().join(audited, by, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("agents_present"), total("audited").alias("agents_audited"),
        total("calls").alias("calls"), total("rows").alias("rows"), total("errors").alias("errors"),
    )


def is_dispatch(name: Column) -> Column:
    return name.isin(V.DISPATCH_TOOLS)
