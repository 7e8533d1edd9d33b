"""The failure survey: which calls failed, how, where, and what no rule names."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.entry_text import has_failure
from threadloom.functions.text import collapse_ws
from threadloom.operators.ordered import matching
from threadloom.session import cut_lineage
from threadloom.functions.tools import FAILURE_KINDS, canonical_server, chosen, failure_category

ORDER = ["project", "session_id", "agent_id", "line_no", "pos"]


def scope(calls: DataFrame, after: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """Calls of files that can hold a failure, in the half-open window."""
    # On the calls table the raw-text prefilter is the same question asked of a column.
    if after is not None:
        calls = calls.where(F.col("ts") >= F.lit(after))
    if before is not None:
        calls = calls.where(F.col("ts") < F.lit(before))
    return calls


def error_files(entries: DataFrame) -> DataFrame:
    """Transcripts that hold a flagged result, whether or not a call claims it, and their sessions."""
    return entries.where(has_failure(F.col("blocks"))).select("session_id", "file_path").distinct()


def in_error_files(calls: DataFrame, files: DataFrame) -> DataFrame:
    return matching(calls, files, ["file_path"])


def _order() -> Column:
    return F.struct(
        F.coalesce("project", F.lit("")), "session_id", F.coalesce("agent_id", F.lit("")), "line_no", "pos"
    )


@dataclass
class Survey:
    """The frames of one survey; each is an aggregate over the same scoped calls."""

    totals: DataFrame
    by_kind: DataFrame
    by_tool: DataFrame
    by_session: DataFrame
    unclassified: DataFrame


def survey(
    calls: DataFrame, after: datetime | None = None, before: datetime | None = None,
    kinds: str | None = None, include_cascade: bool = False, examples: bool = False,
    files: DataFrame | None = None,
) -> Survey:
    wanted = chosen(kinds, FAILURE_KINDS)
    keep_cascade = include_cascade or "cascade" in wanted
    if files is None:
        files = calls.where(F.col("is_error")).select("session_id", "file_path").distinct()
    scanned = scope(in_error_files(calls, files), after, before)
    suppressed = F.lit(False) if keep_cascade else F.col("kind") == "cascade"
    counted = F.col("is_error") & ~suppressed
    if wanted:
        counted = counted & F.col("kind").isin(sorted(wanted))
    failed = scanned.where(counted)
    return Survey(
        totals=totals(scanned, counted, F.col("is_error") & suppressed, files),
        by_kind=by_kind(failed, examples),
        by_tool=by_tool(scanned, counted),
        by_session=by_session(failed),
        unclassified=unclassified_shapes(failed, examples),
    )


def totals(scanned: DataFrame, counted: Column, suppressed: Column, files: DataFrame) -> DataFrame:
    """Counts of failed calls, and of every file that was scanned for them, whether or not it has one to count."""
    flagged = scanned.select(
        "session_id", "file_path",
        F.when(counted, 1).otherwise(0).alias("_c"),
        F.when(suppressed, 1).otherwise(0).alias("_s"),
        F.when(counted & (F.col("kind") == V.UNCLASSIFIED[0]), 1).otherwise(0).alias("_u"),
    )
    # Per file first: the distinct counts then run over one row per file, not per call.
    per_file = flagged.groupBy("session_id", "file_path").agg(
        F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.sum("_u").alias("_u")
    )
    per_session = per_file.groupBy("session_id").agg(
        F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.sum("_u").alias("_u")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    read = files.groupBy("session_id").agg(F.count(F.lit(1)).alias("_f")).agg(
        F.count(F.lit(1)).alias("sessions_scanned"), zero("_f").alias("transcripts_scanned"))
    counts = per_session.agg(
        zero("_c").alias("total"),
        F.count_if(F.col("_c") > 0).alias("sessions_affected"),
        zero("_u").alias("unclassified_total"),
        zero("_s").alias("cascade_suppressed"),
    )
    # Two one-row frames: one row of both.
    return counts.select("*", *[read.select(c).scalar().alias(c) for c in read.columns])


def _example() -> Column:
    told = F.struct(
        collapse_ws(F.col("result_text"), V.FAILURE_EXAMPLE_CHARS).alias("text"),
        F.col("short_name").alias("tool"),
        F.col("session_id").alias("session"),
        F.col("project").alias("project"),
        F.col("agent_id").alias("agent"),
    )
    return F.min_by(told, _order())


def by_kind(failed: DataFrame, examples: bool = False) -> DataFrame:
    more = [_example().alias("example")] if examples else []
    # Sessions are counted as rows of a second aggregate: no set is ever built in memory.
    per = failed.groupBy("kind", "session_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(_order()).alias("_first"), *more
    )
    again = [F.min_by("example", "_first").alias("example")] if examples else []
    return per.groupBy("kind").agg(
        F.sum("_n").alias("count"), F.count(F.lit(1)).alias("sessions"), *again
    ).withColumn("category", failure_category(F.col("kind")))


def top_kind(failed: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent kind per group; among equals the one seen first."""
    per = failed.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("_n"), F.min(_order()).alias("_first"))
    return per.groupBy(*by).agg(
        F.min_by("kind", F.struct((-F.col("_n")).alias("n"), "_first")).alias("top_kind")
    )


def by_session(failed: DataFrame) -> DataFrame:
    per = failed.groupBy("session_id", "kind").agg(
        F.count(F.lit(1)).alias("_n"), F.min(_order()).alias("_first"),
        F.min("ts").alias("_lo"), F.max("ts").alias("_hi"), F.min("project").alias("_p"),
    )
    return per.groupBy("session_id").agg(
        F.min("_p").alias("project"),
        F.sum("_n").alias("errors"),
        F.min_by("kind", F.struct((-F.col("_n")).alias("n"), "_first")).alias("top_kind"),
        F.min("_lo").alias("first_ts"),
        F.max("_hi").alias("last_ts"),
    ).withColumn("date", F.date_format("first_ts", "yyyy-MM-dd"))


def unclassified_shapes(failed: DataFrame, examples: bool = False) -> DataFrame:
    more = [_example().alias("example")] if examples else []
    shaped = failed.where(F.col("kind") == V.UNCLASSIFIED[0]).withColumn(
        "shape", collapse_ws(F.col("result_text"), V.FAILURE_SHAPE_CHARS)
    )
    per = shaped.groupBy("shape", "session_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(_order()).alias("_first"), *more
    )
    again = [F.min_by("example", "_first").alias("example")] if examples else []
    return per.groupBy("shape").agg(
        F.sum("_n").alias("count"), F.count(F.lit(1)).alias("sessions"), *again
    )


# --- tool identity -----------------------------------------------------------------------------------


def by_tool(scanned: DataFrame, counted: Column) -> DataFrame:
    """Errors, calls and rate per tool, one row per tool however it was spelled.

    Spellings of one server fold together; a bare name folds into the only server that has the
    tool; a short name stays short while it is unambiguous over all tools seen. The frames here
    have one row per spelling and kind, so the joins are over names, not calls.
    """
    rows = scanned.withColumn("_err", counted)
    # Written once: every frame below is read several times, and this one has a row per name and kind.
    spellings = cut_lineage(rows.groupBy("tool_name", "server", "short_name", "kind", "_err").agg(
        F.count(F.lit(1)).alias("_n"), F.min(_order()).alias("_first")
    ))
    spelled = spellings.groupBy("tool_name", "server", "short_name").agg(
        F.sum("_n").alias("calls"), F.min("_first").alias("_first")
    ).withColumn("server_key", canonical_server(F.col("server")))
    merged = spelled.groupBy("server_key", "short_name").agg(
        F.sum("calls").alias("calls"),
        F.min_by("tool_name", F.struct((-F.col("calls")).alias("n"), "_first")).alias("tool_name"),
    )
    servers = merged.where(F.col("server_key").isNotNull()).groupBy("short_name").agg(
        F.count(F.lit(1)).alias("_servers"),
        F.min_by(F.struct("server_key", "tool_name"), "server_key").alias("_twin"),
    )
    bare = F.col("server_key").isNull()
    lone = bare & (F.coalesce("_servers", F.lit(0)) == 1)
    homes = merged.join(servers, "short_name", "left").select(
        "short_name",
        "server_key",
        F.when(lone, F.col("_twin.server_key")).otherwise(F.col("server_key")).alias("home"),
        F.when(lone, F.col("_twin.tool_name")).otherwise(F.col("tool_name")).alias("name"),
    )
    shared = homes.groupBy("short_name").agg(F.count_distinct("name").alias("_rows"))
    named = homes.join(shared, "short_name").select(
        "short_name",
        "server_key",
        F.when(F.col("_rows") == 1, F.col("short_name")).otherwise(F.col("name")).alias("tool"),
    )
    same = (spellings.short_name == named.short_name) & canonical_server(spellings.server).eqNullSafe(named.server_key)
    per_kind = spellings.join(named, same).groupBy("tool", "kind", "_err").agg(
        F.sum("_n").alias("_n"), F.min("_first").alias("_first")
    )
    failed_first = F.when(F.col("_err"), F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f")))
    return per_kind.groupBy("tool").agg(
        F.sum(F.when(F.col("_err"), F.col("_n")).otherwise(0)).alias("errors"),
        F.sum("_n").alias("calls"),
        F.min_by("kind", failed_first).alias("top_kind"),
    ).where(F.col("errors") > 0).withColumn("error_rate", F.bround(F.col("errors") / F.col("calls"), 3))


# --- sections ------------------------------------------------------------------------------------------


def section(rows: DataFrame, count: str, tie: list[str], limit: int) -> DataFrame:
    """The first `limit` rows by count, with the number of rows there are."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(F.desc(count), *tie).limit(limit).withColumn("section_total", total)


def overflow_text(total: Column, limit: int, noun: str, how: str) -> Column:
    """What a section leaves out; null when it shows all."""
    return F.when(total > limit, F.format_string(f"showing {limit} of %d {noun} — {how}", total))


def report(found: Survey, limit: int = 10) -> dict[str, DataFrame]:
    """The survey as sections, most hits first, each with its overflow text."""
    parts = {"by_kind": (found.by_kind, "count", "kind"), "by_tool": (found.by_tool, "errors", "tool"),
             "by_session": (found.by_session, "errors", "session_id"), "unclassified": (found.unclassified, "count", "shape")}
    out = {"totals": found.totals}
    for name, (rows, hits, tie) in parts.items():
        shown = section(rows, hits, [tie], limit)
        out[name] = shown.withColumn("overflow", overflow_text(F.col("section_total"), limit, "rows", "raise the limit"))
    return out
