"""Session roll-ups: sizes, tokens, compactions, titles, environment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.entry_text import TALK, display, with_texts
from threadloom.functions.text import first_line, smart_truncate
from threadloom.operators.calls import is_dispatch
from threadloom.operators.ordered import previous_value, running_count

_STAMPED = [*TALK, "system"]


def turn_input(usage: Column) -> Column:
    return usage["input"] + usage["cache_creation"] + usage["cache_read"]


def _count_blocks(test) -> Column:
    calls = F.filter("blocks", lambda b: (b["type"] == "tool_use") & test(b["tool_name"]))
    return F.when(F.col("entry_type") == "assistant", F.coalesce(F.size(calls), F.lit(0))).otherwise(0)


def first_by_line(value: Column | str, when: Column | None = None) -> Column:
    order = F.col("line_no") if when is None else F.when(when, F.col("line_no"))
    return F.min_by(value, order)


def last_by_line(value: Column | str, when: Column | None = None) -> Column:
    order = F.col("line_no") if when is None else F.when(when, F.col("line_no"))
    return F.max_by(value, order)


def stats_columns() -> dict[str, Column]:
    """Aggregates of one transcript; time runs from the first to the last entry in file order."""
    spent = turn_input(F.col("usage"))
    used = (F.col("entry_type") == "assistant") & F.col("usage").isNotNull()
    timed = F.col("entry_type").isin(*_STAMPED, "queue_operation")
    zero = lambda c: F.coalesce(c, F.lit(0))
    first, last = first_by_line("ts", timed), last_by_line("ts", timed)
    span = F.unix_micros(last) - F.unix_micros(first)
    return {
        "context_tokens": zero(last_by_line(spent, used & (spent > 0))),
        "input_tokens": zero(F.sum(F.when(used, spent))),
        "output_tokens": zero(F.sum(F.when(used, F.col("usage")["output"]))),
        "tool_use_count": zero(F.sum(_count_blocks(lambda n: n.isNotNull()))),
        "agent_count": zero(F.sum(_count_blocks(is_dispatch))),
        # Whole milliseconds, cut toward zero; null when both ends are the same instant.
        "duration_ms": F.when(span != 0, (span / 1000).cast("bigint")),
    }


def transcript_stats(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    return entries.groupBy(*(by or ["file_path"])).agg(
        *[c.alias(n) for n, c in stats_columns().items()]
    )


def compactions(entries: DataFrame) -> DataFrame:
    """Drops of the context by more than 30 % from the previous non-empty turn above 10,000 tokens."""
    used = entries.where((F.col("entry_type") == "assistant") & F.col("usage").isNotNull()).select(
        *[c for c in ("project", "session_id", "agent_id") if c in entries.columns],
        "file_path", "line_no", turn_input(F.col("usage")).alias("to_tokens"),
    )
    turns = running_count(used, ["file_path"], "line_no", "turn")
    real = F.when(F.col("to_tokens") > 0, F.col("to_tokens"))
    chained = previous_value(turns, ["file_path"], "line_no", real, "from_tokens")
    return chained.where(
        (F.col("to_tokens") > 0)
        & (F.col("from_tokens") > V.COMPACTION_MIN_TOKENS)
        & (F.col("to_tokens") < F.col("from_tokens") * V.COMPACTION_KEEP_RATIO)
    ).withColumn("drop_pct", (1 - F.col("to_tokens") / F.col("from_tokens")) * 100)


def _headline() -> Column:
    said = F.col("substantive_text")
    return F.when((F.col("entry_type") == "human") & (F.coalesce(said, F.lit("")) != ""), first_line(said))


def session_titles(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First line of the first substantive human turn, cut at a word near 60 characters."""
    keys = by or ["session_id"]
    rows = entries if "substantive_text" in entries.columns else with_texts(entries)
    line = _headline()
    picked = rows.groupBy(*keys).agg(first_by_line(line, line.isNotNull()).alias("_line"))
    return picked.select(
        *keys,
        F.coalesce(smart_truncate(F.col("_line"), V.TITLE_CHARS), F.lit(V.EMPTY_TITLE)).alias("title"),
    )


def session_summary(entries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per session from its main transcript, in a single aggregation.

    Sessions without any visible message have no row.
    """
    keys = keep or ["project", "session_id"]
    rows = entries.where(F.col("agent_id").isNull())
    rows = rows if "substantive_text" in rows.columns else with_texts(rows)
    rows = rows.withColumn("_shown", F.when(F.col("entry_type").isin("human", "assistant"), display() != ""))
    line = _headline()
    shown = F.coalesce("_shown", F.lit(False))
    mine = shown & (F.col("entry_type") == "human") & ~F.col("origin").isin("teammate", "interrupt")
    stamped = F.col("entry_type").isin(_STAMPED)
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    out = rows.groupBy(*keys).agg(
        F.count_if(shown).alias("message_count"),
        F.count_if(mine).alias("user_turns"),
        first_by_line("ts", stamped).alias("first_ts"),
        first_by_line("team_name", stamped & named("team_name")).alias("team"),
        first_by_line("agent_name", stamped & named("agent_name")).alias("team_role"),
        first_by_line(line, line.isNotNull()).alias("_line"),
        *[c.alias(n) for n, c in stats_columns().items()],
    )
    return out.where(F.col("message_count") > 0).withColumn(
        "title", F.coalesce(smart_truncate(F.col("_line"), V.TITLE_CHARS), F.lit(V.EMPTY_TITLE))
    ).drop("_line")


def date_filter(sessions: DataFrame, after: datetime | None, before: datetime | None) -> DataFrame:
    """Sessions by their first timestamp, inclusive at both ends."""
    if after is not None:
        sessions = sessions.where(F.col("first_ts") >= F.lit(after))
    if before is not None:
        sessions = sessions.where(F.col("first_ts") <= F.lit(before))
    return sessions


def exclude_session(rows: DataFrame, session_id: str | None) -> DataFrame:
    return rows if session_id is None else rows.where(F.col("session_id") != session_id)


def list_sessions(
    sessions: DataFrame, min_messages: int = V.MIN_MESSAGES, min_tools: int = 0, min_agents: int = 0,
    after: datetime | None = None, before: datetime | None = None, agents: DataFrame | None = None,
    current: str | None = None,
) -> DataFrame:
    """Session rows that pass the filters, newest first. `agents` holds agents_present per session;
    the join is planned only when it is given."""
    if min_agents and agents is None:
        raise ValueError("min_agents needs the frame of agents per session")
    rows = sessions.where(
        (F.col("message_count") >= min_messages) & (F.col("tool_use_count") >= min_tools)
    )
    if agents is not None:
        rows = rows.join(agents, "session_id", "left").withColumn(
            "agents_present", F.coalesce("agents_present", F.lit(0))
        ).where(F.col("agents_present") >= min_agents)
    rows = date_filter(rows, after, before)
    return rows.withColumn("is_current", F.col("session_id") == F.lit(current or "")).orderBy(
        F.desc_nulls_last("first_ts"), "session_id"
    )


def first_user_text(rows: DataFrame, by: list[str]) -> DataFrame:
    """First substantive human text, else the first team mate's message."""
    said = F.coalesce(F.col("substantive_text"), F.lit("")) != ""
    tm = F.col("teammate")
    dm = F.btrim(F.concat(F.lit("[teammate: "), tm["teammate_id"], F.lit("] "), tm["body"]), F.lit(V.WHITESPACE))
    return rows.where(F.col("entry_type") == "human").groupBy(*by).agg(
        F.coalesce(first_by_line("substantive_text", said), first_by_line(dm, tm.isNotNull()), F.lit("")).alias("first_user_text")
    )


def last_assistant_text(rows: DataFrame, by: list[str]) -> DataFrame:
    text = F.btrim("body_text", F.lit(V.WHITESPACE))
    return rows.where((F.col("entry_type") == "assistant") & (text != "")).groupBy(*by).agg(
        last_by_line(text).alias("last_assistant_text")
    )


def model_stats(entries: DataFrame, by: list[str]) -> DataFrame:
    """First and last model and the count of each; one row per (group, model) meets the map."""
    rows = entries.where((F.col("entry_type") == "assistant") & (F.coalesce("model", F.lit("")) != ""))
    per = rows.groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("_lo"), F.max("line_no").alias("_hi")
    )
    return per.groupBy(*by).agg(
        F.min_by("model", "_lo").alias("first_model"),
        F.max_by("model", "_hi").alias("last_model"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("counts"),
    )


def environment(entries: DataFrame, by: list[str], as_of: datetime) -> DataFrame:
    """First folder, branch and version, last timestamp and whole days since then."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = entries.where(F.col("entry_type").isin(TALK))
    out = rows.groupBy(*by).agg(
        first_by_line("cwd", some("cwd")).alias("original_cwd"),
        first_by_line("git_branch", some("git_branch")).alias("original_branch"),
        first_by_line("version", some("version")).alias("version"),
        last_by_line("ts").alias("last_ts"),
    )
    seconds = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("last_ts")
    return out.withColumn("age_days", F.floor(seconds / 86400))


def custom_titles(lines: DataFrame) -> DataFrame:
    """Distinct custom titles per project folder."""
    title = F.from_json("value", "type STRING, customTitle STRING")
    return (
        lines.where(F.contains("value", F.lit('"custom-title"'))).select("project", title.alias("t"))
        .where((F.col("t.type") == "custom-title") & F.col("t.customTitle").isNotNull())
        .select("project", F.col("t.customTitle").alias("title")).distinct()
    )
