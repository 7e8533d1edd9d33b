"""The activity timeline: who was at work when, on a fixed grid over a half-open window.

One long frame `cells(session_id, bucket, human, agent)` feeds every roll-up. Agents' files fold
into their parent session by carrying its session_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.entry_text import with_texts
from threadloom.functions.ids import id8
from threadloom.functions.text import collapse, smart_truncate
from threadloom.operators.sessions import _headline, first_by_line, last_by_line


@dataclass(frozen=True)
class Window:
    lo: datetime
    hi: datetime
    bucket_minutes: int = V.BUCKET_MINUTES
    tz: str = "UTC"

    @property
    def lo_micros(self) -> int:
        return int(self.lo.timestamp()) * 1_000_000 + self.lo.microsecond

    @property
    def hi_micros(self) -> int:
        return int(self.hi.timestamp()) * 1_000_000 + self.hi.microsecond

    @property
    def bucket_micros(self) -> int:
        return self.bucket_minutes * 60_000_000

    @property
    def buckets(self) -> int:
        """Rounded up, so that a window that is no multiple of the grain keeps its tail."""
        return -(-(self.hi_micros - self.lo_micros) // self.bucket_micros)

    @property
    def days(self) -> int:
        return max(1, round((self.hi_micros - self.lo_micros) / 86_400_000_000))


def resolve_window(
    after: datetime | None, before: datetime | None, as_of: datetime, tz: str = "UTC",
    bucket_minutes: int = V.BUCKET_MINUTES,
) -> Window:
    """Half-open window; naive ends are read in `tz`; by default the seven days before `as_of`."""
    zone = ZoneInfo(tz)
    aware = lambda d: d if d.tzinfo else d.replace(tzinfo=zone)
    hi = aware(before or as_of)
    lo = aware(after) if after else hi - timedelta(days=V.DEFAULT_WINDOW_DAYS)
    return Window(lo.astimezone(timezone.utc), hi.astimezone(timezone.utc), bucket_minutes, tz)


def local_time(bucket: Column, w: Window) -> Column:
    start = F.timestamp_micros(F.lit(w.lo_micros) + bucket * w.bucket_micros)
    return F.from_utc_timestamp(start, w.tz)


def day_label(bucket: Column, w: Window) -> Column:
    return F.date_format(local_time(bucket, w), "E MM-dd HH:mm")


def in_window(w: Window) -> Column:
    micros = F.unix_micros("ts")
    return F.col("ts").isNotNull() & (micros >= w.lo_micros) & (micros < w.hi_micros)


def marked(entries: DataFrame, w: Window) -> DataFrame:
    """In-window entries with their bucket and what they count as.

    `human` is a turn of a person in the main transcript; `marker` names a unit of agent work, and
    equal markers in a bucket count once, also across the files of a session.
    """
    rows = entries if "origin" in entries.columns else with_texts(entries)
    rows = rows.where(in_window(w) & F.col("entry_type").isin("human", "meta", "tool_result", "assistant"))
    rows = rows.withColumn(
        "bucket", F.floor((F.unix_micros("ts") - F.lit(w.lo_micros)) / F.lit(w.bucket_micros)).cast("bigint")
    )
    kind, origin, main = F.col("entry_type"), F.col("origin"), F.col("agent_id").isNull()
    b = F.col("bucket").cast("string")
    person = (kind == "human") & origin.isin("human", "command_scaffolding")
    request = F.coalesce(
        F.nullif("request_id", F.lit("")), F.concat(F.lit("_"), F.unix_micros("ts").cast("string"))
    )
    marker = (
        F.when(kind == "assistant", request)
        .when((kind == "tool_result") & (origin != "interrupt"), F.concat(F.lit("tr_"), b))
        .when((kind == "human") & (origin == "teammate"), F.concat(F.lit("tm_"), b, F.lit("_"), id8(F.col("uuid"))))
        .when(person & ~main, F.concat(F.lit("subh_"), id8(F.col("agent_id")), F.lit("_"), b))
    )
    return rows.withColumns({
        "human": person & main,
        "marker": marker,
        "interrupt": main & F.coalesce(origin == "interrupt", F.lit(False)),
    })


def cells(marked_rows: DataFrame) -> DataFrame:
    """Human turns and distinct agent markers per session and bucket, active cells only."""
    active = marked_rows.where(F.col("human") | F.col("marker").isNotNull())
    return active.groupBy("session_id", "bucket").agg(
        F.count_if("human").alias("human"), F.count_distinct("marker").alias("agent")
    )


def _attributes(entries: DataFrame) -> DataFrame:
    """What holds for the whole main transcript, in the window or not."""
    rows = entries.where(F.col("agent_id").isNull())
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    line = _headline()
    return rows.groupBy("session_id").agg(
        F.min("project").alias("project"),
        first_by_line("entrypoint", named("entrypoint")).alias("entrypoint"),
        first_by_line("team_name", named("team_name")).alias("team"),
        first_by_line("agent_name", named("agent_name")).alias("team_role"),
        last_by_line("summary", (F.col("entry_type") == "summary") & named("summary")).alias("summary"),
        first_by_line(line, line.isNotNull()).alias("_line"),
    ).withColumn("headless", F.coalesce(F.col("entrypoint") == V.HEADLESS_ENTRYPOINT, F.lit(False)))


def branches(entries: DataFrame) -> DataFrame:
    """Branches of each main transcript in order of first appearance."""
    rows = entries.where(F.col("agent_id").isNull() & (F.coalesce("git_branch", F.lit("")) != ""))
    per = rows.groupBy("session_id", "git_branch").agg(F.min("line_no").alias("_at"))
    return per.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "git_branch"))), lambda s: s["git_branch"]).alias("branches")
    )


def main_model(marked_rows: DataFrame) -> DataFrame:
    """Most used model of the main transcript in the window; among equals the first seen."""
    rows = marked_rows.where(
        F.col("agent_id").isNull() & (F.col("entry_type") == "assistant") & (F.coalesce("model", F.lit("")) != "")
    )
    per = rows.groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("_n"), F.min("line_no").alias("_at"))
    return per.groupBy("session_id").agg(
        F.min_by("model", F.struct((-F.col("_n")).alias("n"), "_at")).alias("model")
    )


def session_rows(entries: DataFrame, w: Window, grid: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """One row per session active in the window."""
    rows = entries if "origin" in entries.columns else with_texts(entries)
    marks = marked(rows, w) if marks is None else marks
    grid = cells(marks) if grid is None else grid
    m = w.bucket_minutes
    sums = grid.groupBy("session_id").agg(
        F.min("bucket").alias("_b0"), F.max("bucket").alias("_b1"),
        F.sum("human").alias("human_turns"), F.sum("agent").alias("agent_turns"),
        (F.count_if(F.col("human") > 0) * m).alias("human_active_min"),
        (F.count_if((F.col("human") == 0) & (F.col("agent") > 0)) * m).alias("agent_only_min"),
    )
    said = F.col("human") & (F.coalesce("substantive_text", F.lit("")) != "")
    turned = (F.col("entry_type") == "system") & (F.col("subtype") == "turn_duration") & in_window(w)
    # Per file first: an agent's time counts only when the agent itself was active.
    worked = marks.groupBy("session_id", "agent_id", "file_path").agg(
        F.count_if(F.col("human") | F.col("marker").isNotNull()).alias("_active"),
        F.count_if("interrupt").alias("_cut"),
        first_by_line("substantive_text", said).alias("_open"),
        last_by_line("substantive_text", said).alias("_close"),
    )
    spent = rows.where(turned).groupBy("session_id", "agent_id", "file_path").agg(
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("_ms")
    )
    per_file = worked.unionByName(spent, allowMissingColumns=True).groupBy("session_id", "agent_id", "file_path").agg(
        F.sum("_active").alias("_active"), F.sum("_cut").alias("_cut"), F.sum("_ms").alias("_ms"),
        F.max("_open").alias("_open"), F.max("_close").alias("_close"),
    )
    main = F.col("agent_id").isNull()
    live = main | (F.coalesce("_active", F.lit(0)) > 0)
    per_session = per_file.groupBy("session_id").agg(
        F.count_if(~main & (F.col("_active") > 0)).alias("n_sub"),
        F.coalesce(F.sum("_cut"), F.lit(0)).alias("interrupts"),
        F.coalesce(F.sum(F.when(live, F.col("_ms"))), F.lit(0)).alias("turn_ms"),
        F.max("_open").alias("_open"), F.max("_close").alias("_close"),
    )
    out = sums
    for frame in (_attributes(rows), per_session, main_model(marks), branches(rows)):
        out = out.join(frame, "session_id", "left")
    cut = lambda c, n: F.rtrim(F.substring(collapse(F.col(c)), 1, n))
    return out.select(
        "session_id", "project", F.coalesce("headless", F.lit(False)).alias("headless"), "entrypoint", "team", "team_role", "model",
        F.coalesce("branches", F.array().cast("array<string>")).alias("branches"),
        day_label(F.col("_b0"), w).alias("start"), day_label(F.col("_b1"), w).alias("end"),
        "human_turns", "agent_turns",
        F.when(F.col("human_turns") > 0, F.bround(F.col("agent_turns") / F.col("human_turns"), 1)).alias("amplification"),
        "n_sub",
        F.bround(F.col("turn_ms") / 60000).cast("bigint").alias("turn_min"),
        "human_active_min", "agent_only_min", "interrupts",
        F.coalesce(smart_truncate(F.col("_line"), V.TITLE_CHARS), F.lit(V.EMPTY_TITLE)).alias("title"),
        cut("_open", V.OPENING_CHARS).alias("opening"),
        cut("_close", V.CLOSING_CHARS).alias("closing"),
        "summary",
    )


def timeline(grid: DataFrame, w: Window) -> DataFrame:
    """The sparse grid in long form with its local label."""
    return grid.withColumn("label", F.date_format(local_time(F.col("bucket"), w), "MM-dd HH:mm"))


def attention(grid: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per bucket, interactive sessions only: driven, autonomous, human and agent turns."""
    mine = sessions.where(~F.col("headless")).select("session_id")
    return grid.join(mine, "session_id").groupBy("bucket").agg(
        F.count_if(F.col("human") > 0).alias("driven"),
        F.count_if((F.col("human") == 0) & (F.col("agent") > 0)).alias("autonomous"),
        F.sum("human").alias("human"), F.sum("agent").alias("agent"),
    )


def _peak(name: str) -> Column:
    return F.min(F.when(F.col(name) > 0, F.struct((-F.col(name)).alias("v"), "bucket")))


def summary(sessions: DataFrame, vectors: DataFrame, w: Window) -> DataFrame:
    """One row: interactive and headless totals, peaks and minutes."""
    mine = ~F.col("headless")
    hours = lambda c: F.bround(F.coalesce(F.sum(F.when(c, F.col("turn_min"))), F.lit(0)) / 60, 1)
    total = lambda c, n: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    peaks = vectors.agg(
        (F.count_if(F.col("driven") >= 1) * w.bucket_minutes).alias("active_min"),
        (F.count_if(F.col("driven") >= 2) * w.bucket_minutes).alias("multitask_min"),
        _peak("driven").alias("_d"), _peak("autonomous").alias("_a"),
        F.lit(1).alias("_one"),
    )
    sums = sessions.agg(
        F.count_if(mine).alias("interactive_sessions"),
        total(mine, "human_turns").alias("interactive_human_turns"),
        total(mine, "interrupts").alias("interrupts"),
        hours(mine).alias("interactive_machine_hours"),
        F.count_if(mine & (F.coalesce("team", F.lit("")) != "")).alias("team_sessions"),
        F.count_if(~mine).alias("headless_sessions"),
        total(~mine, "human_turns").alias("headless_human_turns"),
        hours(~mine).alias("headless_machine_hours"),
        F.lit(1).alias("_one"),
    )
    return sums.join(peaks, "_one").select(
        *[c for c in sums.columns if c != "_one"],
        "active_min", "multitask_min",
        F.coalesce(-F.col("_d.v"), F.lit(0)).alias("peak_sessions_driven"),
        day_label(F.col("_d.bucket"), w).alias("peak_at"),
        F.coalesce(-F.col("_a.v"), F.lit(0)).alias("peak_autonomous_sessions"),
        day_label(F.col("_a.bucket"), w).alias("peak_autonomous_at"),
    )


def by_project(sessions: DataFrame, grid: DataFrame, w: Window) -> DataFrame:
    """Per project; minutes are the union of the buckets in which any of its sessions was driven."""
    mine = ~F.col("headless")
    sums = sessions.groupBy("project").agg(
        F.count_if(mine).alias("sessions"), F.count_if(~mine).alias("headless_sessions"),
        F.coalesce(F.sum(F.when(mine, F.col("human_turns"))), F.lit(0)).alias("human_turns"),
        F.sum("turn_min").alias("turn_min"),
    )
    driven = grid.where(F.col("human") > 0).join(
        sessions.where(mine).select("session_id", "project"), "session_id"
    ).groupBy("project").agg((F.count_distinct("bucket") * w.bucket_minutes).alias("active_min"))
    return sums.join(driven, "project", "left").withColumn("active_min", F.coalesce("active_min", F.lit(0)))


def days(vectors: DataFrame, grid: DataFrame, sessions: DataFrame, w: Window) -> DataFrame:
    """One row per local day of the window, with 24-slot arrays; the day is a DATE."""
    local = local_time(F.col("bucket"), w)
    all_buckets = grid.sparkSession.range(w.buckets).select(F.col("id").alias("bucket"))
    dense = all_buckets.join(vectors, "bucket", "left").fillna(0).withColumns({
        "date": F.to_date(local), "hour": F.hour(local)
    })
    per_hour = dense.groupBy("date", "hour").agg(F.sum("human").alias("human"), F.sum("agent").alias("agent"))
    mine = sessions.where(~F.col("headless")).select("session_id")
    driven = grid.where(F.col("human") > 0).join(mine, "session_id").groupBy(
        F.to_date(local).alias("date"), F.hour(local).alias("hour")
    ).agg(F.count_distinct("session_id").alias("driven"))
    hours = per_hour.join(driven, ["date", "hour"], "left")

    def slots(name: str) -> Column:
        # At most 24 entries per day.
        by_hour = F.map_from_entries(F.collect_list(F.struct("hour", F.coalesce(name, F.lit(0)))))
        return F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at(by_hour, h), F.lit(0)))

    arrays = hours.groupBy("date").agg(
        slots("human").alias("human_turns_by_hour"),
        slots("driven").alias("sessions_driven_by_hour"),
        slots("agent").alias("agent_turns_by_hour"),
    )
    sums = dense.groupBy("date").agg(
        (F.count_if(F.col("driven") >= 1) * w.bucket_minutes).alias("active_min"),
        (F.count_if(F.col("driven") >= 2) * w.bucket_minutes).alias("multitask_min"),
        _peak("driven").alias("_d"),
    )
    return sums.join(arrays, "date").select(
        "date", F.date_format("date", "E MM-dd").alias("label"), "active_min", "multitask_min",
        F.coalesce(-F.col("_d.v"), F.lit(0)).alias("peak"),
        F.date_format(local_time(F.col("_d.bucket"), w), "HH:mm").alias("peak_at"),
        "human_turns_by_hour", "sessions_driven_by_hour", "agent_turns_by_hour",
    )


def session_order(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy("headless", F.desc("turn_min"), "session_id")
