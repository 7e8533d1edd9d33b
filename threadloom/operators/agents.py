"""Subagents: dispatches in the parent transcript, files on disk, and the two reconciled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.entry_text import with_texts
from threadloom.functions.tools import telling_input
from threadloom.operators import calls as C
from threadloom.operators import sessions as S
from threadloom.operators.ordered import union_all
from threadloom.session import cut_lineage

_STATS = ["total_duration_ms", "total_tokens", "total_tool_use_count"]
_USAGE = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


def dispatches(entries: DataFrame) -> DataFrame:
    """Dispatching calls of main transcripts; the background tool names its fields differently."""
    made = C.uses(entries, ["file_path", "session_id"]).where(C.is_dispatch(F.col("tool_name")))
    field = lambda k: F.get_json_object("input_json", f"$.{k}")
    background = F.col("tool_name") == "TaskCreate"
    empty = lambda c: F.coalesce(c, F.lit(""))
    return made.select(
        "file_path", "session_id", "tool_use_id",
        C.call_number(F.col("line_no"), F.col("pos")).alias("call_no"),
        F.col("ts"),
        F.when(background, "background").otherwise(empty(field("subagent_type"))).alias("subagent_type"),
        empty(F.when(background, F.coalesce(field("subject"), field("description"))).otherwise(field("description"))).alias("description"),
        empty(F.when(background, field("description")).otherwise(field("prompt"))).alias("prompt"),
    )


def _structured_results(entries: DataFrame, made: DataFrame) -> DataFrame:
    """Result entries that answer a dispatch, with what their structured payload says."""
    rows = entries.where(F.col("entry_type") == "tool_result").select(
        "file_path", "line_no", "tool_use_result_json", F.posexplode("blocks").alias("pos", "b")
    ).where(F.col("b.type") == "tool_result")
    answered = rows.select("file_path", "line_no", "tool_use_result_json", "pos",
                           F.col("b.tool_use_id").alias("tool_use_id"), F.col("b.text").alias("text"))
    known = made.select("file_path", "tool_use_id").distinct()
    # The first block of an entry that answers a dispatch is the one the payload belongs to.
    hit = answered.join(known, ["file_path", "tool_use_id"])
    first = hit.groupBy("file_path", "line_no").agg(
        F.min_by(F.struct("tool_use_id", "text", "tool_use_result_json"), "pos").alias("r")
    ).select("file_path", "line_no", "r.*")
    p = F.from_json("tool_use_result_json", """agentId STRING, status STRING, outputFile STRING, task STRING,
        totalDurationMs BIGINT, totalTokens BIGINT, totalToolUseCount BIGINT,
        usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT,
        cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT>""")
    is_object = F.startswith("tool_use_result_json", F.lit("{"))
    first = first.withColumn("p", F.when(is_object, p))
    sync = F.col("p.agentId").isNotNull()
    task = ~sync & F.col("p.task").isNotNull()
    rejected = ~is_object & F.contains(F.lower("tool_use_result_json"), F.lit("rejected"))
    status = (
        F.when(sync, F.coalesce("p.status", F.lit("unknown")))
        .when(task, "background").when(rejected, "rejected")
    )
    return first.where(status.isNotNull()).select(
        "file_path", "tool_use_id", "line_no",
        status.alias("status"),
        F.when(sync, F.col("p.agentId")).when(task, F.get_json_object("p.task", "$.id")).alias("agent_id"),
        F.when(sync, F.col("p.outputFile")).alias("output_file"),
        F.when(sync & ~status.isin("async_launched", "rejected"), F.col("text")).alias("result_text"),
        F.when(sync, F.col("p.totalDurationMs")).alias("total_duration_ms"),
        F.when(sync, F.col("p.totalTokens")).alias("total_tokens"),
        F.when(sync, F.col("p.totalToolUseCount")).alias("total_tool_use_count"),
        *[F.when(sync, F.col("p.usage")[u]).alias(u) for u in _USAGE],
    )


def notifications(entries: DataFrame) -> DataFrame:
    """Task notifications in tool results and queue operations: one row per notifying line."""
    told = F.filter("blocks", lambda b: (b["type"] == "text") & F.contains(b["text"], F.lit("<task-notification>")))
    rows = entries.where(F.col("entry_type").isin("tool_result", "queue_operation")).select(
        "file_path", "line_no", F.try_element_at(told, F.lit(1))["text"].alias("text")
    ).where(F.col("text").isNotNull())
    return rows.select("file_path", "line_no", X.notification_fields(F.col("text")).alias("n")).where(
        F.col("n").isNotNull()
    ).select("file_path", "line_no", F.col("n.task_id").alias("agent_id"), "n.status",
             F.col("n.result").alias("result"), "n.total_tokens", "n.tool_uses", "n.duration_ms")


def dispatch_results(entries: DataFrame) -> DataFrame:
    """Dispatches with agent id, latest status, result text and completion statistics."""
    made = dispatches(entries)
    answers = _structured_results(entries, made)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    answered = answers.groupBy("file_path", "tool_use_id").agg(
        F.max(F.struct("line_no", "status")).alias("_status"),
        last("agent_id").alias("agent_id"), last("output_file").alias("output_file"),
        last("result_text").alias("result_text"),
        *[last(c).alias(c) for c in _STATS + _USAGE],
    )
    noted = notifications(entries).join(
        answered.where(F.coalesce("agent_id", F.lit("")) != "").select("file_path", "tool_use_id", "agent_id"),
        ["file_path", "agent_id"],
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    noted = noted.groupBy("file_path", "tool_use_id").agg(
        F.max(F.struct("line_no", "status")).alias("_noted"),
        F.min_by("result", F.when(F.coalesce("result", F.lit("")) != "", F.col("line_no"))).alias("_result"),
        first("total_tokens").alias("_tokens"), first("tool_uses").alias("_tools"),
        first("duration_ms").alias("_duration"),
    )
    keys = ["file_path", "tool_use_id"]
    rows = made.join(answered, keys, "left").join(noted, keys, "left")
    return rows.select(
        *made.columns,
        "agent_id",
        F.coalesce(F.greatest("_status", "_noted")["status"], F.lit("unknown")).alias("status"),
        F.coalesce("output_file", F.lit("")).alias("output_file"),
        F.coalesce(F.nullif("result_text", F.lit("")), "_result", F.lit("")).alias("result_text"),
        F.coalesce("total_duration_ms", "_duration").alias("total_duration_ms"),
        F.coalesce("total_tokens", "_tokens").alias("total_tokens"),
        F.coalesce("total_tool_use_count", "_tools").alias("total_tool_use_count"),
        *_USAGE,
    )


def agent_files(transcripts: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Agent transcripts on disk with what their sidecars say; a missing sidecar gives ''."""
    files = transcripts.where(F.col("agent_id").isNotNull())
    if meta is None:
        blank = F.lit("")
        return files.withColumns({"tool_use_id": blank, "agent_type": blank, "description": blank})
    joined = files.join(meta.select("file_path", "tool_use_id", "agent_type", "description"), "file_path", "left")
    return joined.fillna("", ["tool_use_id", "agent_type", "description"])


def reconcile(made: DataFrame, files: DataFrame) -> DataFrame:
    """Dispatches and files as one population: dispatched, dispatch_only or orphan.

    A file belongs to the dispatch its sidecar names, else to the dispatch that reported its agent
    id. Of several files for one dispatch the first by path gives the agent, the last one the transcript.
    """
    made = cut_lineage(made)
    by_call = made.groupBy("session_id", "tool_use_id").agg(F.max("call_no").alias("call_no"))
    by_agent = made.where(F.coalesce("agent_id", F.lit("")) != "").groupBy("session_id", "agent_id").agg(
        F.max("call_no").alias("call_no")
    )
    about = ["file_path", "session_id", "agent_id", "workflow_run_id", "is_artifact"]
    body = cut_lineage(files.select(*about, "tool_use_id", "agent_type", F.col("description").alias("file_description")))
    named = body.where(F.col("tool_use_id") != "").join(by_call, ["session_id", "tool_use_id"]).select(*about, "call_no")
    rest = body.join(named.select("file_path"), "file_path", "left_anti")
    reported = rest.join(by_agent, ["session_id", "agent_id"]).select(*about, "call_no")
    matched = named.unionByName(reported)
    per_call = matched.groupBy("session_id", "call_no").agg(
        F.max(F.struct("file_path", "workflow_run_id", "is_artifact")).alias("f"),
        F.min_by("agent_id", "file_path").alias("_agent"),
    )
    known = made.drop("file_path").join(per_call, ["session_id", "call_no"], "left").withColumns({
        "agent_id": F.coalesce(F.nullif("agent_id", F.lit("")), "_agent"),
        "transcript": F.col("f.file_path"),
        "workflow_run_id": F.col("f.workflow_run_id"),
        "is_artifact": F.coalesce("f.is_artifact", F.lit(False)),
        "source": F.when(F.col("f").isNotNull(), "dispatched").otherwise("dispatch_only"),
    }).drop("f", "_agent")
    orphans = body.join(matched.select("file_path"), "file_path", "left_anti").select(
        "session_id", "tool_use_id", "agent_id", "workflow_run_id", "is_artifact",
        F.col("file_path").alias("transcript"),
        F.col("agent_type").alias("subagent_type"),
        F.col("file_description").alias("description"),
        F.lit("orphan").alias("source"),
    )
    return known.unionByName(orphans, allowMissingColumns=True)


def agents_present(agents: DataFrame) -> DataFrame:
    """Agents per session, copies excluded."""
    return agents.where(~F.coalesce("is_artifact", F.lit(False))).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("agents_present")
    )


def resolve_output(agents: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Where an agent's body is: a saved copy, else the file found, else the recorded path.

    `saved` maps agent_id to saved_file.
    """
    rows = agents if saved is None else agents.join(saved, "agent_id", "left")
    saved_file = F.lit(None).cast("string") if saved is None else F.col("saved_file")
    rows = rows.withColumn(
        "output_resolved", F.coalesce(saved_file, "transcript", F.nullif("output_file", F.lit("")))
    )
    return rows.drop("saved_file")


def body_stats(bodies: DataFrame) -> DataFrame:
    """What an agent's own transcript tells: prompt, result, tokens, tools, time."""
    rows = bodies if "substantive_text" in bodies.columns else with_texts(bodies)
    key = ["file_path"]
    stats = S.transcript_stats(rows)
    counts = C.tool_counts(C.uses(rows, ["file_path"]), key, "tool_name").groupBy("file_path").agg(
        F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("n"), "tool_name", "calls"))),
            lambda s: F.struct(s["tool_name"], s["calls"]),
        )).alias("tool_name_counts")
    )
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("entry_count"))
    said = S.first_user_text(rows, key)
    told = S.last_assistant_text(rows, key)
    out = stats.select("file_path", F.col("input_tokens").alias("_in"), F.col("output_tokens").alias("_out"),
                       F.col("tool_use_count").alias("_tools"), F.col("duration_ms").alias("_ms"))
    for frame in (sizes, counts, said, told):
        out = out.join(frame, key, "left")
    return out


def backfill(agents: DataFrame, stats: DataFrame) -> DataFrame:
    """Fill what the parent did not say from the agent's own transcript, only where null."""
    rows = agents.join(stats.withColumnRenamed("file_path", "transcript"), "transcript", "left")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    text = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))
    return rows.withColumns({
        "prompt": text("prompt", "first_user_text"),
        "result_text": text("result_text", "last_assistant_text"),
        "input_tokens": F.coalesce("input_tokens", positive("_in")),
        "output_tokens": F.coalesce("output_tokens", positive("_out")),
        "total_tool_use_count": F.coalesce("total_tool_use_count", positive("_tools")),
        "total_duration_ms": F.coalesce("total_duration_ms", "_ms"),
    }).drop("_in", "_out", "_tools", "_ms", "first_user_text", "last_assistant_text").withColumn(
        "total_input_tokens",
        F.when(
            F.col("input_tokens").isNotNull(),
            F.col("input_tokens") + F.coalesce("cache_creation_input_tokens", F.lit(0))
            + F.coalesce("cache_read_input_tokens", F.lit(0)),
        ),
    )


def trace_lines(entries: DataFrame, show_reasoning: bool = True, truncate: int = 80) -> DataFrame:
    """Chronological lines of tool calls and reasoning; the time stands on an entry's first line."""
    from threadloom import fixed_values as V

    def shown(b):
        call = b["type"] == "tool_use"
        said = (b["type"] == "text") & (X.strip(b["text"]) != "")
        return call | said if show_reasoning else call

    place = [c for c in ("session_id", "agent_id", "file_path") if c in entries.columns]
    items = entries.where(F.col("entry_type") == "assistant").select(
        *place, "line_no", "ts", F.posexplode(F.filter("blocks", shown)).alias("item", "b")
    )
    blank = F.lit(" " * 8)
    stamp = F.when(F.col("item") == 0, F.coalesce(F.date_format("ts", "HH:mm:ss"), blank)).otherwise(blank)
    name = F.col("b.tool_name")
    pad = F.repeat(F.lit(" "), F.greatest(F.lit(0), 20 - F.length(name)))
    detail = (
        X.smart_truncate(telling_input(name, F.col("b.input_json")), truncate)
        if truncate else F.col("b.input_json")
    )
    used = items.where(F.col("b.type") == "tool_use").select(
        *place, "line_no", "item", F.lit(0).alias("sub"),
        F.concat(stamp, F.lit("  "), name, pad, detail).alias("line"),
    )
    said = items.where(F.col("b.type") == "text").select(
        *place, "line_no", "item", F.split(X.strip(F.col("b.text")), "\n").alias("_all")
    )
    margin = F.lit(" " * 10)
    first = said.select(
        *place, "line_no", "item", F.posexplode(F.slice("_all", 1, V.TRACE_LINES)).alias("sub", "_l")
    ).withColumn("line", F.concat(margin, F.lit('"'), X.smart_truncate(F.col("_l"), V.TRACE_LINE_CHARS), F.lit('"'))).drop("_l")
    rest = said.where(F.size("_all") > V.TRACE_LINES).select(
        *place, "line_no", "item", F.lit(V.TRACE_LINES).alias("sub"),
        F.concat(margin, F.lit("... ("), (F.size("_all") - V.TRACE_LINES).cast("string"), F.lit(" more lines)")).alias("line"),
    )
    return union_all([used, first, rest])
