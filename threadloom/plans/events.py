"""Registered queries over `events` (and `documents`) read as transcripts with tool calls."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.entry_text import with_texts
from threadloom.functions.fence import fenced
from threadloom.functions.tools import failure_kind
from threadloom.operators import activity as ACT
from threadloom.operators import agents, calls, failures, search, sessions
from threadloom.plans import sql
from threadloom.session import cut_lineage
from threadloom.sources import projects, tables
from threadloom.sources.transcripts import entries as typed_entries
from threadloom.sources.transcripts import transcripts

WINDOW = ACT.Window(
    datetime(2024, 1, 5, 8, 0, tzinfo=timezone.utc), datetime(2024, 1, 12, 8, 7, tzinfo=timezone.utc), 30, "America/New_York"
)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return typed_entries(tables.event_lines(spark, d))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """The tables `entries` and `tool_calls`, each written once."""
    return cut_lineage(calls.pair_tool_calls(cut_lineage(_entries(spark, d))))


def _survey(spark, d, **options) -> failures.Survey:
    e = cut_lineage(_entries(spark, d))
    return failures.survey(cut_lineage(calls.pair_tool_calls(e)), files=failures.error_files(e), **options)


def pair_calls(spark, d):
    paired = calls.pair_tool_calls(cut_lineage(_entries(spark, d)))
    return paired.select("session_id", "agent_id", "line_no", "tool_use_id", "tool_name", "short_name", "server",
                         "has_result", "is_error", "kind", "result_text")


def tool_counts(spark, d):
    return calls.tool_counts(calls.uses(_entries(spark, d)).withColumn("short_name", F.col("tool_name")), ["project"])


def tool_audit(spark, d):
    return calls.tool_audit(_calls(spark, d), ["session_id"], "query")


def audit_coverage(spark, d):
    e = cut_lineage(_entries(spark, d))
    agents_there = e.where("agent_id IS NOT NULL").select("session_id", "agent_id").distinct()
    return calls.audit_coverage(calls.pair_tool_calls(e.where("agent_id IS NOT NULL")), agents_there, "query")


def audit_rows(spark, d):
    rows = calls.audit_rows(_calls(spark, d), None, 40)
    return rows.select("session_id", "call_no", "time_utc", "tool", "input_summary", "error", "error_text")


def failure_totals(spark, d):
    return _survey(spark, d).totals


def failure_kinds(spark, d):
    found = _survey(spark, d, examples=True).by_kind
    return found.select("kind", "category", "count", "sessions", F.col("example.text").alias("example"))


def failure_tools(spark, d):
    return _survey(spark, d).by_tool


def failure_sessions(spark, d):
    found = _survey(spark, d, include_cascade=True, kinds="cascade,timeout,bad_path").by_session
    return found.select("session_id", "project", "errors", "top_kind", "date")


def failure_section(spark, d):
    found = _survey(spark, d).by_session.select("session_id", "errors")
    return failures.section(found, "errors", ["session_id"], 10)


def failure_shapes(spark, d):
    rows = fenced(tables.document_calls(spark, d), failure_kind(F.col("result_text")).alias("kind"))
    return failures.unclassified_shapes(rows).select("shape", "count", "sessions")


def document_kinds(spark, d):
    rows = fenced(tables.document_calls(spark, d), failure_kind(F.col("result_text")).alias("kind"))
    return failures.by_kind(rows).select("kind", "category", "count", "sessions")


def errors_only(spark, d):
    found = search.count_hits(_entries(spark, d), ["not", "exit|odd"], "all", errors_only=True)
    return found.select("pattern", "project", "session_id", "hits")


def compactions(spark, d):
    found = sessions.compactions(cut_lineage(_entries(spark, d)))
    return found.select("session_id", "agent_id", "line_no", "turn", "from_tokens", "to_tokens",
                        F.round("drop_pct", 4).alias("drop_pct"))


def _marks(spark, d):
    rows = cut_lineage(with_texts(_entries(spark, d)))
    return rows, cut_lineage(ACT.marked(rows, WINDOW))


def activity_cells(spark, d):
    return ACT.cells(ACT.marked(with_texts(_entries(spark, d)), WINDOW))


def activity_timeline(spark, d):
    grid = ACT.cells(ACT.marked(with_texts(_entries(spark, d)), WINDOW))
    return ACT.timeline(grid, WINDOW).select("session_id", "label", "human", "agent")


def _parts(spark, d):
    rows, marks = _marks(spark, d)
    grid = cut_lineage(ACT.cells(marks))
    found = cut_lineage(ACT.session_rows(rows, WINDOW, grid, marks))
    return grid, found


def activity_sessions(spark, d):
    _, found = _parts(spark, d)
    return found.select(
        "session_id", "project", "headless", "team", "team_role", "model", F.array_join("branches", ",").alias("branches"),
        "start", "end", "human_turns", "agent_turns", "amplification", "n_sub", "turn_min", "human_active_min",
        "agent_only_min", "interrupts", "title", "opening", "closing",
    )


def activity_summary(spark, d):
    grid, found = _parts(spark, d)
    return ACT.summary(found, ACT.attention(grid, found), WINDOW)


def activity_by_project(spark, d):
    grid, found = _parts(spark, d)
    return ACT.by_project(found, grid, WINDOW)


def activity_days(spark, d):
    grid, found = _parts(spark, d)
    days = ACT.days(ACT.attention(grid, found), grid, found, WINDOW)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return days.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "label", "active_min", "multitask_min", "peak", "peak_at",
                       text("human_turns_by_hour"), text("sessions_driven_by_hour"), text("agent_turns_by_hour"))


def agent_reconcile(spark, d):
    """Agent calls of main transcripts against agents' files, joined by the session's agent."""
    e = cut_lineage(_entries(spark, d))
    lines = e.select("file_path", F.lit(None).cast("timestamp").alias("file_mtime"))
    made = agents.dispatches(e.where(F.col("agent_id").isNull()))
    # The sidecar names the first dispatch of even sessions and is missing for odd ones; the parent reports the last one.
    first = made.groupBy("session_id").agg(F.min_by("tool_use_id", "call_no").alias("tool_use_id"))
    meta = e.where(F.col("agent_id").isNotNull()).select("session_id", "file_path").distinct().join(first, "session_id").where(
        F.conv(F.substring("session_id", 1, 8), 16, 10).cast("bigint") % 2 == 0
    ).select("file_path", "tool_use_id", F.lit("scout").alias("agent_type"), F.lit("look").alias("description"))
    files = agents.agent_files(transcripts(lines), meta)
    newest = made.groupBy("session_id").agg(F.max("call_no").alias("call_no"))
    known = made.join(newest.withColumn("_n", F.lit(True)), ["session_id", "call_no"], "left").withColumn(
        "agent_id", F.when(F.col("_n"), F.concat(F.lit("a00000000"), F.substring("session_id", 1, 8)))
    ).drop("_n")
    found = agents.reconcile(known, files)
    at = F.max(F.when(F.col("source") == "dispatched", F.col("call_no")))
    return found.groupBy("session_id", "source").agg(F.count(F.lit(1)).alias("agents"), at.alias("call_no"))


def agents_present(spark, d):
    e = cut_lineage(_entries(spark, d))
    files = agents.agent_files(transcripts(e.select("file_path", F.lit(None).cast("timestamp").alias("file_mtime"))))
    found = agents.reconcile(agents.dispatch_results(e.where(F.col("agent_id").isNull())), files)
    return agents.agents_present(found)


def agent_bodies(spark, d):
    rows = _entries(spark, d).where(F.col("agent_id").isNotNull())
    stats = agents.body_stats(cut_lineage(with_texts(rows)))
    return stats.select(
        F.regexp_extract("file_path", "agent-(.*)\\.jsonl", 1).alias("agent_id"), "entry_count",
        F.col("_in").alias("input_tokens"), F.col("_out").alias("output_tokens"), F.col("_tools").alias("tools"),
        F.coalesce("last_assistant_text", F.lit("")).alias("last_text"),
    )


def dedup_sessions(spark, d):
    """Order keys seen in two places; the copy in the main worktree wins."""
    o = tables.table(spark, d, "orders")
    seat = lambda rank, name: F.lit(rank).alias(name)
    key = F.col("o_orderkey")
    main = o.where(key % 3 != 0).select(key.alias("session_id"), F.lit("main").alias("worktree"), seat(0, "project_rank"), seat(0, "worktree_rank"), "o_totalprice")
    linked = o.where(key % 2 == 0).select(key.alias("session_id"), F.lit("linked").alias("worktree"), seat(0, "project_rank"), seat(1, "worktree_rank"), (-F.col("o_totalprice")).alias("o_totalprice"))
    orphan = o.select(key.alias("session_id"), F.lit("orphan").alias("worktree"), seat(0, "project_rank"), seat(2, "worktree_rank"), F.lit(0.0).alias("o_totalprice"))
    return projects.discover_sessions(main.unionByName(linked).unionByName(orphan)).select("session_id", "worktree", "o_totalprice")


QUERIES = {
    "pair_calls": pair_calls,
    "tool_counts": tool_counts,
    "tool_audit": tool_audit,
    "audit_rows": audit_rows,
    "audit_coverage": audit_coverage,
    "failure_totals": failure_totals,
    "failure_kinds": failure_kinds,
    "failure_tools": failure_tools,
    "failure_sessions": failure_sessions,
    "failure_section": failure_section,
    "failure_shapes": failure_shapes,
    "document_kinds": document_kinds,
    "errors_only": errors_only,
    "compactions": compactions,
    "activity_cells": activity_cells,
    "activity_timeline": activity_timeline,
    "activity_sessions": activity_sessions,
    "activity_summary": activity_summary,
    "activity_by_project": activity_by_project,
    "activity_days": activity_days,
    "agent_reconcile": agent_reconcile,
    "agents_present": agents_present,
    "agent_bodies": agent_bodies,
    "dedup_sessions": dedup_sessions,
}

# --- the same in SQL --------------------------------------------------------------------------------------------


def _list(values: list[str]) -> str:
    return "list_value(" + ", ".join(sql.quote(v) for v in values) + ")"


def _kind(window: str) -> str:
    rules = " ".join(f"WHEN regexp_matches({window}, {sql.quote(p)}, 'i') THEN '{k}'" for k, _, p in V.FAILURE_RULES)
    return f"CASE {rules} ELSE '{V.UNCLASSIFIED[0]}' END"


def _category(kind: str) -> str:
    rules = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c, _ in V.FAILURE_RULES)
    return f"CASE {kind} {rules} ELSE '{V.UNCLASSIFIED[1]}' END"


EV = f"""WITH ev AS (
SELECT event_id, ts, user_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
 'p' || (user_id % 5) AS project, printf('%08x{tables.SESSION_TAIL}', user_id) AS session_id,
 CASE WHEN event_id % 10 = 0 AND event_type <> 'signup' THEN printf('a%016x', user_id) END AS agent_id,
 'toolu_' || user_id || '_' || json_extract_string(props, '$.k') AS tool_use_id,
 CASE event_type WHEN 'signup' THEN CASE event_id % 4 WHEN 1 THEN 'interrupt' WHEN 2 THEN 'teammate' WHEN 3 THEN 'scaffold' ELSE 'human' END
  WHEN 'click' THEN 'call' WHEN 'view' THEN 'talk' ELSE 'result' END AS kind_of,
 {_list(tables.CALL_NAMES)}[1 + event_id % {len(tables.CALL_NAMES)}] AS tool_name,
 CASE WHEN event_type = 'error' THEN {_list(tables.FAILURE_TEXTS)}[1 + event_id % {len(tables.FAILURE_TEXTS)}] || ' ' || props
  WHEN event_type = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'entry not found ' ELSE 'ok ' END || props END AS result_text
FROM events)"""
_EV = EV
PAIRS = f"""{_EV},
r AS (SELECT session_id, agent_id, tool_use_id, arg_min(result_text, event_id) AS result_text, arg_min(event_type = 'error', event_id) AS is_error
      FROM ev WHERE kind_of = 'result' GROUP BY ALL),
calls AS (SELECT c.project, c.session_id, c.agent_id, c.event_id, c.ts, c.k, c.props, c.tool_use_id, c.tool_name, r.result_text, r.result_text IS NOT NULL AS has_result, coalesce(r.is_error, false) AS is_error,
  CASE WHEN starts_with(c.tool_name, 'mcp__') THEN split_part(c.tool_name, '__', 2) END AS server,
  CASE WHEN starts_with(c.tool_name, 'mcp__') THEN split_part(c.tool_name, '__', 3) ELSE c.tool_name END AS short_name
  FROM ev c LEFT JOIN r ON r.session_id = c.session_id AND r.agent_id IS NOT DISTINCT FROM c.agent_id AND r.tool_use_id = c.tool_use_id WHERE c.kind_of = 'call'),
tc AS (SELECT *, CASE WHEN is_error THEN {_kind(sql.collapse_ws('result_text', V.FAILURE_WINDOW))} END AS kind FROM calls)"""
_PAIRS = PAIRS
_SCAN = f"""{_PAIRS},
ef AS (SELECT DISTINCT session_id, agent_id FROM ev WHERE event_type = 'error'),
scan AS (SELECT t.* FROM tc t WHERE EXISTS (SELECT 1 FROM ef WHERE ef.session_id = t.session_id AND ef.agent_id IS NOT DISTINCT FROM t.agent_id))"""
_FAILED = f"""{_SCAN}, failed AS (SELECT *, (project, session_id, coalesce(agent_id, ''), event_id) AS ord FROM scan WHERE is_error AND kind <> 'cascade')"""
_DOC = f"""WITH d AS (SELECT source, CASE WHEN doc_id % 2 = 0 THEN {_list(tables.FAILURE_TEXTS)}[1 + (doc_id // 2) % {len(tables.FAILURE_TEXTS)}] || ' ' ELSE '' END || text AS text FROM documents)"""
ERR = "has_result AND (is_error OR regexp_matches(lower(left(result_text, 300)), '" + "|".join(V.NO_MATCH_MARKERS) + "'))"
_ERR = ERR

_LO, _HI, _B = WINDOW.lo_micros, WINDOW.hi_micros, WINDOW.bucket_micros
_M = WINDOW.bucket_minutes


def _local(bucket: str) -> str:
    # The window lies in one offset of the zone: New York is five hours behind UTC in January.
    return f"(make_timestamp({_LO} + {bucket} * {_B}) - INTERVAL 5 HOUR)"


_ACT = f"""{_EV},
marks AS (SELECT *, (epoch_us(ts) - {_LO}) // {_B} AS bucket, agent_id IS NULL AND kind_of IN ('human', 'scaffold') AS human,
  CASE WHEN kind_of IN ('call', 'talk') THEN 'req' || (event_id // 4)
       WHEN kind_of = 'result' THEN 'tr'
       WHEN kind_of = 'teammate' THEN 'tm_' || event_id END AS marker
  FROM ev WHERE epoch_us(ts) >= {_LO} AND epoch_us(ts) < {_HI}),
cells AS (SELECT session_id, bucket, count(*) FILTER (WHERE human) AS human, count(DISTINCT marker) AS agent FROM marks
  WHERE human OR marker IS NOT NULL GROUP BY 1, 2)"""
# Used by other modules as well.
ACTIVE, LO, HI, B, M = _ACT, _LO, _HI, _B, _M
_SESS = f"""{_ACT},
sums AS (SELECT session_id, min(bucket) AS b0, max(bucket) AS b1, CAST(sum(human) AS BIGINT) AS human_turns, CAST(sum(agent) AS BIGINT) AS agent_turns,
  count(*) FILTER (WHERE human > 0) * {_M} AS human_active_min, count(*) FILTER (WHERE human = 0 AND agent > 0) * {_M} AS agent_only_min FROM cells GROUP BY 1),
main AS (SELECT session_id, min(project) AS project, user_id % 7 = 0 AS headless, CASE WHEN user_id % 11 = 0 THEN 'team' END AS team,
  CASE WHEN user_id % 11 = 0 THEN 'worker' END AS team_role, arg_min('signed up with ' || k, event_id) FILTER (WHERE kind_of = 'human') AS title
  FROM ev WHERE agent_id IS NULL GROUP BY session_id, user_id),
br AS (SELECT session_id, string_agg(b, ',' ORDER BY at_line) AS branches FROM (SELECT session_id, 'b' || (event_id % 3) AS b, min(event_id) AS at_line FROM ev WHERE agent_id IS NULL GROUP BY 1, 2) GROUP BY 1),
mods AS (SELECT session_id, first(m ORDER BY n DESC, at_line) AS model FROM (SELECT session_id, 'model-' || (event_id % 3) AS m, count(*) AS n, min(event_id) AS at_line
  FROM marks WHERE agent_id IS NULL AND kind_of IN ('call', 'talk') GROUP BY 1, 2) GROUP BY 1),
said AS (SELECT session_id, count(*) FILTER (WHERE kind_of = 'interrupt') AS interrupts, count(DISTINCT agent_id) FILTER (WHERE marker IS NOT NULL) AS n_sub,
  arg_min('signed up with ' || k, event_id) FILTER (WHERE kind_of = 'human') AS opening, arg_max('signed up with ' || k, event_id) FILTER (WHERE kind_of = 'human') AS closing
  FROM marks GROUP BY 1),
sess AS (SELECT s.*, main.* EXCLUDE (session_id), br.branches, mods.model, said.* EXCLUDE (session_id) FROM sums s JOIN main USING (session_id) LEFT JOIN br USING (session_id)
  LEFT JOIN mods USING (session_id) LEFT JOIN said USING (session_id))"""
_VEC = f"""{_SESS},
vec AS (SELECT bucket, count(*) FILTER (WHERE c.human > 0) AS driven, count(*) FILTER (WHERE c.human = 0 AND c.agent > 0) AS autonomous, sum(c.human) AS human, sum(c.agent) AS agent
  FROM cells c JOIN sess USING (session_id) WHERE NOT headless GROUP BY 1)"""


def _label(b: str, fmt: str) -> str:
    return f"strftime({_local(b)}, '{fmt}')"


ORACLES = {
    "pair_calls": f"{_PAIRS} SELECT session_id, agent_id, event_id AS line_no, tool_use_id, tool_name, short_name, server, has_result, is_error, kind, result_text FROM tc",
    "tool_counts": f"{_EV} SELECT project, tool_name AS short_name, count(*) AS calls FROM ev WHERE kind_of = 'call' GROUP BY 1, 2",
    "tool_audit": f"""{_PAIRS} SELECT session_id, count(*) AS calls, count(*) FILTER (WHERE contains(tool_name, 'query')) AS rows,
 count(*) FILTER (WHERE contains(tool_name, 'query') AND {_ERR}) AS errors, count(DISTINCT short_name) AS tools FROM tc GROUP BY 1""",
    "audit_coverage": f"""{_PAIRS}, p AS (SELECT DISTINCT session_id, agent_id FROM ev WHERE agent_id IS NOT NULL),
c AS (SELECT * FROM tc WHERE agent_id IS NOT NULL)
SELECT (SELECT count(*) FROM p) AS agents_present, count(DISTINCT (session_id, agent_id)) AS agents_audited, count(*) AS calls,
 count(*) FILTER (WHERE contains(tool_name, 'query')) AS rows, count(*) FILTER (WHERE contains(tool_name, 'query') AND {_ERR}) AS errors FROM c""",
    "audit_rows": f"""{_PAIRS}, a AS (SELECT *, {_ERR} AS error, '{{"query":' || CAST(to_json(props) AS VARCHAR) || ',"description":"task ' || k || '"}}' AS inp, {sql.collapse_ws('result_text', 41)} AS told FROM tc)
SELECT session_id, event_id * {calls.CALL_STRIDE} AS call_no, strftime(ts, '%H:%M:%S') AS time_utc, short_name AS tool,
 CASE WHEN length(inp) > 40 THEN left(inp, 39) || '…' ELSE inp END AS input_summary, error,
 CASE WHEN error THEN CASE WHEN length(told) > 40 THEN left(told, 39) || '…' ELSE told END END AS error_text FROM a""",
    "failure_totals": f"""{_SCAN} SELECT count(*) FILTER (WHERE is_error AND kind <> 'cascade') AS total,
 count(DISTINCT session_id) FILTER (WHERE is_error AND kind <> 'cascade') AS sessions_affected, count(*) FILTER (WHERE kind = 'unclassified') AS unclassified_total,
 count(*) FILTER (WHERE kind = 'cascade') AS cascade_suppressed, (SELECT count(DISTINCT session_id) FROM ef) AS sessions_scanned, (SELECT count(*) FROM ef) AS transcripts_scanned FROM scan""",
    "failure_kinds": f"""{_FAILED} SELECT kind, {_category('kind')} AS category, count(*) AS count, count(DISTINCT session_id) AS sessions,
 {sql.collapse_ws('arg_min(result_text, ord)', V.FAILURE_EXAMPLE_CHARS)} AS example FROM failed GROUP BY kind""",
    "failure_tools": f"""{_SCAN}, t AS (SELECT *, is_error AND kind <> 'cascade' AS bad, (project, session_id, coalesce(agent_id, ''), event_id) AS ord,
  CASE WHEN short_name = 'query' THEN 'query' WHEN short_name = 'fetch' THEN tool_name ELSE short_name END AS tool FROM scan),
tk AS (SELECT tool, first(kind ORDER BY n DESC, o) AS top_kind FROM (SELECT tool, kind, count(*) AS n, min(ord) AS o FROM t WHERE bad GROUP BY 1, 2) GROUP BY 1)
SELECT tool, count(*) FILTER (WHERE bad) AS errors, count(*) AS calls, any_value(top_kind) AS top_kind,
 round_even(count(*) FILTER (WHERE bad) / count(*), 3) AS error_rate FROM t JOIN tk USING (tool) GROUP BY tool""",
    "failure_sessions": f"""{_SCAN}, f AS (SELECT *, (project, session_id, coalesce(agent_id, ''), event_id) AS ord FROM scan WHERE is_error AND kind IN ('cascade', 'timeout', 'bad_path')),
k AS (SELECT session_id, kind, count(*) AS n, min(ord) AS o, min(ts) AS t, min(project) AS p FROM f GROUP BY 1, 2)
SELECT session_id, min(p) AS project, CAST(sum(n) AS BIGINT) AS errors, first(kind ORDER BY n DESC, o) AS top_kind, strftime(min(t), '%Y-%m-%d') AS date FROM k GROUP BY 1""",
    "failure_section": f"""{_FAILED}, s AS (SELECT session_id, count(*) AS errors FROM failed GROUP BY 1)
SELECT *, (SELECT count(*) FROM s) AS section_total FROM s ORDER BY errors DESC, session_id LIMIT 10""",
    "failure_shapes": f"""{_DOC}, x AS (SELECT source, {_kind(sql.collapse_ws('text', V.FAILURE_WINDOW))} AS kind, {sql.collapse_ws('text', V.FAILURE_SHAPE_CHARS)} AS shape FROM d)
SELECT shape, count(*) AS count, count(DISTINCT source) AS sessions FROM x WHERE kind = 'unclassified' GROUP BY 1""",
    "document_kinds": f"""{_DOC}, x AS (SELECT source, {_kind(sql.collapse_ws('text', V.FAILURE_WINDOW))} AS kind FROM d)
SELECT kind, {_category('kind')} AS category, count(*) AS count, count(DISTINCT source) AS sessions FROM x GROUP BY 1, 2""",
    "errors_only": f"""{_EV} SELECT p AS pattern, project, session_id, count(*) AS hits FROM ev, (VALUES ('not'), ('exit|odd')) v(p)
WHERE event_type = 'error' AND regexp_matches(result_text, p, 'i') GROUP BY ALL""",
    "compactions": f"""{_EV}, u AS (SELECT session_id, agent_id, event_id, CAST(floor(value * 1000) AS BIGINT) AS to_tokens,
  row_number() OVER (PARTITION BY session_id, agent_id ORDER BY event_id) AS turn FROM ev WHERE kind_of IN ('call', 'talk')),
p AS (SELECT *, lag(to_tokens) OVER (PARTITION BY session_id, agent_id ORDER BY event_id) AS from_tokens FROM u WHERE to_tokens > 0)
SELECT session_id, agent_id, event_id AS line_no, turn, from_tokens, to_tokens, round((1 - to_tokens / from_tokens) * 100, 4) AS drop_pct FROM p
WHERE from_tokens > {V.COMPACTION_MIN_TOKENS} AND to_tokens < from_tokens * {V.COMPACTION_KEEP_RATIO}""",
    "activity_cells": f"{_ACT} SELECT * FROM cells",
    "activity_timeline": f"{_ACT} SELECT session_id, {_label('bucket', '%m-%d %H:%M')} AS label, human, agent FROM cells",
    "activity_sessions": f"""{_SESS} SELECT session_id, project, headless, team, team_role, model, branches, {_label('b0', '%a %m-%d %H:%M')} AS start, {_label('b1', '%a %m-%d %H:%M')} AS end,
 human_turns, agent_turns, CASE WHEN human_turns > 0 THEN round_even(agent_turns / human_turns, 1) END AS amplification, n_sub, CAST(0 AS BIGINT) AS turn_min,
 human_active_min, agent_only_min, interrupts, coalesce(title, '(empty session)') AS title, opening, closing FROM sess""",
    "activity_summary": f"""{_VEC} SELECT i.*, v.* FROM (SELECT count(*) FILTER (WHERE NOT headless) AS interactive_sessions,
 CAST(coalesce(sum(human_turns) FILTER (WHERE NOT headless), 0) AS BIGINT) AS interactive_human_turns, CAST(coalesce(sum(interrupts) FILTER (WHERE NOT headless), 0) AS BIGINT) AS interrupts,
 0.0::DOUBLE AS interactive_machine_hours, count(*) FILTER (WHERE NOT headless AND team IS NOT NULL) AS team_sessions, count(*) FILTER (WHERE headless) AS headless_sessions,
 CAST(coalesce(sum(human_turns) FILTER (WHERE headless), 0) AS BIGINT) AS headless_human_turns, 0.0::DOUBLE AS headless_machine_hours FROM sess) i,
(SELECT count(*) FILTER (WHERE driven >= 1) * {_M} AS active_min, count(*) FILTER (WHERE driven >= 2) * {_M} AS multitask_min, max(driven) AS peak_sessions_driven,
 {_label('first(bucket ORDER BY driven DESC, bucket)', '%a %m-%d %H:%M')} AS peak_at, max(autonomous) AS peak_autonomous_sessions,
 {_label('first(bucket ORDER BY autonomous DESC, bucket)', '%a %m-%d %H:%M')} AS peak_autonomous_at FROM vec) v""",
    "activity_by_project": f"""{_SESS}, d AS (SELECT project, count(DISTINCT bucket) * {_M} AS active_min FROM cells c JOIN sess USING (session_id) WHERE NOT headless AND c.human > 0 GROUP BY 1)
SELECT project, count(*) FILTER (WHERE NOT headless) AS sessions, count(*) FILTER (WHERE headless) AS headless_sessions,
 CAST(coalesce(sum(human_turns) FILTER (WHERE NOT headless), 0) AS BIGINT) AS human_turns, CAST(0 AS BIGINT) AS turn_min, coalesce(any_value(active_min), 0) AS active_min FROM sess LEFT JOIN d USING (project) GROUP BY 1""",
    "activity_days": f"""{_VEC}, al AS (SELECT b AS bucket, {_local('b')} AS lt, coalesce(driven, 0) AS driven, coalesce(human, 0) AS human, coalesce(agent, 0) AS agent
  FROM range({WINDOW.buckets}) r(b) LEFT JOIN vec ON vec.bucket = b),
hh AS (SELECT CAST(lt AS DATE) AS d, h.h, CAST(coalesce(sum(human) FILTER (WHERE hour(lt) = h.h), 0) AS BIGINT) AS hu, CAST(coalesce(sum(agent) FILTER (WHERE hour(lt) = h.h), 0) AS BIGINT) AS ag FROM al, range(24) h(h) GROUP BY 1, 2),
dr AS (SELECT CAST({_local('bucket')} AS DATE) AS d, hour({_local('bucket')}) AS h, count(DISTINCT session_id) AS n FROM cells c JOIN sess USING (session_id) WHERE NOT headless AND c.human > 0 GROUP BY 1, 2),
ar AS (SELECT hh.d, string_agg(CAST(hu AS VARCHAR), ',' ORDER BY hh.h) AS a, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY hh.h) AS b, string_agg(CAST(ag AS VARCHAR), ',' ORDER BY hh.h) AS c FROM hh LEFT JOIN dr ON dr.d = hh.d AND dr.h = hh.h GROUP BY 1),
su AS (SELECT CAST(lt AS DATE) AS d, count(*) FILTER (WHERE driven >= 1) * {_M} AS active_min, count(*) FILTER (WHERE driven >= 2) * {_M} AS multitask_min, max(driven) AS peak,
  CASE WHEN max(driven) > 0 THEN strftime(first(lt ORDER BY driven DESC, bucket), '%H:%M') END AS peak_at FROM al GROUP BY 1)
SELECT CAST(su.d AS VARCHAR) AS date, strftime(su.d, '%a %m-%d') AS label, active_min, multitask_min, peak, peak_at, a AS human_turns_by_hour, b AS sessions_driven_by_hour, c AS agent_turns_by_hour FROM su JOIN ar USING (d)""",
    "agent_reconcile": f"""{_EV}, dp AS (SELECT * FROM ev WHERE kind_of = 'call' AND agent_id IS NULL AND tool_name = 'Agent'),
made AS (SELECT session_id, count(*) AS n, max(event_id) AS newest, arg_min(tool_use_id, event_id) AS oldest, any_value(user_id) AS user_id FROM dp GROUP BY 1),
fl AS (SELECT session_id, count(DISTINCT agent_id) AS f FROM ev WHERE agent_id IS NOT NULL GROUP BY 1),
sp AS (SELECT m.session_id, max(event_id) AS named FROM made m JOIN dp ON dp.session_id = m.session_id AND dp.tool_use_id = m.oldest GROUP BY 1),
b AS (SELECT *, coalesce(n, 0) AS k, coalesce(f, 0) AS g FROM made FULL JOIN fl USING (session_id) LEFT JOIN sp USING (session_id))
SELECT session_id, 'dispatched' AS source, CAST(1 AS BIGINT) AS agents, CASE WHEN user_id % 2 = 0 THEN named ELSE newest END * {calls.CALL_STRIDE} AS call_no FROM b WHERE k > 0 AND g > 0
UNION ALL SELECT session_id, 'dispatch_only', k - CASE WHEN g > 0 THEN 1 ELSE 0 END, NULL FROM b WHERE k - CASE WHEN g > 0 THEN 1 ELSE 0 END > 0
UNION ALL SELECT session_id, 'orphan', g, NULL FROM b WHERE k = 0""",
    "agents_present": f"""{_EV}, m AS (SELECT session_id, count(*) AS n FROM ev WHERE kind_of = 'call' AND agent_id IS NULL AND tool_name = 'Agent' GROUP BY 1
 UNION ALL SELECT session_id, count(DISTINCT agent_id) FROM ev WHERE agent_id IS NOT NULL GROUP BY 1) SELECT session_id, CAST(sum(n) AS BIGINT) AS agents_present FROM m GROUP BY 1""",
    "agent_bodies": f"""{_EV} SELECT agent_id, count(*) AS entry_count, CAST(coalesce(sum(CAST(floor(value * 1000) AS BIGINT)) FILTER (WHERE kind_of IN ('call', 'talk')), 0) AS BIGINT) AS input_tokens,
 count(*) FILTER (WHERE kind_of IN ('call', 'talk')) * 10 AS output_tokens, count(*) FILTER (WHERE kind_of = 'call') AS tools,
 coalesce(arg_max('looking at ' || k, event_id) FILTER (WHERE kind_of = 'talk'), '') AS last_text FROM ev WHERE agent_id IS NOT NULL GROUP BY 1""",
    "dedup_sessions": """SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'main' WHEN o_orderkey % 2 = 0 THEN 'linked' ELSE 'orphan' END AS worktree,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE 0.0 END AS o_totalprice FROM orders""",
}
