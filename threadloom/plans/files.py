"""Registered queries over files that Spark writes from the given tables and reads again, over copies, and over ids."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.entry_text import with_texts
from threadloom.operators import activity as ACT
from threadloom.operators import agents, calls, lineage, resolve
from threadloom.plans import events
from threadloom.plans import user_queries as Q
from threadloom.session import cut_lineage, new_folder
from threadloom.sources import sinks, tables
from threadloom.sources import transcripts as TR

AS_OF = datetime(2024, 3, 1, tzinfo=timezone.utc)


def _written(spark: SparkSession, rows: DataFrame, order: list[str], column: str = "value") -> str:
    folder = new_folder(spark)
    sinks.write_lines(rows, folder, column, order)
    return folder


def written_lines(spark, d):
    """Lines as they stand in text files that were written in order of transcript and line."""
    rows = tables.event_lines(spark, d).select(
        "file_path", "line_no", F.concat_ws("|", F.regexp_extract("file_path", "([^/]+)\\.jsonl", 1), "line_no", F.md5(F.get_json_object("value", "$.uuid"))).alias("line"))
    return sinks.read_lines(spark, _written(spark, rows, ["file_path", "line_no"], "line")).select("pos", F.col("value").alias("line"))


def survey_files(spark, d):
    """Failed results per session, from files of which only those with a flagged result are parsed."""
    folder = _written(spark, tables.event_lines(spark, d), ["file_path", "line_no"])
    found = TR.paths_containing(spark, folder, V.FLAGGED_LITERAL, suffix="txt")
    lines = TR.scan_lines(spark, found, suffix="txt") if found else TR.no_lines(spark)
    lines = lines.withColumns({"session_id": F.get_json_object("value", "$.sessionId"), "agent_id": F.lit(None).cast("string")})
    failed = TR.entries(lines).select("session_id", F.explode("blocks").alias("b")).where("b.is_error")
    return failed.groupBy("session_id").agg(F.count(F.lit(1)).alias("errors"))


# --- copies ---------------------------------------------------------------------------------------------------------


def copied_tool_counts(spark, d):
    """Calls per tool where some agents' transcripts are copies, which their provenance lines tell: each call counts once."""
    lines = cut_lineage(tables.copied_lines(spark, d))
    entries = Q.own(TR.entries(lines), TR.provenance(lines))
    return calls.tool_counts(calls.uses(entries).withColumn("short_name", F.col("tool_name")), ["project"])


def copied_audit(spark, d):
    """Agents with calls of a tool, where some agents' transcripts are copies."""
    lines = cut_lineage(tables.copied_lines(spark, d))
    return Q.audit_tools(cut_lineage(TR.entries(lines)), "query", copies=cut_lineage(TR.provenance(lines)))[0]


def _files(lines: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    return TR.transcripts(lines.withColumn("file_mtime", F.lit(None).cast("timestamp")), copies)


def _typed(files: DataFrame) -> DataFrame:
    """Ids as users type them: in full, cut, too short and unknown, of sessions and of agents."""
    ids = files.select(F.coalesce("agent_id", "session_id").alias("id")).distinct()
    return ids.select(F.explode(F.array(
        "id", F.substring("id", 1, 7), F.substring("id", 1, 8), F.substring("id", 1, V.MIN_ID - 1), F.concat(F.lit("zz"), F.substring("id", 5, 8)))).alias("raw_id")).distinct()


def removal_report(spark, d):
    """What may be removed: copies that have not grown, named by an id that names one thing."""
    lines = cut_lineage(tables.copied_lines(spark, d))
    copies = cut_lineage(TR.provenance(lines))
    files = cut_lineage(_files(lines, copies))
    told = resolve.resolve_artifacts(_typed(files), files)
    return lineage.removal_report(told, lineage.with_growth(copies, files.select("file_path", "n_lines", "file_mtime", "agent_id"), AS_OF))


def stale_copies(spark, d):
    """Copies of agents that nobody built upon, older than sixty days."""
    lines = cut_lineage(tables.copied_lines(spark, d))
    copies = cut_lineage(TR.provenance(lines))
    grown = lineage.with_growth(copies, _files(lines, copies).select("file_path", "n_lines", "file_mtime", "agent_id"), AS_OF)
    return lineage.stale_copies(grown, 60 * 86_400.0).select("agent_id", F.col("source_id"), F.round(F.col("age_seconds") / 86_400).cast("bigint").alias("age_days"))


# --- ids of sessions and agents ----------------------------------------------------------------------------------


def resolve_artifacts(spark, d):
    files = cut_lineage(_files(tables.event_lines(spark, d)))
    return resolve.resolve_artifacts(_typed(files), files).select("raw_id", F.col("candidates").cast("bigint").alias("candidates"), "status", "kind", "full_id")


def narrow_artifacts(spark, d):
    """Sessions that are named in full, or that hold an agent named by a prefix."""
    files = cut_lineage(_files(tables.event_lines(spark, d)))
    number = F.conv(F.substring("session_id", 1, 8), 16, 10).cast("bigint")
    some = files.where(number % 7 == 0).select("session_id").unionByName(files.where((number % 5 == 0) & F.col("agent_id").isNotNull()).select(F.substring("agent_id", 1, 17).alias("session_id")))
    return resolve.narrow_to_artifact_ids(files, some.select(F.col("session_id").alias("raw_id")).distinct())


# --- dispatches -----------------------------------------------------------------------------------------------------


def agent_states(spark, d):
    """Dispatches whose results are of every kind, with the notifications that follow some of them."""
    e = cut_lineage(TR.entries(tables.dispatch_lines(spark, d)))
    found = agents.dispatch_results(e)
    return found.select("session_id", "tool_use_id", F.coalesce("agent_id", F.lit("")).alias("agent_id"), "status", "result_text", "total_tokens", "total_tool_use_count")


def activity_agent_time(spark, d):
    """Sessions whose agents hear from people and tell how long they took: an agent's time counts where it was active itself."""
    e = cut_lineage(with_texts(TR.entries(tables.timed_lines(spark, d))))
    rows = ACT.session_rows(e, events.WINDOW)
    return rows.select("session_id", "human_turns", "agent_turns", "n_sub", "turn_min", "human_active_min", "agent_only_min")


QUERIES = {f.__name__: f for f in (
    written_lines, survey_files, copied_tool_counts, copied_audit, removal_report, stale_copies, resolve_artifacts, narrow_artifacts, agent_states,
    activity_agent_time)}

# --- the same in SQL ------------------------------------------------------------------------------------------------

_EV = events.EV
_FILE = "project || '/' || session_id || coalesce('/subagents/agent-' || agent_id, '')"
#: Every third user has a copy of an agent, with the lines of its events whose number ends in 1; those of odd users grew.
_COPIES = f"""{_EV}, cp AS (SELECT user_id, session_id, printf('c%016x', user_id) AS agent_id, user_id % 2 = 1 AND count(*) FILTER (WHERE event_id % 10 = 1) > 0 AS grown
 FROM ev WHERE user_id % 3 = 0 GROUP BY 1, 2)"""
_IDS = f"""fl AS (SELECT DISTINCT session_id AS full_id, 'session' AS kind FROM ev UNION SELECT DISTINCT agent_id, 'subagent' FROM ev WHERE agent_id IS NOT NULL)"""
_MAIN = "SELECT DISTINCT session_id FROM ev WHERE agent_id IS NULL"


def _resolved(files: str, ids: str) -> str:
    """Common table expressions: typed ids and what they name, from named files(full_id, kind) and ids(id)."""
    return f"""ty AS (SELECT DISTINCT unnest([id, left(id, 7), left(id, 8), left(id, {V.MIN_ID - 1}), 'zz' || substr(id, 5, 8)]) AS raw_id FROM {ids}),
rs AS (SELECT raw_id, count(full_id) AS n, min(kind) AS kind, min(full_id) AS full_id FROM ty LEFT JOIN {files} f ON length(raw_id) >= {V.MIN_ID} AND CASE WHEN length(raw_id) >= {V.FULL_ID} AND length(full_id) >= {V.FULL_ID} THEN full_id = raw_id ELSE starts_with(full_id, raw_id) OR starts_with(raw_id, full_id) END GROUP BY 1),
st AS (SELECT raw_id, n, CASE WHEN length(raw_id) < {V.MIN_ID} THEN 'too_short' WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status,
 CASE WHEN n = 1 THEN kind END AS kind, CASE WHEN n = 1 THEN full_id END AS full_id FROM rs)"""


ORACLES = {
    "written_lines": f"""{_EV} SELECT row_number() OVER (ORDER BY {_FILE.replace("project", "'/logs/' || project")} || '.jsonl', event_id) - 1 AS pos,
 coalesce('agent-' || agent_id, session_id) || '|' || event_id || '|' || md5(printf('%08x{tables.TURN_TAIL}', event_id)) AS line FROM ev""",
    "survey_files": f"{_EV} SELECT session_id, count(*) AS errors FROM ev WHERE event_type = 'error' GROUP BY 1",
    "copied_tool_counts": f"{_EV} SELECT project, tool_name AS short_name, count(*) AS calls FROM ev WHERE kind_of = 'call' GROUP BY 1, 2",
    "copied_audit": f"""{events.PAIRS} SELECT session_id, agent_id, count(*) AS calls, count(*) FILTER (WHERE contains(tool_name, 'query')) AS rows,
 count(*) FILTER (WHERE contains(tool_name, 'query') AND {events.ERR}) AS errors, count(DISTINCT short_name) AS tools FROM tc WHERE agent_id IS NOT NULL GROUP BY 1, 2""",
    "removal_report": f"""{_COPIES}, {_IDS}, al AS (SELECT * FROM fl UNION SELECT agent_id, 'subagent' FROM cp), nm AS (SELECT agent_id AS id FROM ev WHERE agent_id IS NOT NULL UNION SELECT agent_id FROM cp UNION {_MAIN}),
{_resolved('al', 'nm')},
rr AS (SELECT st.*, CASE WHEN status <> 'unique' THEN status WHEN kind = 'session' THEN 'session' WHEN grown IS NULL THEN 'not_an_artifact' WHEN grown THEN 'grown' END AS reason FROM st LEFT JOIN cp ON cp.agent_id = st.full_id)
SELECT raw_id, kind, full_id, CASE WHEN reason IS NULL THEN 'deletable' ELSE 'refused' END AS decision, reason FROM rr""",
    "stale_copies": f"""{_COPIES} SELECT agent_id, session_id AS source_id, 60 + user_id % 5 - 2 AS age_days FROM cp WHERE NOT grown AND user_id % 5 > 2""",
    "resolve_artifacts": f"{_EV}, {_IDS}, nm AS (SELECT agent_id AS id FROM ev WHERE agent_id IS NOT NULL UNION {_MAIN}), {_resolved('fl', 'nm')} SELECT raw_id, n AS candidates, status, kind, full_id FROM st",
    "narrow_artifacts": f"""{_EV} SELECT DISTINCT session_id FROM ev WHERE user_id % 7 = 0
UNION SELECT DISTINCT session_id FROM ev WHERE user_id % 5 = 0 AND agent_id IS NOT NULL""",
    "activity_agent_time": f"""{events.ACTIVE}, sub AS (SELECT session_id, (epoch_us(ts) - {events.LO}) // {events.B} AS bucket FROM ev
  WHERE event_type = 'signup' AND event_id % 3 = 0 AND epoch_us(ts) >= {events.LO} AND epoch_us(ts) < {events.HI}),
mk AS (SELECT session_id, bucket, human, marker FROM marks UNION ALL SELECT session_id, bucket, false, 'subh' FROM sub),
c2 AS (SELECT session_id, bucket, count(*) FILTER (WHERE human) AS human, count(DISTINCT marker) AS agent FROM mk WHERE human OR marker IS NOT NULL GROUP BY 1, 2),
su AS (SELECT session_id, CAST(sum(human) AS BIGINT) AS human_turns, CAST(sum(agent) AS BIGINT) AS agent_turns, count(*) FILTER (WHERE human > 0) * {events.M} AS human_active_min,
  count(*) FILTER (WHERE human = 0 AND agent > 0) * {events.M} AS agent_only_min FROM c2 GROUP BY 1),
tm AS (SELECT session_id, sum(event_id * 50) FILTER (WHERE event_type = 'view') AS own, sum(event_id * 10) FILTER (WHERE event_type = 'click') AS theirs
  FROM ev WHERE event_id % 2 = 0 AND epoch_us(ts) >= {events.LO} AND epoch_us(ts) < {events.HI} GROUP BY 1),
ag AS (SELECT session_id, count(DISTINCT agent_id) FILTER (WHERE marker IS NOT NULL) AS n FROM marks GROUP BY 1),
hd AS (SELECT DISTINCT session_id, 1 AS one FROM sub)
SELECT session_id, human_turns, agent_turns, coalesce(n, 0) + coalesce(one, 0) AS n_sub, CAST(round_even((coalesce(own, 0) + coalesce(theirs * one, 0)) / 60000, 0) AS BIGINT) AS turn_min,
 human_active_min, agent_only_min FROM su LEFT JOIN tm USING (session_id) LEFT JOIN ag USING (session_id) LEFT JOIN hd USING (session_id)""",
    "agent_states": f"""{_EV} SELECT session_id, 'toolu_' || event_id AS tool_use_id, CASE WHEN event_id % 5 < 3 THEN printf('b%016x', event_id) ELSE '' END AS agent_id,
 CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 3 THEN 'rejected' WHEN 4 THEN 'unknown' ELSE 'finished' END AS status,
 CASE event_id % 5 WHEN 0 THEN 'answer ' || event_id WHEN 1 THEN 'late ' || event_id WHEN 2 THEN 'late ' || event_id ELSE '' END AS result_text,
 CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 WHEN 2 THEN event_id + 1 END AS total_tokens, CAST(CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 4 END AS BIGINT) AS total_tool_use_count
FROM ev WHERE event_type = 'click'""",
}
