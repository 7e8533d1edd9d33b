"""Registered queries over `conversations` read as transcripts, each with its SQL twin."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.functions.entry_text import display, entry_line, with_display, with_texts
from threadloom.functions.ids import id8
from threadloom.functions.tools import input_one_line, tool_input_summary
from threadloom.operators import debate, lineage, search, sessions
from threadloom.operators import resolve as R
from threadloom.operators.agents import trace_lines
from threadloom.operators.calls import uses
from threadloom.plans import sql
from threadloom.session import cut_lineage
from threadloom.sources import projects, tables
from threadloom.sources.transcripts import entries as typed_entries
from threadloom.sources.transcripts import rejects
from threadloom.sources.transcripts import transcripts

PATTERNS = ["the", "der|die", "qu.e", "zebra"]
PATTERN = "on"
AS_OF = datetime(2024, 6, 1, tzinfo=timezone.utc)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return typed_entries(tables.conversation_lines(spark, d))


def _entry_table(spark: SparkSession, d: str) -> DataFrame:
    """The entries written once, for queries that read them more than once."""
    return cut_lineage(_entries(spark, d))


def _text_table(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(with_texts(_entries(spark, d)))


def _turn_table(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(lineage.turns(tables.conversation_lines(spark, d)))


def pattern_triage(spark, d):
    return search.pattern_rollup(search.count_hits(_entries(spark, d), PATTERNS, "all"))


def triage_sessions(spark, d):
    return search.triage(_entries(spark, d), PATTERNS, "user").drop("pattern_no", "agent_id")


def pattern_examples(spark, d):
    found = search.triage(_entries(spark, d), PATTERNS, "all")
    return search.pattern_examples(found).select("pattern", "rank", "session_id", "hits", "excerpt")


def grep_context(spark, d):
    lines = search.grep(_text_table(spark, d), PATTERNS, "user", context=2, cap=2)
    return lines.select("pattern", "session_id", "hit_no", "offset", "hits", "line")


def overflow_sample(spark, d):
    found = search.overflow_sample(_entry_table(spark, d), PATTERN, "all", cap=30)
    return found.select("session_id", "line_no", "rank_in_session", "total_matches", "overflow")


def read_turn(spark, d):
    e = _entry_table(spark, d)
    anchors = e.where((F.col("entry_type") == "system")).select("file_path", "line_no", F.col("uuid").alias("anchor"))
    return search.read_turn(e, anchors, 2).select("anchor", "offset", "uuid")


def _browse(position):
    def run(spark, d):
        page = search.browse(_entries(spark, d), position, 3)
        return page.select("session_id", "place", "uuid", "total_turns")
    return run


def _anchored(position):
    def run(spark, d):
        e = _entry_table(spark, d)
        talk = e.where(F.col("entry_type").isin("human", "assistant"))
        # The third turn of each transcript, found by an aggregate.
        at = talk.where(F.col("line_no") >= 2).groupBy("file_path").agg(F.min("line_no").alias("line_no"))
        page = search.browse_anchored(e, at, position, 2)
        return page.select("session_id", "turn_no", "uuid", "total_turns")
    return run


def session_titles(spark, d):
    return sessions.session_titles(_entries(spark, d))


def transcript_stats(spark, d):
    return sessions.transcript_stats(_entries(spark, d), ["session_id"])


def session_summary(spark, d):
    s = sessions.session_summary(_entries(spark, d))
    return s.select("project", "session_id", "title", "message_count", "user_turns", "tool_use_count", "agent_count",
                    "context_tokens", "input_tokens", "output_tokens", "duration_ms",
                    F.unix_timestamp("first_ts").alias("first_epoch"))


def session_list(spark, d):
    s = sessions.session_summary(_entries(spark, d))
    after = datetime.fromtimestamp(tables.EPOCH + 5 * 3600, timezone.utc)
    rows = sessions.list_sessions(s, after=after, min_tools=1, current="00000007" + tables.SESSION_TAIL)
    return rows.select("session_id", "message_count", "tool_use_count", "is_current")


def entry_texts(spark, d):
    rows = with_texts(_entries(spark, d)).where(F.col("entry_type").isin("human", "assistant"))
    md5 = lambda c: F.md5(F.coalesce(F.col(c), F.lit("")))
    return rows.select("uuid", "origin", md5("body_text").alias("body"), md5("marker_text").alias("marker"),
                       md5("substantive_text").alias("said"), md5("thinking_text").alias("thinking"),
                       md5("tool_text").alias("tools"))


def entry_display(spark, d):
    rows = with_display(with_texts(_entries(spark, d))).where(F.col("entry_type").isin("human", "assistant"))
    return rows.select("uuid", "display_len", F.md5("display").alias("full"), display(80).alias("cut"))


def entry_lines(spark, d):
    rows = with_display(with_texts(_entries(spark, d)), frozenset({"thinking"})).where(F.col("entry_type").isin("human", "assistant"))
    return rows.select("session_id", "line_no", entry_line(F.col("display"), id8(F.col("uuid"))).alias("line"))


def tool_inputs(spark, d):
    made = uses(_entries(spark, d))
    return made.select("tool_use_id", "tool_name", tool_input_summary(F.col("tool_name"), F.col("input_json"), 60).alias("summary"),
                       input_one_line(F.col("input_json"), 80).alias("one_line"))


def trace(spark, d):
    rows = trace_lines(_entries(spark, d), truncate=60)
    return rows.select("session_id", "line_no", "item", "sub", "line")


def relinearized(spark, d):
    rows = lineage.turns(tables.conversation_lines(spark, d))
    return lineage.relinearize(rows).select("uuid", "parent_uuid")


def trimmed_tail(spark, d):
    """Turns of odd length play the noise: their text is blanked before the trim."""
    rows = lineage.turns(tables.conversation_lines(spark, d))
    blank = F.when((F.col("type") == "user") & (F.length("text") % 2 == 1), "").otherwise(F.col("text"))
    return lineage.trim_tail(rows.withColumn("text", blank)).select("uuid")


def resumable_tail(spark, d):
    rows = lineage.turns(tables.conversation_lines(spark, d))
    return lineage.trim_tail(rows, resumable=True).select("uuid")


def tail_state(spark, d):
    rows = lineage.turns(tables.conversation_lines(spark, d))
    return lineage.tail_state(rows)


def active_thread(spark, d):
    rows = _turn_table(spark, d)
    return lineage.active_thread(rows).select("uuid", "chain_no", "dropped", "is_thread")


def ancestor_chain(spark, d):
    rows = _turn_table(spark, d)
    targets = rows.where(F.col("type") == "user").groupBy("file_path").agg(F.max("line_no").alias("line_no"))
    chain = lineage.ancestor_chain(rows, targets.withColumn("key", F.col("file_path")))
    return chain.join(rows.select("file_path", "line_no", "uuid"), ["file_path", "line_no"]).select("uuid", "chain_no")


def rewind_report(spark, d):
    """Every transcript is rewound to before its last user turn."""
    rows = _turn_table(spark, d)
    at = rows.where(F.col("type") == "user").groupBy("file_path").agg(F.max_by("uuid", "line_no").alias("turn"))
    requests = at.select(F.col("file_path").alias("request_id"), "file_path", "turn", F.lit("before").alias("cut"))
    _, report = lineage.rewind_view(rows, requests)
    return report.select("turn", "status", "turns_before", "turns_after", "removed_after_cut", "trimmed_trailing", "trimmed_calls", "tail_state")


def rewind_statuses(spark, d):
    """Rewinds to the first user turn that go wrong in every way, by number of the conversation: a turn that is unknown, was
    removed by an earlier rewind, is named by a prefix of two, or stands twice; one before which nothing is; and one that is fine."""
    rows = _turn_table(spark, d)
    number = F.conv(F.regexp_extract("file_path", "/([0-9a-f]{8})[^/]*$", 1), 16, 10).cast("bigint")
    first = cut_lineage(rows.where(F.col("type") == "user").groupBy("file_path").agg(F.min_by("uuid", "line_no").alias("turn")).withColumn("kind", number % 6))
    marked = rows.join(first, "file_path")
    again = marked.where("uuid = turn").withColumn("line_no", F.col("line_no") + 1000)
    twice = again.where("kind = 3").unionByName(again.where("kind = 2").withColumn("uuid", F.concat(F.substring("uuid", 1, 8), F.lit("-other"))))
    rows = cut_lineage(rows.unionByName(twice.select(*rows.columns)))
    typed = F.when(F.col("kind") < 2, "ffffffff").when(F.col("kind") == 2, F.substring("turn", 1, 8)).otherwise(F.col("turn"))
    requests = first.select(F.col("file_path").alias("request_id"), "file_path", typed.alias("turn"), F.when(F.col("kind") == 4, "before").otherwise("after").alias("cut"))
    copies = first.where("kind = 1").select("file_path", F.concat(F.lit("ffffffff"), F.lit(tables.TURN_TAIL)).alias("rewound_to"))
    _, report = lineage.rewind_view(rows, requests, copies)
    return report.select(F.regexp_extract("file_path", "([^/]+)\\.jsonl$", 1).alias("session_id"), "turn", "status")


def thread_copy(spark, d):
    rows = _turn_table(spark, d)
    requests = rows.select("file_path").distinct().select(
        "file_path", F.regexp_extract("file_path", "([^/]+)\\.jsonl$", 1).alias("source_id"), F.lit("p").alias("source_project"),
        F.concat(F.lit("a"), F.md5("file_path")).alias("new_id"), F.lit("parent").alias("parent_session"),
    )
    copy = lineage.thread_copy(rows, requests, to_agent=True)
    return copy.select("uuid", "parent_uuid", "chain_no", "session_id",
                       F.array_join(F.transform("lineage", lambda h: F.concat_ws("=", h["as"], h["id"])), ",").alias("hops"))


def model_stats(spark, d):
    rows = sessions.model_stats(_entries(spark, d), ["project"])
    return rows.select("project", F.explode("counts").alias("model", "n"))


def environment(spark, d):
    rows = sessions.environment(_entries(spark, d), ["session_id"], AS_OF)
    return rows.select("session_id", "original_cwd", "original_branch", "version", "age_days")


def project_list(spark, d):
    lines = tables.conversation_lines(spark, d)
    stamp = F.timestamp_seconds(F.lit(tables.EPOCH) + F.col("line_no"))
    files = transcripts(lines.withColumn("file_mtime", stamp))
    found = projects.discover_projects(files, projects.project_cwd(lines))
    return found.select("project", "name", "sessions", F.unix_timestamp("last_active").alias("last_epoch"))


def resolve_ids(spark, d):
    """Every session is asked for by a prefix of its id; short prefixes collide."""
    s = cut_lineage(sessions.session_summary(_entries(spark, d)).select("session_id", "project", "message_count"))
    wanted = s.select(F.substring("session_id", 1, 7).alias("raw_id")).distinct()
    return R.resolve_sessions(wanted, s).select("raw_id", "candidates", "status")


def debate_live_moves(spark, d):
    return debate.live_moves(tables.moves(spark, d))


def debate_end_state(spark, d):
    return debate.end_state(tables.moves(spark, d))


def line_rejects(spark, d):
    """Lines with text after the object, a second object, an unknown type, or no id, among whole ones."""
    k, v = F.col("line_no") % 6, F.col("value")
    spoilt = (
        F.when(k == 0, F.concat(v, F.lit(" x"))).when(k == 1, F.concat(v, F.lit(",{}")))
        .when(k == 2, F.lit('{"type":"odd"}')).when(k == 3, F.replace(v, F.lit('"uuid":'), F.lit('"id":'))).otherwise(v)
    )
    return rejects(tables.conversation_lines(spark, d).withColumn("value", spoilt))


def hidden_inputs(spark, d):
    return search.count_hits(_entries(spark, d), PATTERNS, "assistant", frozenset({"inputs", "thinking"})).groupBy("pattern").agg(
        F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("sessions"))


def sessions_before(spark, d):
    s = sessions.session_summary(_entries(spark, d))
    before = datetime.fromtimestamp(tables.EPOCH + 40 * 3600, timezone.utc)
    return sessions.list_sessions(s, before=before).select("session_id", "message_count")


#: Ids a user typed: a prefix, a full id, and one of no session.
#: An id by prefix, one in full, one that names none, and one that names several.
TYPED = ["00000003", "00000001" + tables.SESSION_TAIL, "ffffffff", "0000000"]


def grep_sessions(spark, d):
    found, missing = search.grep_sessions(_entry_table(spark, d), TYPED, PATTERNS, role="all", context=0, cap=2)
    # The totals of `grep` are those of all hits, however few of them are shown.
    per = found.groupBy("id_pos", "session_id", "pattern").agg(F.max("hits").alias("hits"), F.count(F.lit(1)).alias("lines"))
    return per.unionByName(missing.select(
        "id_pos", F.col("raw_id").alias("session_id"), F.col("status").alias("pattern"), F.col("candidates").cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("lines")))


QUERIES = {
    "pattern_triage": pattern_triage,
    "triage_sessions": triage_sessions,
    "pattern_examples": pattern_examples,
    "grep_context": grep_context,
    "overflow_sample": overflow_sample,
    "read_turn": read_turn,
    "browse_head": _browse("head"),
    "browse_tail": _browse("tail"),
    "browse_anchor_tail": _anchored("tail"),
    "browse_anchor_head": _anchored("head"),
    "session_titles": session_titles,
    "transcript_stats": transcript_stats,
    "session_summary": session_summary,
    "session_list": session_list,
    "entry_texts": entry_texts,
    "entry_display": entry_display,
    "entry_lines": entry_lines,
    "tool_inputs": tool_inputs,
    "trace_lines": trace,
    "relinearized": relinearized,
    "trimmed_tail": trimmed_tail,
    "resumable_tail": resumable_tail,
    "tail_state": tail_state,
    "active_thread": active_thread,
    "ancestor_chain": ancestor_chain,
    "rewind_report": rewind_report,
    "rewind_statuses": rewind_statuses,
    "thread_copy": thread_copy,
    "model_stats": model_stats,
    "environment": environment,
    "project_list": project_list,
    "resolve_ids": resolve_ids,
    "debate_live_moves": debate_live_moves,
    "debate_end_state": debate_end_state,
    "line_rejects": line_rejects,
    "hidden_inputs": hidden_inputs,
    "sessions_before": sessions_before,
    "grep_sessions": grep_sessions,
}

# --- the same in SQL -----------------------------------------------------------------------------------------

_HITS = f"""
hits AS (
  SELECT c.*, p.n AS pattern_no, p.p AS pattern FROM conv c, (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS))}) p(n, p)
  WHERE (entry_type = 'human' AND regexp_matches(body, p.p, 'i'))
     OR (entry_type = 'assistant' AND (regexp_matches(body, p.p, 'i') OR regexp_matches(tool_text, p.p, 'i') OR regexp_matches(thinking, p.p, 'i')))
)"""
_CONV = sql.CONV
_TRIAGE = f"""
shown AS (SELECT *, {sql.collapse('display')} AS t, regexp_extract({sql.collapse('display')}, pattern, 0, 'i') AS m FROM hits WHERE ROLE_FILTER),
placed AS (SELECT *, CASE WHEN m = '' THEN NULL ELSE strpos(t, m) - 1 END AS ms FROM shown),
{sql.excerpt_steps('placed', 'excerpted')}
"""

_CHAIN = """
kin AS (SELECT conv_id, turn, role, uuid, CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END AS parent
        FROM conv WHERE role IN ('user','assistant')),
tips AS (TIPS),
walk AS (
  SELECT t.conv_id, t.turn, 0 AS away FROM tips t
  UNION ALL
  SELECT w.conv_id, p.turn, w.away + 1 FROM walk w JOIN kin k ON k.conv_id = w.conv_id AND k.turn = w.turn
    JOIN kin p ON p.conv_id = k.conv_id AND p.turn = k.parent
)"""
_RCONV = _CONV.replace("WITH conv AS", "WITH RECURSIVE conv AS", 1)
_ALL_TIPS = "SELECT conv_id, max(turn) AS turn FROM kin GROUP BY 1"
_USER_TIPS = "SELECT conv_id, max(turn) AS turn FROM kin WHERE role = 'user' GROUP BY 1"
_ACTIVE = f"""{_RCONV}, {_CHAIN.replace('TIPS)', _ALL_TIPS + ')')},
firsts AS (SELECT conv_id, min(turn) AS first_turn, count(*) AS n FROM kin GROUP BY 1),
ends AS (SELECT w.conv_id, min(w.turn) AS root, max(w.away) AS far FROM walk w GROUP BY 1),
ok AS (SELECT e.conv_id, e.far FROM ends e JOIN firsts f USING (conv_id) JOIN kin k ON k.conv_id = e.conv_id AND k.turn = e.root
       WHERE k.parent IS NULL AND e.root = f.first_turn),
kept AS (
  SELECT k.conv_id, k.turn, k.uuid, CAST(ok.far - w.away + 1 AS BIGINT) AS chain_no, true AS is_thread
  FROM walk w JOIN ok USING (conv_id) JOIN kin k ON k.conv_id = w.conv_id AND k.turn = w.turn
  UNION ALL
  SELECT k.conv_id, k.turn, k.uuid, row_number() OVER (PARTITION BY k.conv_id ORDER BY k.turn), false
  FROM kin k WHERE k.conv_id NOT IN (SELECT conv_id FROM ok)
),
active AS (SELECT k.*, f.n - count(*) OVER (PARTITION BY k.conv_id) AS dropped FROM kept k JOIN firsts f USING (conv_id))"""
_VISIBLE = """vis AS (
  SELECT *, count(*) FILTER (WHERE entry_type IN ('human','assistant')) OVER (PARTITION BY conv_id ORDER BY turn) AS v,
         entry_type IN ('human','assistant') AS visible FROM conv)"""

ORACLES = {
    "pattern_triage": f"""{_CONV}, {_HITS}
SELECT pattern, count(*) AS hits, count(DISTINCT project) AS projects, count(DISTINCT session_id) AS sessions FROM hits GROUP BY pattern""",
    "triage_sessions": f"""{_CONV}, {_HITS}, {_TRIAGE.replace('ROLE_FILTER', "entry_type = 'human'")}
SELECT pattern, project, session_id, count(*) AS hits, arg_min(excerpt, turn) AS excerpt FROM excerpted GROUP BY ALL""",
    "pattern_examples": f"""{_CONV}, {_HITS}, {_TRIAGE.replace('ROLE_FILTER', 'true')},
per AS (SELECT pattern, session_id, count(*) AS hits, arg_min(excerpt, turn) AS excerpt FROM excerpted GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pattern ORDER BY hits DESC, session_id) AS INTEGER) AS rank FROM per) WHERE rank <= 10""",
    "grep_context": f"""{_CONV}, {_HITS},
vis AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conv WHERE entry_type = 'human'),
mine AS (SELECT * FROM hits WHERE entry_type = 'human'),
cell AS (SELECT m.*, v.v, CAST(row_number() OVER (PARTITION BY m.session_id, m.pattern ORDER BY m.turn) AS INTEGER) AS hit_no,
         count(*) OVER (PARTITION BY m.session_id, m.pattern) AS cell_hits FROM mine m JOIN vis v USING (conv_id, turn)),
top AS (SELECT * FROM cell WHERE hit_no <= 2),
shown AS (SELECT *, {sql.collapse('display')} AS t, regexp_extract({sql.collapse('display')}, pattern, 0, 'i') AS m FROM top),
placed AS (SELECT *, CASE WHEN m = '' THEN NULL ELSE strpos(t, m) - 1 END AS ms FROM shown),
{sql.excerpt_steps('placed', 'excerpted')}
SELECT pattern, session_id, hit_no, 0 AS "offset", cell_hits AS hits,
  left(uuid, 8) || '|' || epoch_s || '|U|' || length(display) || '|' || replace(excerpt, chr(10), '\\n') AS line FROM excerpted
UNION ALL
SELECT t.pattern, t.session_id, t.hit_no, CAST(n.v - t.v AS INTEGER), t.cell_hits,
  left(n.uuid, 8) || '|' || n.epoch_s || '|U|' || length(n.display) || '|' || replace({sql.truncate('n.display', 150)}, chr(10), '\\n')
FROM top t JOIN vis n ON n.conv_id = t.conv_id AND n.v <> t.v AND abs(n.v - t.v) <= 2""",
    "overflow_sample": f"""{_CONV},
h AS (SELECT * FROM conv WHERE (entry_type IN ('human','assistant') AND regexp_matches(body, '{PATTERN}', 'i'))
     OR (entry_type = 'assistant' AND (regexp_matches(tool_text, '{PATTERN}', 'i') OR regexp_matches(thinking, '{PATTERN}', 'i')))),
tot AS (SELECT count(*) AS total, count(DISTINCT session_id) AS n FROM h),
r AS (SELECT session_id, turn AS line_no, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) AS INTEGER) AS rank_in_session FROM h),
s AS (SELECT r.*, tot.total FROM r, tot WHERE rank_in_session <= CASE WHEN tot.total <= 30 THEN 30 ELSE greatest(1, 30 // tot.n) END)
SELECT session_id, line_no, rank_in_session, total AS total_matches, total > 30 AS overflow FROM s ORDER BY session_id, rank_in_session LIMIT 30""",
    "read_turn": f"""{_CONV}, {_VISIBLE},
a AS (SELECT * FROM vis WHERE entry_type = 'system')
SELECT uuid AS anchor, 0 AS "offset", uuid FROM a
UNION ALL SELECT a.uuid, CAST(o.o AS INTEGER), n.uuid FROM a, (VALUES (-2), (-1), (1), (2)) o(o), vis n
WHERE n.conv_id = a.conv_id AND n.visible AND n.v = CASE WHEN o.o < 0 THEN a.v + 1 + o.o ELSE a.v + o.o END""",
    "browse_head": f"""{_CONV}
SELECT session_id, CAST(place AS INTEGER) AS place, uuid, total_turns FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY session_id) AS total_turns
 FROM conv WHERE entry_type IN ('human','assistant')) WHERE place <= 3""",
    "browse_tail": f"""{_CONV}
SELECT session_id, CAST(place AS INTEGER) AS place, uuid, total_turns FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS place, count(*) OVER (PARTITION BY session_id) AS total_turns
 FROM conv WHERE entry_type IN ('human','assistant')) WHERE place <= 3""",
    **{
        f"browse_anchor_{side}": f"""{_CONV},
talk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, count(*) OVER (PARTITION BY conv_id) AS total_turns
  FROM conv WHERE entry_type IN ('human','assistant')),
a AS (SELECT conv_id, min(turn_no) AS a FROM talk WHERE turn >= 2 GROUP BY 1)
SELECT session_id, turn_no, uuid, total_turns FROM talk JOIN a USING (conv_id) WHERE turn_no BETWEEN a {rng}"""
        for side, rng in (("tail", "AND a + 1"), ("head", "- 1 AND a"))
    },
    "session_titles": f"""{_CONV},
f AS (SELECT session_id, arg_min({sql.strip("split_part(body, chr(10), 1)")}, turn) FILTER (WHERE entry_type = 'human' AND body <> '') AS l FROM conv GROUP BY 1)
SELECT session_id, coalesce({sql.truncate('l', 60)}, '(empty session)') AS title FROM f""",
    "transcript_stats": f"""{_CONV}
SELECT session_id, coalesce(arg_max(tokens_in, turn) FILTER (WHERE tokens_in > 0), 0) AS context_tokens,
 CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS output_tokens,
 count(*) FILTER (WHERE tool IS NOT NULL) AS tool_use_count, count(*) FILTER (WHERE tool = 'Agent') AS agent_count,
 nullif((arg_max(epoch_s, turn) - arg_min(epoch_s, turn)) * 1000, 0) AS duration_ms FROM conv GROUP BY 1""",
    "session_summary": f"""{_CONV},
f AS (SELECT project, session_id, arg_min({sql.strip("split_part(body, chr(10), 1)")}, turn) FILTER (WHERE entry_type = 'human' AND body <> '') AS l,
 count(*) FILTER (WHERE entry_type IN ('human','assistant') AND display <> '') AS message_count,
 count(*) FILTER (WHERE entry_type = 'human' AND display <> '') AS user_turns,
 count(*) FILTER (WHERE tool IS NOT NULL) AS tool_use_count, count(*) FILTER (WHERE tool = 'Agent') AS agent_count,
 coalesce(arg_max(tokens_in, turn) FILTER (WHERE tokens_in > 0), 0) AS context_tokens,
 CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS output_tokens,
 nullif((arg_max(epoch_s, turn) - arg_min(epoch_s, turn)) * 1000, 0) AS duration_ms, arg_min(epoch_s, turn) AS first_epoch
 FROM conv GROUP BY 1, 2)
SELECT * EXCLUDE (l), coalesce({sql.truncate('l', 60)}, '(empty session)') AS title FROM f WHERE message_count > 0""",
    "session_list": f"""{_CONV},
f AS (SELECT session_id, count(*) FILTER (WHERE entry_type IN ('human','assistant') AND display <> '') AS message_count,
 count(*) FILTER (WHERE tool IS NOT NULL) AS tool_use_count, arg_min(epoch_s, turn) AS first_epoch FROM conv GROUP BY 1)
SELECT session_id, message_count, tool_use_count, session_id = '00000007{tables.SESSION_TAIL}' AS is_current FROM f
WHERE message_count >= 4 AND tool_use_count >= 1 AND first_epoch >= {tables.EPOCH + 5 * 3600}""",
    "sessions_before": f"""{_CONV},
f AS (SELECT session_id, count(*) FILTER (WHERE entry_type IN ('human','assistant') AND display <> '') AS message_count, arg_min(epoch_s, turn) AS first_epoch FROM conv GROUP BY 1)
SELECT session_id, message_count FROM f WHERE message_count >= 4 AND first_epoch <= {tables.EPOCH + 40 * 3600}""",
    "line_rejects": f"""SELECT '/logs/p' || (conv_id % 5) || '/' || printf('%08x', conv_id) || '{tables.SESSION_TAIL}.jsonl' AS file_path,
 CASE turn % 6 WHEN 2 THEN 'unknown_type' WHEN 3 THEN 'invalid' ELSE 'malformed' END AS reason, count(*) AS n FROM conversations WHERE turn % 6 < 4 GROUP BY 1, 2""",
    "hidden_inputs": f"""{_CONV}
SELECT pattern, count(*) AS hits, count(DISTINCT session_id) AS sessions FROM (SELECT session_id, p AS pattern FROM conv, (VALUES {', '.join(f"('{p}')" for p in PATTERNS)}) v(p)
 WHERE entry_type = 'assistant' AND regexp_matches(body, p, 'i')) GROUP BY 1""",
    "grep_sessions": f"""{_CONV}, {_HITS},
ids(id_pos, raw_id) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(TYPED))}),
named AS (SELECT id_pos, raw_id, count(DISTINCT session_id) AS n FROM ids LEFT JOIN (SELECT * FROM conv WHERE role <> 'system') ON starts_with(session_id, raw_id) GROUP BY ALL)
SELECT CAST(id_pos AS INTEGER) AS id_pos, session_id, pattern, count(*) AS hits, least(2, count(*)) AS lines FROM hits JOIN (SELECT * FROM named WHERE n = 1) ON starts_with(session_id, raw_id) GROUP BY ALL
UNION ALL SELECT CAST(id_pos AS INTEGER), raw_id, CASE WHEN n = 0 THEN 'not_found' ELSE 'ambiguous' END, n, 0 FROM named WHERE n <> 1""",
    "entry_texts": f"""{_CONV}
SELECT uuid, CASE WHEN entry_type = 'human' THEN CASE WHEN body <> '' THEN 'human' ELSE 'command_scaffolding' END END AS origin,
 md5(body) AS body, md5(CASE WHEN entry_type = 'human' THEN text ELSE '' END) AS marker,
 md5(CASE WHEN entry_type = 'human' THEN {sql.strip('body')} ELSE '' END) AS said,
 md5(thinking) AS thinking, md5(tool_text) AS tools FROM conv WHERE entry_type <> 'system'""",
    "entry_display": f"""{_CONV}
SELECT uuid, CAST(length(display) AS INTEGER) AS display_len, md5(display) AS full, CASE WHEN entry_type = 'human' THEN {sql.truncate('body', 80)} ELSE
 concat_ws('  ', CASE WHEN thinking <> '' THEN '[thinking] ' || {sql.truncate('thinking', 80)} END, CASE WHEN body <> '' THEN {sql.truncate('body', 80)} END,
  CASE WHEN tool IS NOT NULL THEN '→ ' || tool || '(' || {sql.truncate('telling', 80)} || ')' END) END AS cut
FROM conv WHERE entry_type <> 'system'""",
    "entry_lines": f"""{_CONV}, b AS (SELECT *, CASE WHEN entry_type = 'human' THEN body ELSE
 concat_ws('  ', nullif(body, ''), CASE WHEN tool IS NOT NULL THEN '→ ' || tool || '(' || input_json || ')' END) END AS shown FROM conv WHERE entry_type <> 'system')
SELECT session_id, turn AS line_no, left(uuid, 8) || '|' || epoch_s || '|' || CASE WHEN entry_type = 'human' THEN 'U' ELSE 'A' END || '|' ||
 length(shown) || '|' || replace(shown, chr(10), '\\n') AS line FROM b""",
    "tool_inputs": f"""{_CONV}
SELECT 'toolu_' || conv_id || '_' || turn AS tool_use_id, tool AS tool_name, {sql.truncate('telling', 60)} AS summary,
 CASE WHEN length(input_json) > 80 THEN left(input_json, 79) || '…' ELSE input_json END AS one_line FROM conv WHERE tool IS NOT NULL""",
    "trace_lines": f"""{_CONV},
a AS (SELECT *, string_split({sql.strip('text')}, chr(10)) AS ls FROM conv WHERE entry_type = 'assistant'),
x AS (SELECT session_id, turn AS line_no, 0 AS item, unnest(list_slice(ls, 1, 5)) AS l, unnest(range(0, least(5, len(ls)))) AS sub FROM a WHERE {sql.strip('text')} <> '')
SELECT session_id, line_no, item, CAST(sub AS INTEGER) AS sub, '          "' || {sql.truncate('l', 100)} || '"' AS line FROM x
UNION ALL SELECT session_id, turn, 0, 5, '          ... (' || (len(ls) - 5) || ' more lines)' FROM a WHERE len(ls) > 5
UNION ALL SELECT session_id, turn, CASE WHEN {sql.strip('text')} <> '' THEN 1 ELSE 0 END, 0,
 CASE WHEN {sql.strip('text')} <> '' THEN '        ' ELSE strftime(make_timestamp(epoch_s * 1000000), '%H:%M:%S') END || '  ' || tool ||
 repeat(' ', greatest(0, 20 - length(tool))) || {sql.truncate('telling', 60)} FROM a WHERE tool IS NOT NULL""",
    "relinearized": f"""{_CONV}
SELECT uuid, lag(uuid) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_uuid FROM conv WHERE entry_type <> 'system'""",
    "trimmed_tail": f"""{_CONV}, k AS (SELECT *, entry_type = 'human' AND (length(text) % 2 = 1 OR {sql.strip('text')} = '' OR {sql.noise('text')}) AS noise FROM conv WHERE entry_type <> 'system'),
l AS (SELECT conv_id, max(turn) FILTER (WHERE NOT noise) AS last FROM k GROUP BY 1)
SELECT uuid FROM k JOIN l USING (conv_id) WHERE turn <= last""",
    "resumable_tail": f"""{_CONV}, k AS (SELECT *, (entry_type = 'human' AND ({sql.strip('text')} = '' OR {sql.noise('text')})) OR tool IS NOT NULL AS noise FROM conv WHERE entry_type <> 'system'),
l AS (SELECT conv_id, max(turn) FILTER (WHERE NOT noise) AS last FROM k GROUP BY 1)
SELECT uuid FROM k JOIN l USING (conv_id) WHERE turn <= last""",
    "tail_state": f"""{_CONV}
SELECT '/logs/' || project || '/' || session_id || '.jsonl' AS file_path,
 CASE WHEN arg_max(role, turn) = 'assistant' THEN 'clean' ELSE 'pending_user_input' END AS tail_state
FROM conv WHERE entry_type <> 'system' GROUP BY 1""",
    "active_thread": f"""{_ACTIVE} SELECT uuid, chain_no, dropped, is_thread FROM active""",
    "ancestor_chain": f"""{_RCONV}, {_CHAIN.replace('TIPS)', _USER_TIPS + ')')}, far AS (SELECT conv_id, max(away) AS far FROM walk GROUP BY 1)
SELECT k.uuid, CAST(far - away + 1 AS BIGINT) AS chain_no FROM walk w JOIN far USING (conv_id) JOIN kin k ON k.conv_id = w.conv_id AND k.turn = w.turn""",
    "rewind_report": f"""{_RCONV}, {_CHAIN.replace('TIPS)', _USER_TIPS + ')')},
n AS (SELECT conv_id, count(*) AS turns_before FROM kin GROUP BY 1),
m AS (SELECT w.conv_id, w.turn, w.away, c.entry_type, (c.entry_type = 'human' AND ({sql.strip('c.text')} = '' OR {sql.noise('c.text')})) AS noise, c.tool IS NOT NULL AS called
      FROM walk w JOIN conv c ON c.conv_id = w.conv_id AND c.turn = w.turn WHERE w.away > 0),
e AS (SELECT conv_id, min(away) FILTER (WHERE NOT noise AND NOT called) AS last_away, count(*) AS kept FROM m GROUP BY 1),
s AS (SELECT m.conv_id, any_value(e.kept) AS kept, count(*) FILTER (WHERE m.away >= e.last_away) AS after_n,
      count(*) FILTER (WHERE coalesce(m.away < e.last_away, true) AND m.noise) AS tn, count(*) FILTER (WHERE coalesce(m.away < e.last_away, true) AND NOT m.noise) AS tc,
      CASE WHEN bool_or(m.away = e.last_away AND m.entry_type = 'assistant') THEN 'clean' WHEN any_value(e.last_away) IS NOT NULL THEN 'pending_user_input' END AS tail_state
      FROM m JOIN e USING (conv_id) GROUP BY 1)
SELECT c.uuid AS turn, CASE WHEN coalesce(s.after_n, 0) = 0 THEN 'nothing_left' ELSE 'ok' END AS status, n.turns_before, coalesce(s.after_n, 0) AS turns_after,
 n.turns_before - coalesce(s.kept, 0) AS removed_after_cut, coalesce(s.tn, 0) AS trimmed_trailing, coalesce(s.tc, 0) AS trimmed_calls, s.tail_state
FROM tips t JOIN conv c ON c.conv_id = t.conv_id AND c.turn = t.turn JOIN n ON n.conv_id = t.conv_id LEFT JOIN s ON s.conv_id = t.conv_id""",
    "rewind_statuses": f"""{_CONV}, u AS (SELECT conv_id, session_id, conv_id % 6 AS kind, arg_min(uuid, turn) AS uuid, arg_min(body, turn) AS body FROM conv WHERE entry_type = 'human' GROUP BY ALL)
SELECT session_id, CASE WHEN kind < 2 THEN 'ffffffff' WHEN kind = 2 THEN left(uuid, 8) ELSE uuid END AS turn,
 CASE kind WHEN 0 THEN 'unknown_turn' WHEN 1 THEN 'already_rewound' WHEN 2 THEN 'ambiguous_turn' WHEN 3 THEN 'repeated_turn' WHEN 4 THEN 'nothing_left' ELSE 'ok' END AS status FROM u""",
    "thread_copy": f"""{_ACTIVE},
lin AS (SELECT a.*, c.session_id AS src, lag(a.uuid) OVER (PARTITION BY a.conv_id ORDER BY chain_no) AS parent_uuid,
  'a' || md5('/logs/' || c.project || '/' || c.session_id || '.jsonl') AS new_id,
  c.entry_type = 'human' AND ({sql.strip('c.text')} = '' OR {sql.noise('c.text')}) AS noise FROM active a JOIN conv c ON c.conv_id = a.conv_id AND c.turn = a.turn),
l AS (SELECT conv_id, max(chain_no) FILTER (WHERE NOT noise) AS last FROM lin GROUP BY 1)
SELECT uuid, parent_uuid, chain_no, 'parent' AS session_id, 'session=' || src || ',subagent=' || new_id AS hops FROM lin JOIN l USING (conv_id) WHERE chain_no <= last""",
    "model_stats": f"""{_CONV} SELECT project, 'model-' || (conv_id % 3) AS model, count(*) AS n FROM conv WHERE entry_type = 'assistant' GROUP BY 1, 2""",
    "environment": f"""{_CONV}
SELECT session_id, '/work/' || any_value(project) AS original_cwd, 'b' || (min(turn) % 2) AS original_branch, '1.' || (any_value(conv_id) % 3) AS version,
 CAST(floor(({int(AS_OF.timestamp())} - max(epoch_s)) / 86400) AS BIGINT) AS age_days FROM conv WHERE entry_type <> 'system' GROUP BY 1""",
    "project_list": f"""{_CONV}
SELECT '/work/' || project AS project, project AS name, count(DISTINCT session_id) AS sessions, {tables.EPOCH} + max(turn) AS last_epoch FROM conv GROUP BY project""",
    "resolve_ids": f"""{_CONV}, s AS (SELECT DISTINCT session_id, left(session_id, 7) AS raw_id FROM conv WHERE entry_type <> 'system' AND display <> '')
SELECT raw_id, count(*) AS candidates, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM s GROUP BY 1""",
    "debate_live_moves": f"""{sql.MOVES} SELECT run_id, round, count(*) FILTER (WHERE move_type IN ('WITHDRAW','UPDATE','DISPUTE')) AS live_moves FROM moves GROUP BY 1, 2""",
    "debate_end_state": f"""{sql.MOVES}, r AS (SELECT run_id, round, count(*) FILTER (WHERE move_type IN ('WITHDRAW','UPDATE','DISPUTE')) AS n FROM moves GROUP BY 1, 2),
e AS (SELECT run_id, min(round) FILTER (WHERE n = 0) AS q, max(round) AS l FROM r GROUP BY 1)
SELECT run_id, CASE WHEN q IS NOT NULL THEN 'quiet' WHEN l >= {V.MAX_ROUNDS} THEN 'capped' ELSE 'open' END AS state, coalesce(q, least(l, {V.MAX_ROUNDS})) AS after_round FROM e""",
}
