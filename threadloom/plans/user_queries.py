"""The questions a user asks, composed from operators. Inputs are tables, outputs are frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.entry_text import with_texts
from threadloom.functions.ids import names
from threadloom.operators import activity as ACT
from threadloom.operators import agents as AG
from threadloom.operators import calls as C
from threadloom.operators import failures as FL
from threadloom.operators import search as SE
from threadloom.operators import sessions as S
from threadloom.operators.ordered import matching
from threadloom.operators.resolve import resolve_sessions
from threadloom.sources import projects as P
from threadloom.sources import transcripts as TR


class Unresolved(ValueError):
    """An id that names no session, or several."""


def own(rows: DataFrame, copies: DataFrame | None) -> DataFrame:
    """Rows of transcripts that are no copies. `copies` has file_path (see `transcripts.provenance`)."""
    return rows if copies is None else TR.without_copies(rows, copies)


def one_session(entries: DataFrame, session: str) -> DataFrame:
    """Entries of the one session that an id or prefix names; the full id then reaches the scan as equality."""
    spark = entries.sparkSession
    said = F.count_if(F.col("entry_type").isin("human", "assistant"))
    named = entries.where(names(F.col("session_id"), session)).groupBy("session_id").agg(
        said.alias("message_count"), F.min("project").alias("project"))
    found = resolve_sessions(spark.createDataFrame([(session,)], "raw_id STRING"), named).first()
    if found["status"] != "unique":
        raise Unresolved(f"{session!r} is {found['status']}: {found['candidates']} sessions")
    return entries.where(F.col("session_id") == found["session_id"])


def scan(spark: SparkSession, path: str | list[str], after: datetime | None = None, failures_only: bool = False) -> DataFrame:
    """Entries of the files below `path`. Files last written before `after` are not read. With `failures_only` the raw text
    of all files is searched for flagged results now, and only files that hold one are opened later."""
    if failures_only:
        path = TR.paths_containing(spark, path, V.FLAGGED_LITERAL, after)
    lines = TR.scan_lines(spark, path, after) if path else TR.no_lines(spark)
    return TR.entries(lines.withColumn("project", TR.project_dir(F.col("file_path"))))


def list_projects(lines: DataFrame, files: DataFrame, worktrees: DataFrame | None = None) -> DataFrame:
    """Projects, newest activity first."""
    found = P.discover_projects(files, P.project_cwd(lines), worktrees)
    return found.orderBy(F.desc_nulls_last("last_active"), "project")


def list_sessions(
    entries: DataFrame, agents: DataFrame | None = None, copies: DataFrame | None = None, **filters
) -> DataFrame:
    """Sessions with their stats and compactions, newest first; agents are joined only when given."""
    rows = own(entries, copies)
    present = None if agents is None else AG.agents_present(agents)
    squeezed = S.compactions(rows.where(F.col("agent_id").isNull())).groupBy("session_id").agg(F.count(F.lit(1)).alias("compactions"))
    summary = S.session_summary(rows).join(squeezed, "session_id", "left").withColumn("compactions", F.coalesce("compactions", F.lit(0)))
    return S.list_sessions(summary, agents=present, **filters)


def search_projects(
    entries: DataFrame, patterns: list[str], role: str = "user", after: datetime | None = None,
    before: datetime | None = None, exclude: str | None = None, errors_only: bool = False,
    hide: frozenset[str] = frozenset(), width: int = 150, copies: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pattern roll-up, most hits first, with the hits of all patterns and the session left out; and the hottest
    examples of each pattern."""
    rows = S.exclude_session(own(entries, copies), exclude)
    if after is not None or before is not None:
        dated = S.date_filter(
            rows.where(F.col("agent_id").isNull()).groupBy("session_id").agg(
                S.first_by_line("ts", F.col("ts").isNotNull()).alias("first_ts")
            ), after, before,
        )
        rows = matching(rows, dated, ["session_id"])
    per_session = SE.triage(rows, patterns, role, width, hide, errors_only)
    rollup = SE.pattern_rollup(per_session).withColumns({
        "total_hits": per_session.agg(F.coalesce(F.sum("hits"), F.lit(0))).scalar(),
        "excluded_session": F.lit(exclude).cast("string"),
    }).orderBy(F.desc("hits"), "pattern")
    return rollup, SE.pattern_examples(per_session)


def grep_session(entries: DataFrame, session: str, patterns: list[str], copies: DataFrame | None = None, **options) -> DataFrame:
    """One session, resolved first; an ambiguous prefix is an error, never a mixture."""
    return SE.grep(one_session(own(entries, copies), session), patterns, **options)


def grep_sessions(entries: DataFrame, sessions: list[str], patterns: list[str], copies: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Several sessions in the caller's order, and the ids that name none; an ambiguous prefix is an error."""
    found, missing = SE.grep_sessions(own(entries, copies), sessions, patterns, **options)
    several = missing.where("status = 'ambiguous'").orderBy("id_pos").first()
    if several is not None:
        raise Unresolved(f"{several['raw_id']!r} is ambiguous: {several['candidates']} sessions")
    return found, missing.select("id_pos", "raw_id")


def one_turn(entries: DataFrame, turn: str) -> DataFrame:
    """Anchor rows of the one turn that an id or prefix names. A turn that was copied, id and all, is still one turn."""
    anchors = SE.find_turn(entries, turn)
    n = anchors.select("anchor").distinct().limit(2).count()
    if n > 1:
        raise Unresolved(f"{turn!r} is ambiguous: several turns")
    return anchors


def read_turn(
    entries: DataFrame, turn: str, context: int = 3, hide: frozenset[str] = frozenset(), copies: DataFrame | None = None,
) -> DataFrame:
    """A turn by id or prefix with its surroundings; only its own transcript is numbered. An ambiguous prefix is an error."""
    entries = own(entries, copies)
    anchors = one_turn(entries, turn)
    place = matching(entries, anchors, ["file_path"])
    return SE.read_turn(place, anchors, context, hide)


def browse_session(
    entries: DataFrame, session: str, agent: str | None = None, position: str = "head", turns: int = 10,
    role: str = "all", hide: frozenset[str] = frozenset({"outputs"}), anchor: str | None = None,
    copies: DataFrame | None = None,
) -> DataFrame:
    """First or last turns of a session or of one of its agents, or the turns from or up to an anchor turn."""
    rows = one_session(own(entries, copies), session)
    rows = rows.where(F.col("agent_id").isNull() if agent is None else names(F.col("agent_id"), agent))
    types = SE.shown_types(role, hide).around
    if anchor is None:
        return SE.browse(rows, position, turns, types)
    return SE.browse_anchored(rows, one_turn(rows, anchor).select("file_path", "line_no"), position, turns, types)


def list_agents(
    entries: DataFrame, transcripts: DataFrame, meta: DataFrame | None = None, saved: DataFrame | None = None,
    copies: DataFrame | None = None,
) -> DataFrame:
    """All agents of the sessions with what the parent and their own transcripts tell."""
    entries, transcripts = own(entries, copies), own(transcripts, copies)
    main = entries.where(F.col("agent_id").isNull())
    found = AG.reconcile(AG.dispatch_results(main), AG.agent_files(transcripts, meta))
    bodies = AG.body_stats(entries.where(F.col("agent_id").isNotNull()))
    return AG.resolve_output(AG.backfill(found, bodies), saved)


def agent_detail(entries: DataFrame, transcripts: DataFrame, agent: str, meta: DataFrame | None = None, truncate: int = 80, copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One agent's row and its trace; other sessions are filtered out first."""
    entries, transcripts = own(entries, copies), own(transcripts, copies)
    mine = transcripts.where(names(F.col("agent_id"), agent)).select("session_id").distinct()
    rows = matching(entries, mine, ["session_id"])
    files = transcripts.join(mine, "session_id", "left_semi")
    about = list_agents(rows, files, meta).where(names(F.col("agent_id"), agent))
    body = rows.where(names(F.col("agent_id"), agent))
    return about, AG.trace_lines(body, truncate=truncate)


def audit_tools(
    entries: DataFrame, name_filter: str | None = None, truncate: int = 80, copies: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per agent: totals, calls per tool, and the call rows."""
    entries = own(entries, copies)
    calls = C.pair_tool_calls(entries.where(F.col("agent_id").isNotNull()))
    by = ["session_id", "agent_id"]
    return C.tool_audit(calls, by, name_filter), C.tool_counts(calls, by), C.audit_rows(calls, name_filter, truncate)


def audit_coverage(entries: DataFrame, transcripts: DataFrame, name_filter: str | None = None) -> DataFrame:
    """Agents that are there against agents that made calls, and the totals of an audit."""
    calls = C.pair_tool_calls(entries.where(F.col("agent_id").isNotNull()))
    there = transcripts.where(F.col("agent_id").isNotNull() & ~F.coalesce("is_artifact", F.lit(False)))
    return C.audit_coverage(calls, there, name_filter)


def activity(entries: DataFrame, window: ACT.Window, copies: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every part of the activity timeline."""
    rows = with_texts(own(entries, copies))
    marks = ACT.marked(rows, window)
    grid = ACT.cells(marks)
    sessions = ACT.session_rows(rows, window, grid, marks)
    vectors = ACT.attention(grid, sessions)
    return {
        "sessions": ACT.session_order(sessions),
        "summary": ACT.summary(sessions, vectors, window),
        "by_project": ACT.by_project(sessions, grid, window),
        "days": ACT.days(vectors, grid, sessions, window),
        "timeline": ACT.timeline(grid, window),
    }


def survey_failures(entries: DataFrame, copies: DataFrame | None = None, **options) -> FL.Survey:
    """Failure survey over whole entries; the scoping files come from the flags themselves."""
    rows = own(entries, copies)
    return FL.survey(C.pair_tool_calls(rows), files=FL.error_files(rows), **options)


def failure_report(entries: DataFrame, limit: int = 10, **options) -> dict[str, DataFrame]:
    """The survey in sections of at most `limit` rows, most hits first, each saying what it leaves out."""
    return FL.report(survey_failures(entries, **options), limit)
