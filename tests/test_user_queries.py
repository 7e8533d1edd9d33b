"""User questions end to end on the smallest given tables."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from threadloom.plans import user_queries as Q
from threadloom.session import cut_lineage
from threadloom.sources import tables
from threadloom.sources import transcripts as TR

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


@pytest.fixture(scope="module")
def talk(spark):
    return cut_lineage(TR.entries(tables.conversation_lines(spark, SF)))


def test_ids_shown_by_a_search_can_be_read(talk):
    rollup, examples = Q.search_projects(talk, ["a", "zzzz"], "all")
    assert [r.pattern for r in rollup.collect()] == ["a"]
    session = examples.first().session_id
    turn = talk.where(F.col("session_id") == session).agg(F.min("uuid")).first()[0]
    assert Q.read_turn(talk, turn[:8], 1).where("offset = 0").first().uuid == turn
    assert Q.browse_session(talk, session[:8], turns=2).count() == 2
    assert Q.browse_session(talk, session, turns=2, role="user", anchor=turn[:8], position="tail").where("entry_type != 'human'").count() == 0
    for typed in (session[:7], "ffffffffff"):
        with pytest.raises(Q.Unresolved):
            Q.browse_session(talk, typed)
    shown = Q.grep_session(talk, session[:8], ["a"], role="all", cap=1).where("offset = 0").collect()
    assert len(shown) == 1 and shown[0].line.split("|")[0] in {r.uuid[:8] for r in talk.select("uuid").collect()}


def test_many_sessions_in_the_callers_order(talk):
    from threadloom.operators.search import grep_sessions

    ids = [r.session_id for r in talk.select("session_id").distinct().orderBy("session_id").limit(3).collect()]
    found, missing = grep_sessions(talk, [ids[2], "ffffffff", ids[0]], ["e"], role="all", context=0, cap=1)
    assert [r.session_id for r in found.orderBy("id_pos").collect()] == [ids[2], ids[0]]
    assert [r.raw_id for r in missing.collect()] == ["ffffffff"]


def test_survey_conserves_failures(spark):
    e = cut_lineage(TR.entries(tables.event_lines(spark, SF)))
    found = Q.survey_failures(e, include_cascade=True)
    from threadloom.operators.calls import pair_tool_calls

    failed = pair_tool_calls(e).where("is_error").count()
    assert found.totals.first().total == failed == found.by_kind.agg(F.sum("count")).first()[0]
    # Files are counted even where no call lies in the window.
    late = Q.survey_failures(e, after=datetime(2100, 1, 1, tzinfo=timezone.utc)).totals.first()
    assert late.total == 0 and late.transcripts_scanned == found.totals.first().transcripts_scanned > 0
    copies = e.where("agent_id IS NOT NULL").select("file_path").distinct()
    assert Q.survey_failures(e, copies=copies).by_kind.agg(F.sum("count")).first()[0] < failed
    parts = Q.failure_report(e, limit=1)
    assert parts["by_kind"].first().overflow.startswith("showing 1 of ")
    files = TR.transcripts(tables.event_lines(spark, SF).withColumn("file_mtime", F.current_timestamp()))
    coverage = Q.audit_coverage(e, files).first()
    assert coverage.agents_present >= coverage.agents_audited > 0
    audits, counts, rows = Q.audit_tools(e)
    assert coverage.calls == audits.agg(F.sum("calls")).first()[0]
    assert audits.agg(F.sum("calls")).first()[0] == counts.agg(F.sum("calls")).first()[0] == rows.count()
