"""Built JSONL files through the real text scan."""

import json
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.entry_text import with_display, with_texts
from threadloom.operators import agents as AG
from threadloom.operators import calls as C
from threadloom.operators import kvmine
from threadloom.operators import lineage as L
from threadloom.operators import resolve as R
from threadloom.operators import sessions as S
from threadloom.plans import user_queries as Q
from threadloom.sources import projects as P
from threadloom.sources import sinks, tables
from threadloom.sources import transcripts as TR

SID = "aaaaaaaa-0000-4000-8000-000000000001"
EMPTY = "aaaaaaaa-0000-4000-8000-000000000002"
AGENT = "a1111111122222222"


def user(n, content, **more):
    return {"type": "user", "uuid": f"{n:08x}-u", "timestamp": f"2026-06-02T10:00:{n:02d}Z", "sessionId": SID,
            "message": {"role": "user", "content": content}, **more}


def assistant(n, content, **more):
    return {"type": "assistant", "uuid": f"{n:08x}-a", "timestamp": f"2026-06-02T10:00:{n:02d}Z", "sessionId": SID,
            "message": {"id": f"m{n}", "type": "message", "role": "assistant", "model": "m", "content": content}, **more}


def result(use, text, error=None):
    return {"type": "tool_result", "tool_use_id": use, "content": text, **({} if error is None else {"is_error": error})}


def tool(use, name, **data):
    return {"type": "tool_use", "id": use, "name": name, "input": data}


MAIN = [
    {"type": "mode", "mode": "normal"},
    {"type": "custom-title", "customTitle": "My title"},
    user(1, "<command-name>/clear</command-name>", cwd="/repo/.claude/worktrees/w1", gitBranch="main"),
    user(2, [{"type": "text", "text": "Fix the bug\nplease"}, {"type": "mystery", "x": [1]}, "bare", 7]),
    user(3, [result("t2", "early")], toolUseResult={}),
    assistant(4, [{"type": "thinking", "thinking": " hm "}, {"type": "text", "text": "ok"},
                  tool("t1", "Bash", command="ls", n=1), tool("t2", "mcp__a__b__c", q="x", k=[1]), tool("t3", "Read", file_path="/f")]),
    user(5, [result("t1", [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}], True),
             result("t1", "again")], toolUseResult="x"),
    user(6, '[{"type":"text","text":"not a list"}]'),
    user(7, [{"type": "text", "text": '<teammate-message color="red" summary="s" teammate_id="lead">do it</teammate-message>'}], agentName="me"),
    user(8, "[Request interrupted by user]"),
    user(9, "skill text", isMeta=True),
    assistant(10, [tool("d1", "Agent", description="look", subagent_type="scout", prompt="go"), tool("d2", "Task", description="later")]),
    user(11, [result("d1", "done")], toolUseResult={"agentId": AGENT, "status": "completed", "totalTokens": 5, "usage": {"input_tokens": 3}}),
    user(12, [result("d2", "no")], toolUseResult="User rejected this"),
    {"type": "queue-operation", "operation": "enqueue", "timestamp": "2026-06-02T10:00:13Z", "sessionId": SID,
     "content": f"<task-notification><task-id>{AGENT}</task-id><status>finished</status><result>r</result><usage>tool_uses: 4</usage></task-notification>"},
    {"type": "system", "subtype": "turn_duration", "durationMs": 1500, "uuid": "s", "timestamp": "2026-06-02T10:00:14Z", "sessionId": SID},
    {"type": "summary", "summary": "S", "leafUuid": "l"},
    {"type": "progress", "any": {"thing": 1}},
    {"type": "surprise"},
    {"type": "user", "uuid": "x", "message": {"role": "user", "content": "no time"}},
]
PROVENANCE = {"type": "x-converter-provenance", "sessionId": SID, "agentId": "acopy",
              "x_converter": {"tool": "t", "v": 1, "from": {"kind": "session", "id": "s", "project": "p"},
                              "converted_at": "2026-06-01T00:00:00Z", "lines_at_creation": 2}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs") / "proj"
    agents = top / SID / "subagents" / "workflows" / "run7"
    agents.mkdir(parents=True)
    body = "\n".join(json.dumps(x) for x in MAIN)
    with open(top / f"{SID}.jsonl", "wb") as f:
        f.write(body.encode() + b'\n\n{"broken": \n{"type":"user"} {"type":"user"}\n[1]\n{"type":"system","x":"\xff\xfe"}\n')
    (top / f"{EMPTY}.jsonl").write_text("")
    near = top / SID / "subagents"
    (near / f"agent-{AGENT}.jsonl").write_text("\n".join(json.dumps(x) for x in [
        user(1, "go"), assistant(2, [tool("x", "Bash", command="a"), {"type": "text", "text": "result\nline"}])]) + "\n")
    (near / f"agent-{AGENT}.meta.json").write_text(json.dumps({"agentType": "scout", "description": "look", "toolUseId": "d1"}))
    (agents / "agent-aorphan.jsonl").write_text(json.dumps(user(1, "alone")) + "\n")
    (near / "agent-acopy.jsonl").write_text("\n".join(json.dumps(x) for x in [PROVENANCE, user(1, "copied"), user(2, "grown")]) + "\n")
    return str(top)


@pytest.fixture(scope="module")
def lines(spark, root):
    return TR.scan_lines(spark, root).cache()


@pytest.fixture(scope="module")
def entries(lines):
    return TR.entries(lines.withColumn("project", F.lit("proj"))).cache()


def main_rows(entries):
    return entries.where(F.col("agent_id").isNull())


def test_line_numbers_are_physical(lines):
    rows = lines.where(F.col("file_path").endswith(f"{SID}.jsonl")).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(len(rows)))
    assert json.loads(rows[2].value)["uuid"] == "00000001-u"
    assert rows[len(MAIN)].value == ""


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(f'{{"n": {i}}}\n' for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000000", "20000", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = TR.scan_lines(spark, str(tmp_path))
            got = rows.select("line_no", F.get_json_object("value", "$.n").cast("bigint").alias("n")).collect()
            assert len(got) == 3000 and all(r.line_no == r.n for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_are_neither_shuffled_nor_joined(spark, tmp_path, capsys):
    for k in range(40):
        (tmp_path / f"f{k:02d}.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(k * 7)))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = TR.scan_lines(spark, str(tmp_path))
        rows.explain("formatted")
        moves = [part for part in capsys.readouterr().out.split("\n(")[1:] if re.match(r"\d+\) .*(Exchange|Join|Sort|Window)", part)]
        assert moves and not any("value#" in part for part in moves)
        got = rows.select("file_path", "line_no", F.get_json_object("value", "$.n").cast("bigint").alias("n")).collect()
        assert len(got) == sum(k * 7 for k in range(40)) and all(r.line_no == r.n for r in got)
        assert rows.rdd.getNumPartitions() > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_survey_opens_only_files_with_a_hit(spark, root, tmp_path):
    failed = user(3, [result("t1", "No such file", True)], toolUseResult="x")
    for k in range(6):
        (tmp_path / f"{SID[:-1]}{k}.jsonl").write_text("\n".join(json.dumps(x) for x in [user(1, "hi"), failed if k % 3 == 0 else user(2, "is_error")]) + "\n")
    found = TR.paths_containing(spark, str(tmp_path), V.FLAGGED_LITERAL)
    assert [p[-7:-6] for p in found] == ["0", "3"]
    rows = Q.scan(spark, str(tmp_path), failures_only=True)
    assert sorted(f[-7:-6] for f in rows.inputFiles()) == ["0", "3"] and rows.count() == 4
    none = tmp_path / "none"
    none.mkdir()
    (none / "x.jsonl").write_text(json.dumps(user(1, "hi")) + "\n")
    assert Q.scan(spark, str(none), failures_only=True).count() == 0


def test_types_and_rejects(lines, entries):
    types = {r.entry_type: r["count"] for r in main_rows(entries).groupBy("entry_type").count().collect()}
    assert types == {"human": 5, "tool_result": 4, "assistant": 2, "meta": 1, "queue_operation": 1, "system": 1,
                     "summary": 1, "progress": 1}
    why = {r.reason: r.n for r in TR.rejects(lines).collect()}
    assert why == {"malformed": 2, "unknown_type": 1, "invalid": 2}


def test_content_shapes(entries):
    got = {r.line_no: r.blocks for r in main_rows(entries).where("blocks is not null").collect()}
    assert [b.text for b in got[3]] == ["Fix the bug\nplease", '{"type":"mystery","x":[1]}', "bare", "7"]
    assert got[7][0].text.startswith("[{") and len(got[7]) == 1
    assert got[6][0].text == "one\ntwo" and got[6][0].is_error is True and got[6][1].is_error is None
    assert [b.tool_name for b in got[5] if b.type == "tool_use"] == ["Bash", "mcp__a__b__c", "Read"]


def test_texts_and_origin(entries):
    rows = {r.line_no: r for r in with_display(with_texts(main_rows(entries))).collect()}
    assert rows[2].origin == "command_scaffolding" and rows[2].display == ""
    assert rows[3].origin == "human" and rows[8].origin == "teammate" and rows[9].origin == "interrupt"
    assert rows[10].origin == "meta" and rows[6].origin == "tool_result"
    assert rows[8].display == "[teammate: lead → me] s — do it"
    assert rows[5].tool_text == "Bash\nls\nmcp__a__b__c\nx\nRead\n/f"
    assert rows[5].display.startswith("[thinking] hm  ok  → Bash(")
    assert rows[6].display == "[error] one  [image]  [error] two  again"
    assert rows[6].output_text == "one\ntwo\nagain"


def test_pairing(entries):
    calls = {r.tool_use_id: r for r in C.pair_tool_calls(main_rows(entries)).collect()}
    assert calls["t1"].result_text == "one\ntwo" and calls["t1"].is_error
    assert calls["t2"].result_text == "early" and calls["t2"].server == "a" and calls["t2"].short_name == "b__c"
    assert not calls["t3"].has_result and calls["t3"].kind is None
    assert calls["t1"].kind == "unclassified"


def test_agents(spark, root, lines, entries):
    copies = TR.provenance(lines)
    files = AG.agent_files(TR.transcripts(lines, copies), TR.scan_agent_meta(spark, root))
    found = AG.reconcile(AG.dispatch_results(main_rows(entries)), files)
    rows = {r.tool_use_id or r.agent_id: r for r in found.collect()}
    assert rows["d1"].source == "dispatched" and rows["d1"].status == "finished" and rows["d1"].result_text == "done"
    assert rows["d1"].total_tokens == 5 and rows["d1"].total_tool_use_count == 4 and rows["d1"].input_tokens == 3
    assert rows["d2"].source == "dispatch_only" and rows["d2"].status == "rejected"
    assert rows["aorphan"].source == "orphan" and rows["aorphan"].workflow_run_id == "run7"
    assert AG.agents_present(found).first().agents_present == 3
    bodies = AG.body_stats(entries.where(F.col("agent_id").isNotNull()))
    full = {r.agent_id: r for r in AG.resolve_output(AG.backfill(found, bodies)).collect()}
    assert full["aorphan"].prompt == "alone" and full[AGENT].total_tool_use_count == 4
    assert full[AGENT].output_resolved.endswith(f"agent-{AGENT}.jsonl")
    trace = [r.line for r in AG.trace_lines(entries.where(F.col("agent_id") == AGENT)).orderBy("line_no", "item", "sub").collect()]
    assert trace == ["10:00:02  Bash" + " " * 16 + "a", '          "result"', '          "line"']


def test_copies(spark, lines, entries):
    copies = TR.provenance(lines)
    assert [r.lines_at_creation for r in copies.collect()] == [2]
    grown = L.with_growth(copies, TR.transcripts(lines, copies), datetime(2026, 6, 2, tzinfo=timezone.utc))
    row = grown.first()
    assert row.grown and row.age_seconds == 86400
    wanted = spark.createDataFrame([("acopy1",), ("aorphan",), (SID,), ("short",), ("zzzzzzz",)], "raw_id STRING")
    resolved = R.resolve_artifacts(wanted, TR.transcripts(lines, copies))
    got = {r.raw_id: (r.decision, r.reason) for r in L.removal_report(resolved, grown).collect()}
    assert got["aorphan"] == ("refused", "not_an_artifact") and got[SID] == ("refused", "session")
    assert got["short"] == ("refused", "too_short") and got["zzzzzzz"] == ("refused", "not_found")
    assert TR.without_copies(entries, copies).where(F.col("agent_id") == "acopy").count() == 0


def test_projects_and_titles(lines, entries):
    found = P.discover_projects(TR.transcripts(lines), P.project_cwd(lines)).collect()
    assert [(r.project, r.name, r.sessions) for r in found] == [("/repo", "repo", 1)]
    assert [r.title for r in S.custom_titles(lines.withColumn("project", F.lit("p"))).collect()] == ["My title"]
    s = S.session_summary(entries).first()
    assert (s.title, s.user_turns, s.tool_use_count, s.agent_count, s.team_role) == ("Fix the bug", 2, 5, 2, "me")


def test_error_prefilter_and_sparse_sink(lines, entries):
    assert TR.files_containing(lines, '"is_error":\\s*true').count() == 1
    row = json.loads(sinks.sparse_json(entries.where("entry_type = 'summary'")).first().value)
    assert row["summary"] == "S" and "ts" not in row


def test_written_lines_come_back_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "LINES_PER_FILE", 40)
    # One transcript holds most lines.
    rows = spark.range(1200).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("file"), (F.col("id") * 7919 % 1200).alias("n"))
    rows = rows.withColumn("line", F.concat_ws("|", "file", "n")).repartition(7)
    path = str(tmp_path / "out")
    sinks.write_lines(rows, path, order=["file", "n"], parts=6)
    parts = sorted((tmp_path / "out").glob("*.txt"))
    assert len(parts) > 12 and max(len(p.read_text().splitlines()) for p in parts) <= 40
    want = [r.line for r in rows.orderBy("file", "n").collect()]
    assert [line for p in parts for line in p.read_text().splitlines()] == want
    got = {r.pos: r.value for r in sinks.read_lines(spark, path).collect()}
    assert [got[k] for k in range(1200)] == want


def test_ambiguous_ids_are_errors(entries, lines):
    rows = main_rows(entries).drop("agent_id").withColumn("agent_id", F.lit(None).cast("string"))
    twin = rows.withColumn("session_id", F.concat(F.substring("session_id", 1, 35), F.lit("9"))).withColumn("uuid", F.concat("uuid", F.lit("2")))
    both = rows.unionByName(twin)
    with pytest.raises(Q.Unresolved):
        Q.grep_sessions(both, [SID, SID[:8]], ["bug"])
    found, missing = Q.grep_sessions(both, ["ffffffff", SID], ["bug"], role="all", context=0)
    assert found.count() == 1 and [tuple(r) for r in missing.collect()] == [(0, "ffffffff")]
    with pytest.raises(Q.Unresolved):
        Q.read_turn(both, "00000002")
    assert Q.read_turn(rows, "00000002").count() > 0


def test_pulls_read_key_ranges(spark, tmp_path, capsys):
    ids = ["0001aaaa", "0001bbbb", "0002aaaa", "ff"]
    value = lambda i: json.dumps({"composerId": i, "conversation": [{"type": 1, "bubbleId": "x", "text": ""}, {"type": 2, "bubbleId": "y", "text": "said"}]})
    rows = [("s", "disk", f"composerData:{i}", value(i)) for i in ids] + [("s", "disk", f"bubbleId:{i}:x", json.dumps({"text": f"asked {i}"})) for i in ids]
    spark.createDataFrame(rows, "source_db STRING, table_name STRING, key STRING, value STRING").write.parquet(str(tmp_path / "kv"))
    kv = spark.read.parquet(str(tmp_path / "kv"))
    got = lambda typed: sorted((r.conversation_id, r.text) for r in kvmine.pull_conversations(kv, typed).collect())
    both = lambda *names: sorted((i, t) for i in names for t in (f"asked {i}", "said"))
    assert got(["0001"]) == both("0001aaaa", "0001bbbb") and got(["0002aaaa"]) == both("0002aaaa") and got(["fffff"]) == both("ff")
    assert got(["", "9"]) == [] and got(None) == both(*ids)
    kvmine.pull_conversations(kv, ["0001"]).explain("formatted")
    pushed = [line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line]
    assert len(pushed) >= 2 and all("GreaterThanOrEqual(key" in line and "LessThan(key" in line for line in pushed)


def test_successor_sorts_right_after():
    from threadloom.functions.ids import successor

    assert successor("ab") == "ac" and successor("a\U0010ffff") == "b" and successor("") == "" and successor("\U0010ffff") == "" and successor("\ud7ff") == "\ue000"


def test_event_lines_come_from_many_tasks(spark, tmp_path):
    """A table in one row group is dealt out before its rows become lines."""
    rows = spark.range(3000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'error' AS event_type", "1.5D AS value", "'{\"k\": 1}' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    unset = spark.conf.get("spark.threadloom.spread", None)
    spark.conf.unset("spark.threadloom.spread")
    try:
        sizes = tables.event_lines(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        if unset:
            spark.conf.set("spark.threadloom.spread", unset)
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 1000 and sum(r["count"] for r in sizes) == 3000
