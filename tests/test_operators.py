"""Operators on small frames, checked against plain Python."""

import random
import re
import textwrap
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.functions import tools as T
from threadloom.functions.ids import check_turn_id, id8, id_matches
from threadloom.operators import activity as ACT
from threadloom.operators import debate, kvmine
from threadloom.operators import findings as FN
from threadloom.operators import lineage as L
from threadloom.operators import ordered as O
from threadloom.operators import resolve as R
from threadloom.operators import search as SE


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, t {kind}")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


# --- order in hot groups --------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 2, 42])
def test_running_count_and_previous(spark, parts):
    rnd = random.Random(1)
    rows = [("hot", n, rnd.choice([None, n]), rnd.random() < 0.5) for n in range(200)] + [("cold", 5, 5, True), ("cold", 900, None, True)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "g STRING, n BIGINT, v BIGINT, c BOOLEAN").repartition(parts)
    out = O.previous_value(O.running_count(df, ["g"], "n", "k", F.col("c"), block=7), ["g"], "n", F.col("v"), "p", block=7)
    got = {(r.g, r.n): (r.k, r.p) for r in out.collect()}
    seen = {}
    for g, n, v, c in sorted(rows):
        k, p = seen.get(g, (0, None))
        k += c
        assert got[g, n] == (k, p)
        seen[g] = (k, v if v is not None else p)
    assert len(got) == len(rows)


def test_lookup_with_hot_key(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("none", 2)], "k STRING, n BIGINT")
    right = spark.createDataFrame([("hot", 10), ("a", 20)], "k STRING, v BIGINT")
    got = sorted((r.k, r.n, r.v) for r in O.lookup(left, right, ["k"]).collect())
    assert got == sorted([("hot", i, 10) for i in range(50)] + [("a", 1, 20), ("none", 2, None)], key=lambda t: (t[0], t[1]))


# --- text -----------------------------------------------------------------------------------------------


def test_truncate_like_textwrap(spark):
    rnd = random.Random(2)
    words = ["a", "well-known", "x" * 30, "é", "end.", "--", "tab\there", "émigré-like"]
    values = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(60)] + ["y" * 200, "", "  "]

    def expected(t, w=25):
        if len(t) <= w:
            return t
        cut = textwrap.shorten(t, width=w, placeholder="...")
        return cut if cut != "..." else t[: w - 3] + "..."

    assert column(spark, values, lambda c: X.smart_truncate(c, 25)) == [expected(v) for v in values]
    many = spark.createDataFrame([(values,)], "ts ARRAY<STRING>").select(X.truncate_all(F.col("ts"), 25).alias("x")).first().x
    assert many == [expected(v) for v in values]


def test_collapse_and_strip(spark):
    values = [" a\xa0\n b ", "\x1cz y", "", "x" * 900]
    assert column(spark, values, lambda c: X.collapse_ws(c, 5)) == [" ".join(v[:40].split())[:5] for v in values]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


def test_xml_and_teammates(spark):
    assert column(spark, ["<usage>a\nb</usage>x", "<system-reminder>r</system-reminder>\n\n\n\nhi", "<command-name>/c</command-name>", "a\n\n\n\nb"],
                  X.strip_system_xml) == ["x", "hi", "", "a\n\nb"]
    assert column(spark, ["<a>1</a> <b-c x=1>2</b-c>rest", "<a>1</b>rest", "plain <a>x</a>"], X.strip_leading_xml) == ["rest", "<a>1</b>rest", "plain <a>x</a>"]
    assert column(spark, ["<command-args> one </command-args>x<command-args>two</command-args>"], X.command_args) == ["one two"]
    got = column(spark, [' <TEAMMATE-message summary="s" teammate_id="t">b</teammate-message> ', "say <teammate-message teammate_id=\"t\">", '<teammate-message color="x">b'],
                 X.parse_teammate)
    assert got[0].teammate_id == "t" and got[0].summary == "s" and got[0].color is None and got[0].body == "b"
    assert got[1:] == [None, None]


def test_excerpt_keeps_its_promises(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["lorem", "hit", "ipsumdolor", "a", "bb"]) for _ in range(rnd.randint(1, 60))) for _ in range(80)]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").withColumn("ms", X.match_start(F.col("t"), "hit"))
    got = [r.e for r in X.with_excerpt(df, "t", "ms", 40, "e").orderBy("i").collect()]
    for t, e in zip(texts, got, strict=True):
        if "hit" not in t:
            assert e == t[:40]
            continue
        body = e.removeprefix("..." if not t.startswith(e[:3]) else "")
        body = body.removesuffix("..." if not t.endswith(body) else "")
        at = t.find(body)
        # The hit is in sight, the width is kept, and a cut end is marked and lies at a blank.
        assert "hit" in body and len(body) <= 40 and at >= 0
        assert e.startswith("...") == (at > 0) and e.endswith("...") == (at + len(body) < len(t))
        assert at == 0 or t[at - 1] == " " or " " not in t[at : t.find("hit")]
        assert at + len(body) == len(t) or t[at + len(body)] == " " or " " not in body


def test_failure_rules(spark):
    cases = {
        "<tool_use_error> Sibling tool call errored": "cascade", "he said Sibling tool call errored": "unclassified",
        "ModuleNotFoundError: x": "unclassified", "getaddrinfo ENOTFOUND host": "network",
        "column \"x\" does not exist": "unclassified", "Path \"/a/b\" does not exist": "bad_path",
        "Exit code 1 fatal: Not possible to fast-forward": "git_rejected", "Exit code 2": "exit_code", "": "unclassified",
        "your authentication token is missing required scopes": "auth_failed", "HTTP error 503": "http_status",
        "x" * 1001 + " command not found": "unclassified",
    }
    assert column(spark, list(cases), T.failure_kind) == list(cases.values())
    kinds = column(spark, T.FAILURE_KINDS, T.failure_category)
    assert len(kinds) == 17 and set(kinds) == {"cascade", "policy", "agent", "environment", "unknown"}
    with pytest.raises(ValueError):
        T.chosen("nope", T.FAILURE_KINDS)
    with pytest.raises(ValueError):
        T.chosen("thinking,text", ["thinking"])
    assert T.chosen(" a, b,", ["a", "b"]) == {"a", "b"} and T.chosen(None, []) == frozenset()


def test_names_and_ids(spark):
    assert column(spark, ["mcp__a__b__c", "mcp__a__", "Bash", "mcp____x"], T.tool_short_name) == ["b__c", "mcp__a__", "Bash", "mcp____x"]
    assert column(spark, ["abcdefghij", "", None], id8) == ["abcdefgh", "--------", "--------"]
    full = "a" * 36
    assert column(spark, ["aaaa", "", "b", full, full + "x"], lambda c: id_matches(c, F.lit(full))) == [True, False, False, True, False]
    with pytest.raises(ValueError):
        check_turn_id("1775406360x")
    sessions = spark.createDataFrame([("abcdef01" + "0" * 28, "p", 3), ("abcdef02" + "0" * 28, "p", 0), ("zz" + "1" * 34, "q", 1)], "session_id STRING, project STRING, message_count INT")
    wanted = spark.createDataFrame([("abcdef",), ("zz1",), ("nope",), ("abcdef02",)], "raw_id STRING")
    got = {r.raw_id: (r.status, r.session_id and r.session_id[:8]) for r in R.resolve_sessions(wanted, sessions).collect()}
    assert got == {"abcdef": ("unique", "abcdef01"), "zz1": ("unique", "zz111111"), "nope": ("not_found", None), "abcdef02": ("unique", "abcdef02")}


# --- position ----------------------------------------------------------------------------------------------


def test_context_radius(spark):
    kinds = ["human", "system", "human", "assistant", "tool_result", "human"]
    rows = spark.createDataFrame([("f", i, k, f"u{i}") for i, k in enumerate(kinds)], "file_path STRING, line_no BIGINT, entry_type STRING, uuid STRING")
    at = spark.createDataFrame([("f", 1, "x"), ("f", 3, "y")], "file_path STRING, line_no BIGINT, anchor STRING")
    around = lambda n: sorted((r.anchor, r.offset, r.uuid) for r in SE.read_turn(rows, at, n).collect())
    assert around(1) == [("x", -1, "u0"), ("x", 0, "u1"), ("x", 1, "u2"), ("y", -1, "u2"), ("y", 0, "u3"), ("y", 1, "u4")]
    assert around(0) == [("x", 0, "u1"), ("y", 0, "u3")]


# --- threads -------------------------------------------------------------------------------------------------


def walk(rows, tip, strict):
    by = {u: (u, p) for u, p in rows if u}
    chain, seen, cur = [], set(), tip
    while True:
        u, p = cur
        if u in seen:
            return None if strict else chain[::-1]
        seen.add(u)
        chain.append(u)
        if not p:
            return chain[::-1] if not strict or u == rows[0][0] else None
        if p not in by:
            return None if strict else chain[::-1]
        cur = by[p]


def test_threads_against_a_walk(spark):
    rnd = random.Random(4)
    files = {
        "line": [(f"{i}", f"{i - 1}" if i else None) for i in range(40)],
        "cycle": [("a", "c"), ("b", "a"), ("c", "b"), ("d", "c")],
        "gap": [("a", None), ("b", "zz"), ("c", "b")],
        "late_root": [("a", None), ("b", None), ("c", "b")],
        "no_ids": [(None, None), (None, None)],
        "one": [("a", None)],
    }
    for n in range(6):
        files[f"tree{n}"] = [(f"{i}", str(rnd.choice([i - 1, i - 1, rnd.randrange(i)])) if i else None) for i in range(60)]
    schema = "file_path STRING, line_no BIGINT, uuid STRING, parent_uuid STRING, is_sidechain BOOLEAN"
    rows = spark.createDataFrame([(f, i, u, p, False) for f, rs in files.items() for i, (u, p) in enumerate(rs)], schema)
    kept = {}
    for r in L.active_thread(rows).orderBy("file_path", "chain_no").collect():
        kept.setdefault(r.file_path, []).append((r.uuid, r.is_thread, r.dropped))
    targets = spark.createDataFrame([(f, f, len(rs) // 2) for f, rs in files.items() if f != "no_ids"], "key STRING, file_path STRING, line_no BIGINT")
    chains = {}
    for r in L.ancestor_chain(rows, targets).join(rows, ["file_path", "line_no"]).orderBy("key", "chain_no").collect():
        chains.setdefault(r.key, []).append(r.uuid)
    for f, rs in files.items():
        want = walk(rs, rs[-1], True) if f != "no_ids" else None
        assert [u for u, _, _ in kept[f]] == (want if want else [u for u, _ in rs]), f
        assert {(t, d) for _, t, d in kept[f]} == {(want is not None, len(rs) - len(want) if want else 0)}, f
        if f != "no_ids":
            assert chains[f] == walk(rs, rs[len(rs) // 2], False), f


# --- activity ---------------------------------------------------------------------------------------------------


def test_window_and_days_over_a_clock_change(spark):
    w = ACT.resolve_window(datetime(2026, 10, 31), datetime(2026, 11, 3), datetime(2026, 12, 1), "America/Los_Angeles", 60)
    assert w.lo == datetime(2026, 10, 31, 7, tzinfo=timezone.utc) and w.hi == datetime(2026, 11, 3, 8, tzinfo=timezone.utc)
    assert (w.days, w.buckets) == (3, 73)
    odd = ACT.Window(w.lo, datetime(2026, 10, 31, 7, 7, tzinfo=timezone.utc), 5)
    assert odd.buckets == 2
    grid = spark.createDataFrame([("s", b, 1, 2) for b in (0, 25, 26, 72)], "session_id STRING, bucket BIGINT, human BIGINT, agent BIGINT")
    found = spark.createDataFrame([("s", False)], "session_id STRING, headless BOOLEAN")
    days = {str(r.date): r for r in ACT.days(ACT.attention(grid, found), grid, found, w).collect()}
    assert list(days) and set(days) == {"2026-10-31", "2026-11-01", "2026-11-02"}
    assert days["2026-11-01"].human_turns_by_hour[1] == 2 and days["2026-11-01"].sessions_driven_by_hour[1] == 1
    assert days["2026-11-02"].human_turns_by_hour[23] == 1 and days["2026-10-31"].peak_at == "00:00"


# --- findings, debates, stores ------------------------------------------------------------------------------------


def test_merge_of_one_hot_spot(spark):
    def row(reviewer, line, severity="P2", confidence=50, route="manual", fix=None, title="A bug!"):
        return (1, reviewer, title, severity, "./a.py", line, confidence, route, "human", True, False, fix)

    data = [row("x", 10), row("y", 13, "P1", 75, "gated_auto"), row("x", 16, fix="f"), row("z", 20), row("x", 10), row("w", 0), row("w", 1, "P7"),
            row("testing", 50, "P3", 75, "advisory"), row("maintainability", 53, "P3", 75, "advisory", title="a  BUG")]
    df = spark.createDataFrame(data, "review_id INT, reviewer STRING, title STRING, severity STRING, file STRING, line INT, confidence INT, "
                               "autofix_class STRING, owner STRING, requires_verification BOOLEAN, pre_existing BOOLEAN, suggested_fix STRING")
    rows = FN.staged(FN.merge(df)).orderBy("line").collect()
    assert [(r.line, r.severity, r.confidence, r.autofix_class, r.action, r.reviewers, r.reports, r.stage) for r in rows] == [
        (10, "P1", 100, "manual", "Defer", ["x", "y"], 4, "primary"),
        (20, "P2", 50, "manual", "Defer", ["z"], 1, "suppressed"),
        (50, "P3", 100, "advisory", "Acknowledge", ["maintainability", "testing"], 2, "weak"),
    ]
    assert rows[0].disagreement == "x (P2), y (P1) -- kept P1"
    assert {(r.rule, r.dropped) for r in FN.rejected(df).collect()} == {("line", 1), ("severity", 1)}


def first_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_findings(spark):
    rows = [("r1", name, " ./src\\a.py", title, sev, "manual", "human", conf, line, False, False, fix)
            for name in ("correctness", "testing") for title, sev, conf in (("Off by one!", "P2", 50), ("off  BY one", "P0", 75))
            for line, fix in ((10, None), (13, "b"), (13, "a"), (13, "a"), (20, ""))]
    rows += [(None, *rows[0][1:]), ("r2", *rows[0][1:])]
    return spark.createDataFrame(rows, """review_id STRING, reviewer STRING, file STRING, title STRING, severity STRING, autofix_class STRING,
        owner STRING, confidence INT, line INT, requires_verification BOOLEAN, pre_existing BOOLEAN, suggested_fix STRING""")


def test_findings_are_never_broadcast(spark):
    """Tables look as small as their packed files, so a planner that may choose sends their rows through the driver."""
    found = FN.with_place(some_findings(spark))
    assert "BuildLeft" not in first_plan(found)
    df = spark.createDataFrame([("a", n) for n in range(9)], "g STRING, n BIGINT")
    for out in (O.running_count(df, ["g"], "n", "k"), O.previous_value(df, ["g"], "n", F.col("n"), "k"), O.rank_by_sort(df, ["g"], [F.desc("n")], "k")):
        assert "Broadcast" not in first_plan(out)
    spots = {(r.review_id, r.line): r.island for r in found.collect()}
    assert spots == {("r1", 10): 1, ("r1", 13): 1, ("r1", 20): 2, ("r2", 10): 1}


def test_equal_findings_meet_without_a_sort(spark):
    """An aggregate that keeps texts as minima sorts every row of a map task on all of its keys."""
    counted = FN._per_reviewer(some_findings(spark))
    assert "Sort" not in first_plan(counted)
    assert {(r.title_key, r.file_key, r.line, r.suggested_fix, r.has_fix, r.n) for r in counted.where("review_id = 'r1' AND severity = 'P0'").collect()} == {
        ("off by one", "src/a.py", line, fix, bool(fix), n) for line, fix, n in ((10, None, 1), (13, "b", 1), (13, "a", 2), (20, "", 1))}


def test_categories_are_what_their_patterns_find(spark):
    """Literals that are looked for first keep no match away; every alternative of every pattern occurs."""
    rnd = random.Random(3)
    patterns = [p for found in V.PROMPT_CATEGORIES.values() for p in found]
    assert set(V.PROMPT_LITERALS) == set(patterns)

    def written(node):
        op, arg = node
        if str(op) == "LITERAL":
            return chr(arg)
        if str(op) == "SUBPATTERN":
            return "".join(map(written, arg[3]))
        if str(op) == "BRANCH":
            return "".join(map(written, rnd.choice(arg[1])))
        if str(op) == "MAX_REPEAT":
            return "".join("".join(map(written, arg[2])) for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 2))))
        if str(op) == "IN":
            return " " if str(arg[0][0]) == "CATEGORY" else chr(rnd.choice([a for o, a in arg if str(o) == "LITERAL"]))
        return "" if str(op) == "AT" else " "

    texts = []
    for p in patterns:
        made = {"".join(map(written, re._parser.parse(p))) for _ in range(80)}
        matched = [m for m in made if re.search(p, m)]
        assert matched and all(any(t in m for t in V.PROMPT_LITERALS[p]) for m in matched)
        texts += [lead + m + end for m in sorted(made) for lead, end in (("", ""), ("x", " é"), ("ein Satz, ", "y"), ("Ü\n", ".\n"))]
    want = [[n for n, ps in V.PROMPT_CATEGORIES.items() if any(re.search(p, t.lower()) for p in ps)] for t in texts]
    assert column(spark, texts, kvmine.prompt_categories) == want


def test_debate_and_stores(spark):
    moves = spark.createDataFrame([("a", 1, "HOLD"), ("b", 1, "UPDATE"), ("b", 2, "HOLD")] + [("c", r, "DISPUTE") for r in range(1, 6)], "run_id STRING, round INT, move_type STRING")
    got = {r.run_id: (r.state, r.after_round) for r in debate.end_state(moves).collect()}
    assert got == {"a": ("quiet", 1), "b": ("quiet", 2), "c": ("capped", 4)}
    kv = spark.createDataFrame([("s", "t", "aiService.prompts", '[{"text":"please stop, that is wrong","commandType":4},{"text":"short"},{"text":"Let\'s try a different approach"}]'),
                                ("s", "t", "composerData:c1", '{"conversation":[{"type":1,"text":"hi"},{"type":2,"bubbleId":"b"},{"type":3}]}'),
                                ("s", "t", "bubbleId:c1:b", '{"content":"from bubble"}')], "source_db STRING, table_name STRING, key STRING, value STRING")
    assert {r.category: r.prompts for r in kvmine.category_counts(kvmine.prompts(kv)).collect()} == {"corrections": 1, "redirections": 1}
    turns = [(r.role, r.text) for r in kvmine.pull_conversations(kv).orderBy("turn").collect()]
    assert turns == [("USER", "hi"), ("ASSISTANT", "from bubble"), ("TYPE_3", "")]
    assert V.TURN_TEXT_MAX == 2000
