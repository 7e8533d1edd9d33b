"""Transcripts, key/value stores, findings and moves derived by Spark from the given tables.

Each frame here has one row per row of a table (or per small aggregate of it) and is built from
whole rows, so its work grows with the table. The log lines are real JSON text: every query over
them goes through the same parser as files on disk do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import fixed_values as V

EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z

# FIXED VALUES. Texts of failed results, by event number.
FAILURE_TEXTS = [
    "Sibling tool call errored",
    "The user doesn't want to proceed with this tool use",
    "Permission to use Bash has been denied",
    "File has not been read yet",
    "Result exceeds maximum allowed tokens",
    "String to replace not found in file",
    "InputValidationError: bad input",
    "ssh: connect to host example port 22: Connection refused",
    "401 Unauthorized",
    "Request failed with status code 503",
    "Command timed out after 120s",
    "bash: foo: command not found",
    "! [rejected] main -> main (non-fast-forward)",
    "SyntaxError: invalid syntax",
    "Path \"/tmp/x\" does not exist",
    "Exit code 1",
    "Exit code 2\n\n  ENOENT:   no such\tfile or directory",
    "column \"x\" does not exist",
    "something odd happened",
]
# FIXED VALUES. Tool names of calls, by event number.
CALL_NAMES = ["Bash", "Read", "mcp__data-hub__query", "mcp__data_hub__query", "query", "Agent", "mcp__web__fetch", "mcp__files__fetch"]
# FIXED VALUES. Openings of prompts, by number, so that every behaviour category occurs.
OPENINGS = [
    "No, that's wrong.", "Let's try something else.", "For context, we use one service.",
    "Keep it simple, step by step.", "The opus model is better.", "Why does this fail? Ugh.", "Hello.",
]
SESSION_TAIL = "-0000-4000-8000-000000000000"
TURN_TAIL = "-0000-4000-9000-000000000000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits it has. A session may ask for more of them for tables that are one small file
    (`spark.threadloom.spread`); nothing is shuffled otherwise."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("spark.threadloom.spread", None)
    return rows.repartition(int(spread)) if spread else rows


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a given table over several tasks a core, whatever row groups its files have. For tables whose rows are short
    and become long texts that are parsed again: a file of 5 MB is 600,000 of them, and is read by one or two tasks."""
    spark = rows.sparkSession
    if spark.conf.get("spark.threadloom.spread", None):
        return rows
    return rows.repartition(4 * spark.sparkContext.defaultParallelism)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def session_id(number: Column) -> Column:
    return F.format_string("%08x" + SESSION_TAIL, number.cast("bigint"))


def turn_id(number: Column) -> Column:
    return F.format_string("%08x" + TURN_TAIL, number.cast("bigint"))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _some(**fields) -> Column:
    """Struct of the given fields; to_json leaves out the null ones."""
    return F.struct(*[v.alias(k) for k, v in fields.items()])


# --- conversations ---------------------------------------------------------------------------------------


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript per conv_id, one line per turn."""
    c, t, text = F.col("conv_id"), F.col("turn"), F.col("text")
    none = F.lit(None).cast("string")
    tool = ((c + t) % 5).cast("int")
    data = _some(
        command=F.when(tool == 0, text), description=F.when(tool.isin(0, 4), F.lit("step")),
        file_path=F.when(tool == 1, F.concat(F.lit("/src/"), c.cast("string"), F.lit(".py"))),
        pattern=F.when(tool == 2, F.lit("the")), path=F.when(tool == 2, F.lit("/src")),
        query=F.when(tool == 3, text), limit=F.when(tool == 3, t),
        subagent_type=F.when(tool == 4, F.lit("scout")), prompt=F.when(tool == 4, text),
    )
    names = F.element_at(F.array(*[F.lit(n) for n in ["Bash", "Read", "Grep", "mcp__notes__lookup", "Agent"]]), tool + 1)

    def block(kind, text=none, thinking=none, id=none, name=none, input=None):
        empty = F.lit(None).cast("struct<command:string,description:string,file_path:string,pattern:string,"
                                 "path:string,query:string,limit:bigint,subagent_type:string,prompt:string>")
        return _some(type=F.lit(kind), text=text, thinking=thinking, id=id, name=name, input=empty if input is None else input)

    blocks = F.array_compact(F.array(
        F.when((c % 3 == 0) & (t % 2 == 1), block("thinking", thinking=F.concat(F.lit("considering "), text))),
        block("text", text=text),
        F.when(t % 3 == 1, block("tool_use", id=F.concat_ws("_", F.lit("toolu"), c, t), name=names, input=data)),
    ))
    usage = _some(
        input_tokens=F.length(text) * 50, cache_creation_input_tokens=(c % 7) * 100,
        cache_read_input_tokens=t * 1000, output_tokens=F.length(text),
    )
    said = F.when(c % 2 == 0, F.to_json(_some(role=F.lit("user"), content=text))).otherwise(
        F.to_json(_some(role=F.lit("user"), content=F.array(_some(type=F.lit("text"), text=text))))
    )
    answered = F.to_json(_some(
        id=F.concat_ws("-", F.lit("msg"), c, t), type=F.lit("message"), role=F.lit("assistant"),
        model=F.concat(F.lit("model-"), (c % 3).cast("string")), content=blocks, usage=usage,
    ))
    role = F.col("role")
    # An edit: every fourth turn answers the turn before the previous one.
    parent = F.when(t > 0, turn_id(c * 65536 + t - F.when(t % 4 == 3, 2).otherwise(1)))
    head = F.to_json(_some(
        type=F.when(role == "system", "system").when(role == "assistant", "assistant").otherwise("user"),
        uuid=turn_id(c * 65536 + t), parentUuid=parent,
        timestamp=_iso(F.timestamp_seconds(F.lit(EPOCH) + c * 3600 + t * 37)),
        sessionId=session_id(c), cwd=F.concat(F.lit("/work/p"), (c % 5).cast("string")),
        version=F.concat(F.lit("1."), (c % 3).cast("string")),
        gitBranch=F.concat(F.lit("b"), (t % 2).cast("string")),
        requestId=F.concat_ws("-", F.lit("req"), c, F.floor(t / 2)),
        subtype=F.when(role == "system", "turn_duration"), durationMs=F.when(role == "system", F.length(text) * 100),
    ))
    message = F.when(role == "assistant", answered).when(role == "user", said)
    value = F.when(message.isNull(), head).otherwise(
        F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"message":'), message, F.lit("}"))
    )
    return table(spark, sf_dir, "conversations").withColumn("head", head).select(
        F.concat(F.lit("p"), (c % 5).cast("string")).alias("project"),
        F.concat(F.lit("/logs/p"), (c % 5).cast("string"), F.lit("/"), session_id(c), F.lit(".jsonl")).alias("file_path"),
        t.alias("line_no"),
        value.alias("value"),
    )


# --- events ------------------------------------------------------------------------------------------------


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user_id, one line per event; every tenth event stands in an agent's file."""
    e, u, kind, v = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value")
    k = F.get_json_object("props", "$.k")
    use = F.concat_ws("_", F.lit("toolu"), u, k)
    said = (
        F.when(e % 4 == 1, "[Request interrupted by user]")
        .when(e % 4 == 2, F.concat(F.lit('<teammate-message color="blue" teammate_id="lead">do '), k, F.lit("</teammate-message>")))
        .when(e % 4 == 3, "<command-name>/clear</command-name>")
        .otherwise(F.concat(F.lit("signed up with "), k))
    )
    human = F.to_json(_some(role=F.lit("user"), content=said))
    model = F.concat(F.lit("model-"), (e % 3).cast("string"))
    usage = _some(input_tokens=F.floor(v * 1000), output_tokens=F.lit(10))
    call = F.to_json(_some(
        id=F.concat(F.lit("msg"), e), type=F.lit("message"), role=F.lit("assistant"), model=model, usage=usage,
        content=F.array(_some(type=F.lit("tool_use"), id=use, name=_pick(CALL_NAMES, e),
                              input=_some(query=F.col("props"), description=F.concat(F.lit("task "), k)))),
    ))
    talk = F.to_json(_some(
        id=F.concat(F.lit("msg"), e), type=F.lit("message"), role=F.lit("assistant"), model=model, usage=usage,
        content=F.array(_some(type=F.lit("text"), text=F.concat(F.lit("looking at "), k))),
    ))
    failed = kind == "error"
    told = F.when(failed, F.concat(_pick(FAILURE_TEXTS, e), F.lit(" "), F.col("props"))).otherwise(
        F.concat(F.when(e % 5 == 0, F.lit("entry not found ")).otherwise(F.lit("ok ")), F.col("props"))
    )
    result = F.to_json(_some(role=F.lit("user"), content=F.array(_some(
        type=F.lit("tool_result"), tool_use_id=use, is_error=failed,
        content=F.array(_some(type=F.lit("text"), text=told)),
    ))))
    is_result = kind.isin("error", "purchase")
    agent = (e % 10 == 0) & (kind != "signup")
    agent_id = F.format_string("a%016x", u.cast("bigint"))
    head = F.to_json(_some(
        type=F.when(kind.isin("click", "view"), "assistant").otherwise("user"),
        uuid=turn_id(e), timestamp=_iso(F.col("ts")), sessionId=session_id(u),
        entrypoint=F.when(u % 7 == 0, "sdk-cli").otherwise("cli"),
        teamName=F.when(u % 11 == 0, "team"), agentName=F.when(u % 11 == 0, "worker"),
        gitBranch=F.concat(F.lit("b"), (e % 3).cast("string")),
        requestId=F.when(kind.isin("click", "view"), F.concat(F.lit("req"), F.floor(e / 4))),
        toolUseResult=F.when(is_result, F.lit("{}")),
    ))
    message = F.when(kind == "click", call).when(kind == "view", talk).when(is_result, result).otherwise(human)
    folder = F.concat(F.lit("/logs/p"), (u % 5).cast("string"), F.lit("/"), session_id(u))
    return dealt(table(spark, sf_dir, "events")).withColumn("head", head).select(
        F.concat(F.lit("p"), (u % 5).cast("string")).alias("project"),
        F.when(agent, F.concat(folder, F.lit("/subagents/agent-"), agent_id, F.lit(".jsonl")))
        .otherwise(F.concat(folder, F.lit(".jsonl"))).alias("file_path"),
        e.alias("line_no"),
        # Conditions on the line stay above the explode: below it they would write every line a second time.
        F.explode(F.array(F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"message":'), message, F.lit("}")))).alias("value"),
    )


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`event_lines`, and with them a second agent of each user. Every third signup also speaks to that agent; every second
    view tells how long the main transcript took, every second click how long the agent did."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    folder = F.concat(F.lit("/logs/p"), (u % 5).cast("string"), F.lit("/"), session_id(u))
    agent = F.concat(folder, F.lit("/subagents/agent-"), F.format_string("d%016x", u.cast("bigint")), F.lit(".jsonl"))
    line = lambda part, what, **more: F.to_json(_some(
        type=F.lit(what), uuid=turn_id(e + (part << 28)), timestamp=_iso(F.col("ts")), sessionId=session_id(u), **more))
    asked = line(1, "user", message=_some(role=F.lit("user"), content=F.lit("look again")))
    took = lambda part, ms: line(part, "system", subtype=F.lit("turn_duration"), durationMs=ms)
    value = (
        F.when((kind == "signup") & (e % 3 == 0), asked)
        .when((kind == "view") & (e % 2 == 0), took(2, e * 50)).when((kind == "click") & (e % 2 == 0), took(3, e * 10)))
    more = table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (u % 5).cast("string")).alias("project"),
        F.when(kind == "view", F.concat(folder, F.lit(".jsonl"))).otherwise(agent).alias("file_path"),
        (e + 1_000_000_000_000).alias("line_no"), value.alias("value"))
    return event_lines(spark, sf_dir).unionByName(more.where("value IS NOT NULL"))


def copied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`event_lines`, and for every third user a copy of an agent: a provenance line, and the lines of the user's events
    whose number ends in 1. Copies of even users have the lines they were made with, those of odd users have grown."""
    rows = event_lines(spark, sf_dir)
    e, u = F.col("event_id"), F.col("user_id")
    given = table(spark, sf_dir, "events").where(u % 3 == 0)
    agent = F.format_string("c%016x", u.cast("bigint"))
    place = F.concat(F.lit("/logs/p"), (u % 5).cast("string"), F.lit("/"), session_id(u), F.lit("/subagents/agent-"), agent, F.lit(".jsonl"))
    project = F.concat(F.lit("p"), (u % 5).cast("string"))
    per_user = given.groupBy("user_id").agg(F.count_if(e % 10 == 1).alias("n"))
    said = F.to_json(_some(type=F.lit(V.PROVENANCE_TYPE), sessionId=session_id(u), agentId=agent, x_converter=F.struct(
        F.lit("copier").alias("tool"), F.lit(1).alias("v"),
        F.struct(F.lit("session").alias("kind"), session_id(u).alias("id"), project.alias("project")).alias("from"),
        _iso(F.timestamp_seconds(F.lit(EPOCH) + (u % 5 * -1 + 2) * 86_400)).alias("converted_at"),
        (1 + F.when(u % 2 == 0, F.col("n")).otherwise(0)).alias("lines_at_creation"))))
    heads = per_user.select(project.alias("project"), place.alias("file_path"), F.lit(0).cast("bigint").alias("line_no"), said.alias("value"))
    # The lines of a copy are those of the events; the number of a line is its event's.
    copied = given.where(e % 10 == 1).select(e.alias("line_no"), project.alias("project"), place.alias("file_path"))
    copied = copied.join(rows.select("line_no", "value"), "line_no").select("project", "file_path", "line_no", "value")
    return rows.unionByName(heads).unionByName(copied)


def dispatch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click as the dispatch of an agent. By event number its result is complete, launched, in the background,
    rejected or missing; for the second and third a notification follows."""
    e, u = F.col("event_id"), F.col("user_id")
    use, agent, how = F.concat(F.lit("toolu_"), e), F.format_string("b%016x", e.cast("bigint")), e % 5
    head = lambda kind, part, **more: _some(
        type=F.lit(kind), uuid=turn_id(e * 3 + part), timestamp=_iso(F.col("ts")), sessionId=session_id(u), **more)
    call = F.to_json(head("assistant", 0, message=_some(
        id=F.concat(F.lit("msg"), e), type=F.lit("message"), role=F.lit("assistant"), model=F.lit("model-1"),
        content=F.array(_some(type=F.lit("tool_use"), id=use, name=F.lit("Agent"), input=_some(
            description=F.concat(F.lit("task "), e), subagent_type=F.lit("scout"), prompt=F.lit("go")))))))
    said = _some(role=F.lit("user"), content=F.array(_some(type=F.lit("tool_result"), tool_use_id=use, content=F.concat(F.lit("answer "), e))))
    empty = F.lit(None).cast("struct<id:string>")
    payload = F.to_json(_some(
        agentId=F.when(how < 2, agent), status=F.when(how == 0, "completed").when(how == 1, "async_launched"),
        totalTokens=F.when(how == 0, e), totalToolUseCount=F.when(how == 0, 3), task=F.when(how == 2, F.struct(agent.alias("id"))).otherwise(empty)))
    payload = F.when(how == 3, F.lit('"User rejected this"')).otherwise(payload)
    answer = F.to_json(head("user", 1, message=said))
    answer = F.concat(F.substring(answer, F.lit(1), F.length(answer) - 1), F.lit(',"toolUseResult":'), payload, F.lit("}"))
    note = F.to_json(head("queue-operation", 2, operation=F.lit("enqueue"), content=F.concat(
        F.lit("<task-notification><task-id>"), agent, F.lit("</task-id><status>finished</status><result>late "), e,
        F.lit("</result><usage>total_tokens: "), e + 1, F.lit("\n<tool_uses>4</tool_uses></usage></task-notification>"))))
    lines = F.array_compact(F.array(
        F.struct(F.lit(0).alias("part"), call.alias("value")), F.when(how < 4, F.struct(F.lit(1).alias("part"), answer.alias("value"))),
        F.when(how.isin(1, 2), F.struct(F.lit(2).alias("part"), note.alias("value")))))
    return table(spark, sf_dir, "events").where("event_type = 'click'").select(
        F.concat(F.lit("p"), (u % 5).cast("string")).alias("project"),
        F.concat(F.lit("/logs/p"), (u % 5).cast("string"), F.lit("/"), session_id(u), F.lit(".jsonl")).alias("file_path"),
        e.alias("event_id"), F.explode(lines).alias("l"),
    ).select("project", "file_path", (F.col("event_id") * 3 + F.col("l.part")).alias("line_no"), "l.value")


def document_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the result of a failed call: source is the session, lang the project."""
    d = F.col("doc_id")
    name = F.concat(F.lit("mcp__"), F.col("lang"), F.lit("__fetch"))
    lead = F.when(d % 2 == 0, F.concat(_pick(FAILURE_TEXTS, F.floor(d / 2)), F.lit(" "))).otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("project"), F.concat(F.lit("/logs/"), F.col("source")).alias("file_path"),
        F.col("source").alias("session_id"), F.lit(None).cast("string").alias("agent_id"),
        d.alias("line_no"), F.lit(0).alias("pos"), name.alias("tool_name"),
        F.col("lang").alias("server"), F.lit("fetch").alias("short_name"),
        F.timestamp_seconds(F.lit(EPOCH) + d).alias("ts"), F.lit(True).alias("has_result"),
        F.lit(True).alias("is_error"), F.concat(lead, F.col("text")).alias("result_text"),
    )


def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a prompt of its source."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "source", d.alias("pos"), F.concat(_pick(OPENINGS, d), F.lit(" "), F.col("text")).alias("text")
    )


# --- key/value stores ------------------------------------------------------------------------------------------


def kv(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """Rows of chat stores: daily, prompts, generations, headers or conversations."""
    c, t, text = F.col("conv_id"), F.col("turn"), F.col("text")
    store = F.concat(F.lit("store-"), (c % 20).cast("string"))
    talk = table(spark, sf_dir, "conversations")
    if part == "daily":
        e = F.col("event_id")
        day = F.date_format("ts", "yyyy-MM-dd")
        rows, key = table(spark, sf_dir, "events"), F.concat(F.lit("aiCodeTracking.dailyStats.v1."), day)
        store = F.concat(F.lit("store-"), (F.col("user_id") % 20).cast("string"))
        value = F.to_json(_some(
            date=day, tabSuggestedLines=e % 50, tabAcceptedLines=e % 20,
            composerSuggestedLines=F.when(e % 3 == 0, e % 30), composerAcceptedLines=F.when(e % 3 == 0, e % 10),
        ))
    elif part == "prompts":
        rows, key = talk.where(F.col("role") == "user"), F.lit("aiService.prompts")
        opened = F.concat(_pick(OPENINGS, c + t), F.lit(" "), text)
        value = F.to_json(F.array(_some(text=opened, commandType=F.when(t % 2 == 0, 4).otherwise(1))))
    elif part == "generations":
        rows, key = talk.where(F.col("role") == "assistant"), F.lit("aiService.generations")
        value = F.to_json(F.array(_some(
            type=F.when(t % 3 == 0, "composer"), unixMs=(F.lit(EPOCH) + c * 86400 + t) * 1000,
            modelName=F.when(c % 2 == 0, F.concat(F.lit("model-"), (c % 3).cast("string"))), text=text,
        )))
    elif part == "headers":
        sizes = talk.groupBy("conv_id").agg(
            F.sum(F.length("text")).alias("added"), F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).alias("removed"),
            F.count(F.lit(1)).alias("n"),
        )
        rows, key = sizes, F.lit("composer.composerData")
        value = F.to_json(_some(allComposers=F.array(_some(
            composerId=session_id(c), name=F.when(c % 4 != 0, F.concat(F.lit("talk "), c.cast("string"))),
            createdAt=(F.lit(EPOCH) + c * 86400) * 1000, totalLinesAdded=F.col("added"), totalLinesRemoved=F.col("removed"),
            filesChangedCount=F.col("n"), unifiedMode=F.when(c % 2 == 0, "agent"),
        ))))
    elif part == "conversations":
        one = session_id(c * 65536 + t)
        bare = t % 2 == 1
        whole = talk.select(store.alias("source_db"), F.concat(F.lit("composerData:"), one).alias("key"), F.to_json(_some(
            composerId=one, conversation=F.array(_some(
                type=F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(9),
                bubbleId=F.concat(F.lit("b"), t.cast("string")), text=F.when(~bare, text),
            )))).alias("value"))
        bubbles = talk.where(bare).select(
            store.alias("source_db"),
            F.concat(F.lit("bubbleId:"), one, F.lit(":b"), t.cast("string")).alias("key"),
            F.to_json(_some(content=text)).alias("value"),
        )
        return whole.unionByName(bubbles).withColumn("table_name", F.lit("disk"))
    else:
        raise ValueError(part)
    return rows.select(store.alias("source_db"), F.lit("items").alias("table_name"), key.alias("key"), value.alias("value"))


# --- findings and moves -------------------------------------------------------------------------------------------


def findings(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One finding per line item, with `more` of its columns; some break a rule on purpose."""
    q = F.col("l_quantity").cast("bigint")
    p, o, s, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    pick = lambda i, *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (i % len(vs) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        (s % 20).alias("review_id"),
        pick(p, "security", "correctness", "testing", "maintainability", "performance", "standards").alias("reviewer"),
        F.concat(F.lit("Issue "), pick(o, "A", "b!", "C  c")).alias("title"),
        pick(n, "P0", "P1", "P2", "P3", "P9").alias("severity"),
        F.concat(F.lit("./src/f"), (p % 50).cast("string"), F.lit(".py")).alias("file"),
        (o % 200).cast("int").alias("line"),
        (25 * (q % 5)).cast("int").alias("confidence"),
        pick(q, "safe_auto", "gated_auto", "manual", "advisory").alias("autofix_class"),
        pick(s, "review-fixer", "downstream-resolver", "human", "release").alias("owner"),
        (F.col("l_returnflag") == "R").alias("requires_verification"),
        ((F.col("l_linestatus") == "O") & (o % 3 == 0)).alias("pre_existing"),
        F.when(p % 2 == 0, F.concat(F.lit("fix "), (p % 10).cast("string"))).alias("suggested_fix"), *more,
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one reviewer's return with one finding; some returns lack a part."""
    rows = findings(spark, sf_dir, "l_orderkey", "l_partkey")
    given = F.struct(*[c for c in rows.columns if c not in ("review_id", "reviewer", "l_orderkey", "l_partkey")])
    lacks = F.col("l_orderkey") % 50
    text = lambda lead, n: F.array(F.concat(F.lit(lead), n.cast("string")))
    return rows.select(
        "review_id", F.when(lacks != 9, F.col("reviewer")).otherwise(" ").alias("reviewer"),
        F.when(lacks != 11, F.array(given)).alias("findings"),
        F.when(lacks != 7, text("risk ", F.col("l_partkey") % 50)).alias("residual_risks"), text("gap ", F.col("l_orderkey") % 40).alias("testing_gaps"),
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as debates: the role and the length of a turn decide its move."""
    kind = (
        F.when(F.length("text") % 3 == 0, F.when(F.col("role") == "user", "DISPUTE").otherwise("UPDATE"))
        .when(F.length("text") % 7 == 0, "WITHDRAW").otherwise("HOLD")
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), (F.floor(F.col("turn") / 2) + 1).alias("round"), "role",
        kind.alias("move_type"), F.lit("").alias("target"),
    )
