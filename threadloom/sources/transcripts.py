"""JSONL transcripts: from text lines to typed entries.

`lines`   file_path, file_mtime, line_no (0-based, physical), value
`entries` one row per typed line, content normalised to an array of blocks
`rejects` lines that are no JSON object, have an unknown type, or lack required fields

The line number is the only order the rest of the library relies on. It is unique within a file
and dense, so `line_no div BLOCK` cuts even a huge file into bounded pieces.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.operators.ordered import matching

_PATH_AGENT = "/subagents/(?:.*/)?agent-([^/]*)\\.jsonl$"
_PATH_SESSION = "/([^/]+)/subagents/"
_PATH_RUN = "/subagents/(?:.*/)?workflows/([^/]+)/"
_PATH_STEM = "([^/]+)\\.jsonl$"

_JSON = {"maxStringLen": "2147483647", "allowSingleQuotes": "false"}
_STRICT = {**_JSON, "allowNonNumericNumbers": "false"}

#: Fields of a line, of its message, and of the message's usage that a typed entry takes.
_FIELDS = {
    **dict.fromkeys(("type", "uuid", "parentUuid", "timestamp", "sessionId"), "STRING"), "isSidechain": "BOOLEAN",
    **dict.fromkeys(("cwd", "version", "agentId", "gitBranch", "entrypoint", "teamName", "agentName", "requestId"), "STRING"), "isMeta": "BOOLEAN",
    **dict.fromkeys(("promptSource", "toolUseResult", "subtype"), "STRING"), "durationMs": "BIGINT", "messageCount": "BIGINT",
    **dict.fromkeys(("summary", "leafUuid", "operation"), "STRING"),
}
_MESSAGE = dict.fromkeys(("id", "type", "role", "model", "stop_reason"), "STRING")
_USAGE = dict.fromkeys(("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens"), "BIGINT")


def _ddl(fields: dict[str, str], between: str = ": ") -> str:
    return ", ".join(f"{name}{between}{kind}" for name, kind in fields.items())


_ENVELOPE = f"{_ddl(_FIELDS, ' ')}, message STRUCT<{_ddl(_MESSAGE)}, usage: STRUCT<{_ddl(_USAGE)}>>"
_VARIANT_ENVELOPE = f"STRUCT<{_ddl(_FIELDS)}, content: VARIANT, message: STRUCT<{_ddl(_MESSAGE)}, content: VARIANT, usage: STRUCT<{_ddl(_USAGE)}>>>"
_VARIANT_BLOCK = """STRUCT<type: STRING, text: STRING, thinking: STRING, id: STRING, name: STRING, tool_use_id: STRING, content: VARIANT,
  is_error: BOOLEAN, source: STRUCT<type: STRING, media_type: STRING>>"""
#: Follows a line in a list of two, so that the parse which reads the line also sees that nothing comes after it.
_END = 7_741_905_581
_BLOCK = """
  type STRING, text STRING, thinking STRING, signature STRING, id STRING, name STRING,
  input STRING, tool_use_id STRING, content STRING, is_error BOOLEAN,
  source STRUCT<type: STRING, media_type: STRING>
"""

PARTS_TYPE = "array<struct<kind:string,text:string>>"


# --- A1, A5, C9: lines and what the path says ----------------------------------------------------


def _reader(spark: SparkSession, modified_since: datetime | None, suffix: str = "jsonl") -> DataFrameReader:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}")
    if modified_since is None:
        return reader
    # Files are append-only: one last written before a window cannot reach into it. The reader's
    # bound is exclusive and in whole seconds, so the second of the bound itself is taken along.
    since = modified_since if modified_since.tzinfo else modified_since.replace(tzinfo=timezone.utc)
    bound = since.astimezone(timezone.utc) - timedelta(seconds=1)
    return reader.option("timeZone", "UTC").option("modifiedAfter", bound.strftime("%Y-%m-%dT%H:%M:%S"))


def scan_lines(
    spark: SparkSession, path: str | list[str], modified_since: datetime | None = None, suffix: str = "jsonl", one_text: bool = False,
) -> DataFrame:
    """All physical lines of the `.jsonl` files below `path` (a folder, a file, or a list of them), with their line numbers.

    A file may span many splits. Lines of one split are consecutive in one task, so the number
    within the split is a subtraction; only the row count per split is aggregated, and only those
    counts are ordered per file. No task ever holds a whole file, and no line is shuffled or joined: see
    `split_shifts`. `modified_since` without a zone is UTC. With `one_text` numbers go on from file to file, in order of
    their paths.
    """
    raw = _reader(spark, modified_since, suffix).text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )
    told = raw.select("*", F.get(split_shifts(raw, one_text).scalar(), F.shiftright("_row", _ROW_BITS).cast("int")).alias("_shifts"), _split_print().alias("_print"))
    shift = F.get(F.filter("_shifts", lambda s: s["split"] == F.col("_print")), 0)["shift"]
    changed = F.raise_error(F.concat(F.lit("read in other splits than were counted: "), "file_path")).cast("bigint")
    return told.select("file_path", "file_mtime", (F.col("_row") + F.coalesce(shift, changed)).alias("line_no"), "value")


def no_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file_path STRING, file_mtime TIMESTAMP, line_no BIGINT, value STRING")


def _split_print() -> Column:
    return F.xxhash64("file_path", "_split")


#: `monotonically_increasing_id` puts the number of the task above this many bits.
_ROW_BITS = 33


def split_shifts(raw: DataFrame, one_text: bool = False) -> DataFrame:
    """One row, one list: by number of the task, the splits it reads (a hash of file and place, and what to add to a row
    id to get the line number).

    It goes to the tasks with their plan, as a constant. It has two numbers a split, far less than the list of files
    and splits itself, which the reader keeps in the driver and gives to the tasks as well. Splits depend on sizes of
    files and on settings; for input below `spark.sql.files.maxPartitionBytes` a core also on the number of cores, unless
    `spark.sql.files.minPartitionNum` is set. Should they change between counting and reading, the read fails.
    """
    splits = raw.groupBy(F.shiftright("_row", _ROW_BITS).alias("_task"), "file_path", "_split").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    per_file = Window.orderBy("file_path", "_split") if one_text else Window.partitionBy("file_path").orderBy("_split")
    before = F.coalesce(F.sum("_rows").over(per_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("_task", F.struct(_split_print().alias("split"), (before - F.col("_first")).alias("shift")).alias("s"))
    tasks = placed.groupBy("_task").agg(F.collect_list("s").alias("s"))
    # Tasks without rows have a place too.
    known = tasks.agg(F.max("_task").alias("n"))
    dense = known.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "n")).alias("_task")).join(tasks, "_task", "left")
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("_task", "s"))), lambda e: e["s"]).alias("shifts"))


def path_columns(path: Column) -> dict[str, Column]:
    """session_id, agent_id and workflow_run_id as encoded in a transcript path."""

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))

    agent = part(_PATH_AGENT)
    return {
        "session_id": F.when(agent.isNotNull(), part(_PATH_SESSION)).otherwise(part(_PATH_STEM)),
        "agent_id": agent,
        "workflow_run_id": part(_PATH_RUN),
    }


def project_dir(path: Column) -> Column:
    """Folder that holds the session files of a transcript path."""
    return F.regexp_replace(path, "(/[^/]+/subagents/.*|/[^/]+\\.jsonl)$", "")


# --- A2 to A4: typed entries ------------------------------------------------------------------------


def _sql(text: str) -> str:
    return "'" + " ".join(text.split()) + "'"


def _names(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


_STRICT_OPTIONS = "map('maxStringLen', '2147483647', 'allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"
_OPTIONS = "map('maxStringLen', '2147483647', 'allowSingleQuotes', 'false')"
_NO_PARTS = f"cast(null AS {PARTS_TYPE})"


def normalise_content(elements: str, bare: str, assistant: str) -> Column:
    """Message content of either shape to an array of blocks.

    `elements` names the raw elements of a list (null when the content is no list), `bare` the
    content as text, `assistant` the flag of the side. Each `transform` is one step whose result
    the next one reads, so every element is parsed once. A block that is malformed, or that its
    side does not allow, becomes a text block with the JSON text.
    """
    parsed = f"""transform({elements}, x -> named_struct('raw', x, 'b', from_json(x, {_sql(_BLOCK)}, {_OPTIONS})))"""
    listed = f"""transform({parsed}, p -> named_struct('raw', p.raw, 'b', p.b, 'list',
        if(p.b.type = 'tool_result', from_json(p.raw, 'content ARRAY<STRING>', {_OPTIONS}).content, null)))"""
    parted = f"""transform({listed}, p -> named_struct('raw', p.raw, 'b', p.b,
        'list_ok', p.list IS NULL OR forall(p.list, y -> coalesce(startswith(y, '{{'), false)),
        'parts', CASE WHEN p.b.type <> 'tool_result' THEN {_NO_PARTS}
          WHEN p.list IS NULL THEN array(named_struct('kind', 'text', 'text', p.b.content))
          ELSE filter(transform(
            transform(p.list, y -> from_json(y, 'type STRING, text STRING', {_OPTIONS})),
            q -> named_struct('kind', q.type, 'text', coalesce(q.text, ''))), q -> q.kind IN ('text', 'image')) END))"""
    kinded = f"""transform({parted}, p -> named_struct('raw', p.raw, 'b', p.b, 'parts', p.parts, 'kind', CASE
        WHEN NOT array_contains(if({assistant}, {_names(V.ASSISTANT_BLOCK_TYPES)}, {_names(V.USER_BLOCK_TYPES)}), p.b.type) THEN null
        WHEN p.b.type = 'text' AND p.b.text IS NOT NULL THEN 'text'
        WHEN p.b.type = 'thinking' AND p.b.thinking IS NOT NULL THEN 'thinking'
        WHEN p.b.type = 'tool_use' AND p.b.id IS NOT NULL AND p.b.name IS NOT NULL AND startswith(p.b.input, '{{') THEN 'tool_use'
        WHEN p.b.type = 'tool_result' AND p.b.tool_use_id IS NOT NULL AND p.b.content IS NOT NULL AND p.list_ok THEN 'tool_result'
        WHEN p.b.type = 'image' AND p.b.source.type = 'base64' AND p.b.source.media_type IS NOT NULL THEN 'image' END))"""
    blocks = f"""transform({kinded}, (p, i) -> named_struct(
        'pos', i, 'type', coalesce(p.kind, 'text'),
        'text', CASE p.kind WHEN 'text' THEN p.b.text WHEN 'thinking' THEN p.b.thinking WHEN 'tool_use' THEN null
          WHEN 'image' THEN p.b.source.media_type
          WHEN 'tool_result' THEN array_join(transform(filter(p.parts, q -> q.kind = 'text'), q -> q.text), '\n')
          ELSE coalesce(p.raw, 'null') END,
        'tool_use_id', CASE p.kind WHEN 'tool_use' THEN p.b.id WHEN 'tool_result' THEN p.b.tool_use_id END,
        'tool_name', if(p.kind = 'tool_use', p.b.name, null),
        'input_json', if(p.kind = 'tool_use', p.b.input, null),
        'is_error', if(p.kind = 'tool_result', p.b.is_error, null),
        'parts', if(p.kind = 'tool_result', p.parts, {_NO_PARTS})))"""
    single = f"""array(named_struct('pos', 0, 'type', 'text', 'text', coalesce({bare}, 'null'),
        'tool_use_id', cast(null AS string), 'tool_name', cast(null AS string), 'input_json', cast(null AS string),
        'is_error', cast(null AS boolean), 'parts', {_NO_PARTS}))"""
    return F.expr(f"if({elements} IS NOT NULL, {blocks}, {single})")


def listed_blocks(listed: str, texts: str, assistant: str) -> Column:
    """Blocks of a content list that was read from a VARIANT; `listed` names its elements, null where one is no object.

    `texts` names the elements as JSON text, where one is needed (see `_needs_texts`). What makes a block malformed, and
    what it becomes then, is as in `normalise_content`.
    """
    inner = "try_variant_get(b.content, '$', 'array<struct<type: string, text: string>>')"
    placed = f"""transform({listed}, (b, i) -> named_struct('b', b, 'i', i, 'list', if(b.type = 'tool_result', {inner}, null),
        'input', if(b.type = 'tool_use', from_json(get({texts}, i), 'input STRING', {_OPTIONS}).input, null)))"""
    parted = f"""transform({placed}, p -> named_struct('b', p.b, 'i', p.i, 'input', p.input, 'kind', {_kind('p.b', 'p.list', 'p.input', assistant)},
        'parts', CASE WHEN p.b.type <> 'tool_result' THEN {_NO_PARTS}
          WHEN p.list IS NULL THEN array(named_struct('kind', 'text', 'text', try_variant_get(p.b.content, '$', 'string')))
          ELSE filter(transform(p.list, q -> named_struct('kind', q.type, 'text', coalesce(q.text, ''))), q -> q.kind IN ('text', 'image')) END))"""
    return F.expr(f"""transform({parted}, p -> named_struct(
        'pos', p.i, 'type', coalesce(p.kind, 'text'),
        'text', CASE p.kind WHEN 'text' THEN p.b.text WHEN 'thinking' THEN p.b.thinking WHEN 'tool_use' THEN null
          WHEN 'image' THEN p.b.source.media_type
          WHEN 'tool_result' THEN array_join(transform(filter(p.parts, q -> q.kind = 'text'), q -> q.text), '\n')
          ELSE coalesce(get({texts}, p.i), 'null') END,
        'tool_use_id', CASE p.kind WHEN 'tool_use' THEN p.b.id WHEN 'tool_result' THEN p.b.tool_use_id END,
        'tool_name', if(p.kind = 'tool_use', p.b.name, null),
        'input_json', if(p.kind = 'tool_use', p.input, null),
        'is_error', if(p.kind = 'tool_result', p.b.is_error, null),
        'parts', if(p.kind = 'tool_result', p.parts, {_NO_PARTS})))""")


def _kind(b: str, inner: str, data: str, assistant: str) -> str:
    """Type of a block; null if it is malformed or its side does not allow it."""
    return f"""CASE WHEN NOT array_contains(if({assistant}, {_names(V.ASSISTANT_BLOCK_TYPES)}, {_names(V.USER_BLOCK_TYPES)}), {b}.type) THEN null
        WHEN {b}.type = 'text' AND {b}.text IS NOT NULL THEN 'text'
        WHEN {b}.type = 'thinking' AND {b}.thinking IS NOT NULL THEN 'thinking'
        WHEN {b}.type = 'tool_use' AND {b}.id IS NOT NULL AND {b}.name IS NOT NULL AND startswith({data}, '{{') THEN 'tool_use'
        WHEN {b}.type = 'tool_result' AND {b}.tool_use_id IS NOT NULL AND {b}.content IS NOT NULL AND NOT is_variant_null({b}.content)
          AND ({inner} IS NULL OR forall({inner}, y -> y IS NOT NULL)) THEN 'tool_result'
        WHEN {b}.type = 'image' AND {b}.source.type = 'base64' AND {b}.source.media_type IS NOT NULL THEN 'image' END"""


def _needs_texts(listed: str, assistant: str) -> Column:
    """Whether a block of a content list is shown as it was written: an input of a tool call, or a malformed block."""
    inner = "try_variant_get(b.content, '$', 'array<struct<type: string>>')"
    return F.expr(f"""exists({listed}, b -> coalesce(b.type = 'tool_use', true) OR {_kind('b', f"if(b.type = 'tool_result', {inner}, null)", "''", assistant)} IS NULL)""")


def _line_variant() -> Column:
    """The line as a VARIANT; null if it is no single JSON value, or one that a VARIANT cannot hold (16 MB)."""
    pair = f"try_parse_json(concat('[', value, ',{_END}]'))"
    whole = f"try_variant_get(w, '$[1]', 'bigint') = {_END} AND variant_get(w, '$[2]', 'variant') IS NULL"
    return F.expr(f"element_at(transform(array({pair}), w -> if({whole}, variant_get(w, '$[0]', 'variant'), null)), 1)")


def _envelope() -> Column:
    """The fields of a line, read from its VARIANT at once. A line without one is parsed as text, by the same rules,
    and its content stays text."""

    def struct(pairs: list[tuple[str, str]]) -> str:
        return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in pairs) + ")"

    none = ("content", "cast(null AS variant)")
    message = struct([(c, f"f.message.{c}") for c in _MESSAGE] + [none, ("usage", "f.message.usage")])
    slow = struct([(c, f"f.{c}") for c in _FIELDS] + [none, ("message", message)])
    slow = f"element_at(transform(array(from_json(value, '{_ENVELOPE}', {_STRICT_OPTIONS})), f -> {slow}), 1)"
    return F.expr(f"if(v IS NOT NULL, try_variant_get(v, '$', '{_VARIANT_ENVELOPE}'), {slow})")


def _text_content(queued: bool) -> Column:
    """Content of a line without a VARIANT, as text."""
    if queued:
        return F.from_json("value", "content STRING", _STRICT)["content"]
    return F.from_json("value", "message STRUCT<content: STRING>", _STRICT)["message"]["content"]


def _there(content: Column) -> Column:
    return content.isNotNull() & ~F.is_variant_null(content)


def _typed(lines: DataFrame) -> DataFrame:
    """Every non-blank, non-structural line with its class, or the reason it has none."""
    keep = [c for c in lines.columns if c != "value"]
    text = F.btrim("value", F.lit(V.WHITESPACE))
    # One-element explodes: conditions on the parsed fields stay above them, so the optimizer cannot
    # copy the parse into every filter, and a line is parsed once.
    parsed = lines.where(text != "").select(*keep, "value", F.explode(F.array(_line_variant())).alias("v"))
    parsed = parsed.select(*keep, "value", "v", F.explode(F.array(_envelope())).alias("e"))
    e = F.col("e")
    # Only for lines without a VARIANT. from_json forgives text after the object; as the only element of a list it must stand alone.
    alone = F.size(F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>", _STRICT))
    broken = F.col("v").isNull() & (F.coalesce(alone, F.lit(0)) != 1)
    no_object = ~F.startswith(F.ltrim("value", F.lit(V.WHITESPACE)), F.lit("{"))
    enveloped = e["uuid"].isNotNull() & e["sessionId"].isNotNull() & F.col("ts").isNotNull()
    said = F.when(F.col("v").isNotNull(), _there(e["message"]["content"])).otherwise(_text_content(False).isNotNull())
    user = enveloped & said & (e["message"]["role"] == "user")
    assistant = (
        enveloped & said & (e["message"]["role"] == "assistant") & (e["message"]["type"] == "message")
        & e["message"]["id"].isNotNull() & e["message"]["model"].isNotNull()
    )
    queued = F.col("ts").isNotNull() & e["sessionId"].isNotNull() & e["operation"].isin(V.QUEUE_OPERATIONS)
    t = e["type"]
    wanted = (
        F.when(t == "user", F.when(e["toolUseResult"].isNotNull(), "tool_result")
               .when(F.coalesce(e["isMeta"], F.lit(False)), "meta").otherwise("human"))
        .when(t == "assistant", "assistant")
        .when(t == "summary", "summary")
        .when(t == "system", "system")
        .when(t == "queue-operation", "queue_operation")
        .when(t == "progress", "progress")
        .when(t == "file-history-snapshot", "file_snapshot")
    )
    valid = (
        F.when(t == "user", user)
        .when(t == "assistant", assistant)
        .when(t == "summary", e["summary"].isNotNull() & e["leafUuid"].isNotNull())
        .when(t == "system", enveloped)
        .when(t == "queue-operation", queued)
        .otherwise(F.lit(True))
    )
    reason = (
        F.when(broken, "malformed")
        .when(wanted.isNull(), "unknown_type")
        .when(~F.coalesce(valid, F.lit(False)), "invalid")
    )
    return (
        parsed.withColumn("ts", e["timestamp"].try_cast("timestamp"))
        .withColumn("entry_type", wanted)
        .withColumn("reason", reason)
        .where(~(no_object & F.coalesce(F.col("reason") != "malformed", F.lit(True))))
        .where(~F.coalesce(t.isin(V.STRUCTURAL_TYPES), F.lit(False)) | (F.col("reason") == "malformed"))
    )


def rejects(lines: DataFrame) -> DataFrame:
    """Count of skipped lines per file and reason."""
    return (
        _typed(lines).where(F.col("reason").isNotNull())
        .groupBy("file_path", "reason").agg(F.count(F.lit(1)).alias("n"))
    )


def entries(lines: DataFrame) -> DataFrame:
    """Typed entries of `lines`; extra columns of `lines` (project, mtime…) ride along.

    session_id and agent_id come from the path unless `lines` already carries them.
    """
    typed = _typed(lines).where(F.col("reason").isNull())
    keep = [c for c in lines.columns if c not in ("value",)]
    e, m = F.col("e"), F.col("e")["message"]
    queued = F.col("entry_type") == "queue_operation"
    talk = F.col("entry_type").isin("human", "meta", "tool_result", "assistant")
    usage = m["usage"]
    zero = lambda c: F.coalesce(c, F.lit(0))
    from_path = {k: v for k, v in path_columns(F.col("file_path")).items() if k not in keep}
    quick = F.col("v").isNotNull()
    content = F.when(queued, e["content"]).when(talk, m["content"])
    typed = typed.withColumns({"_content": content, "_assistant": F.col("entry_type") == "assistant"})
    typed = typed.withColumns({
        "_list": F.try_variant_get("_content", "$", f"array<{_VARIANT_BLOCK}>"),
        "_bare": F.when(~quick, F.when(queued, _text_content(True)).when(talk, _text_content(False))),
    })
    # Elements as text are read where a list is shown as it was written, and from lines without a VARIANT.
    wanted = F.when(quick, F.coalesce(_needs_texts("_list", "_assistant"), F.lit(False))).otherwise(F.startswith("_bare", F.lit("[")))
    texts = F.when(queued, F.from_json("value", "content ARRAY<STRING>", _JSON)["content"]).otherwise(
        F.from_json("value", "message STRUCT<content: ARRAY<STRING>>", _JSON)["message"]["content"])
    typed = typed.withColumns({
        "_elements": F.when(wanted, texts),
        "_bare": F.when(quick & F.col("_list").isNull(), F.try_variant_get("_content", "$", "string")).otherwise(F.col("_bare")),
    })
    has_blocks = talk | (queued & (F.col("_list").isNotNull() | F.col("_bare").isNotNull()))
    blocks = F.when(has_blocks, F.when(F.col("_list").isNotNull(), listed_blocks("_list", "_elements", "_assistant")).otherwise(
        normalise_content("_elements", "_bare", "_assistant")))
    return typed.select(
        *keep,
        *[v.alias(k) for k, v in from_path.items()],
        "entry_type",
        e["uuid"].alias("uuid"),
        e["parentUuid"].alias("parent_uuid"),
        "ts",
        e["timestamp"].alias("ts_text"),
        F.coalesce(e["cwd"], F.lit("")).alias("cwd"),
        e["gitBranch"].alias("git_branch"),
        F.coalesce(e["version"], F.lit("")).alias("version"),
        e["entrypoint"].alias("entrypoint"),
        e["teamName"].alias("team_name"),
        e["agentName"].alias("agent_name"),
        F.coalesce(e["isSidechain"], F.lit(False)).alias("is_sidechain"),
        F.coalesce(e["isMeta"], F.lit(False)).alias("is_meta"),
        e["requestId"].alias("request_id"),
        m["model"].alias("model"),
        m["stop_reason"].alias("stop_reason"),
        F.when(
            usage.isNotNull(),
            F.struct(
                zero(usage["input_tokens"]).alias("input"),
                zero(usage["cache_creation_input_tokens"]).alias("cache_creation"),
                zero(usage["cache_read_input_tokens"]).alias("cache_read"),
                zero(usage["output_tokens"]).alias("output"),
            ),
        ).alias("usage"),
        e["subtype"].alias("subtype"),
        e["durationMs"].alias("duration_ms"),
        e["summary"].alias("summary"),
        e["toolUseResult"].alias("tool_use_result_json"),
        blocks.alias("blocks"),
    )


# --- A6: sidecars -------------------------------------------------------------------------------------


def scan_agent_meta(spark: SparkSession, path: str) -> DataFrame:
    """agent-<id>.meta.json sidecars; an unreadable one gives empty fields."""
    meta = F.from_json("value", "agentType STRING, description STRING, toolUseId STRING")
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.meta.json")
        .option("wholetext", "true").text(path)
        .select(F.col("_metadata.file_path").alias("meta_path"), meta.alias("m"))
        .select(
            F.regexp_replace("meta_path", "\\.meta\\.json$", ".jsonl").alias("file_path"),
            F.coalesce("m.agentType", F.lit("")).alias("agent_type"),
            F.coalesce("m.description", F.lit("")).alias("description"),
            F.coalesce("m.toolUseId", F.lit("")).alias("tool_use_id"),
        )
    )


# --- A7, C12: copies ------------------------------------------------------------------------------------


def provenance(lines: DataFrame) -> DataFrame:
    """One row per copied transcript: the first valid provenance line in its head."""
    p = F.from_json("value", """type STRING, sessionId STRING, agentId STRING,
        x_converter STRUCT<tool: STRING, v: INT, `from`: STRUCT<kind: STRING, id: STRING, project: STRING>,
        converted_at: STRING, lines_at_creation: BIGINT, rewound_to: STRING, rewound_at: STRING>""")
    head = lines.where(
        (F.col("line_no") < V.PROVENANCE_HEAD_LINES)
        & F.contains("value", F.lit(f'"{V.PROVENANCE_TYPE}"'))
    ).select("file_path", "line_no", p.alias("p"))
    x = F.col("p.x_converter")
    found = head.where(
        (F.col("p.type") == V.PROVENANCE_TYPE) & x["from"].isNotNull() & x["lines_at_creation"].isNotNull()
    ).select(
        "file_path",
        "line_no",
        x["from"]["kind"].alias("source_kind"),
        x["from"]["id"].alias("source_id"),
        x["from"]["project"].alias("source_project"),
        x["converted_at"].alias("converted_at"),
        x["lines_at_creation"].alias("lines_at_creation"),
        x["rewound_to"].alias("rewound_to"),
        x["rewound_at"].alias("rewound_at"),
    )
    rest = [c for c in found.columns if c not in ("file_path", "line_no")]
    # At most eight head lines per file, so the aggregate is small by construction.
    return found.groupBy("file_path").agg(
        F.min_by(F.struct(*rest), "line_no").alias("p")
    ).select("file_path", "p.*")


def without_copies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    return matching(rows, copies, ["file_path"], anti=True)


# --- the transcripts dimension ----------------------------------------------------------------------------


def transcripts(lines: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """One row per file: ids from the path, size, last write, whether it is a copy."""
    files = lines.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("file_mtime").alias("file_mtime")
    )
    out = files.select("*", *[v.alias(k) for k, v in path_columns(F.col("file_path")).items()])
    if copies is None:
        return out.withColumn("is_artifact", F.lit(False))
    flag = copies.select("file_path", F.lit(True).alias("is_artifact"))
    return out.join(flag, "file_path", "left").withColumn(
        "is_artifact", F.coalesce("is_artifact", F.lit(False))
    )


def paths_containing(spark: SparkSession, path: str | list[str], pattern: str, modified_since: datetime | None = None, suffix: str = "jsonl") -> list[str]:
    """Paths of the files below `path` with a raw line that matches an authored literal.

    Read as text only: no numbers, no parse. The answer is part of the list of files that the reader keeps in the driver.
    A second read that is given these paths opens no other file.
    """
    found = _reader(spark, modified_since, suffix).text(path).where(F.rlike("value", F.lit(pattern))).select(F.col("_metadata.file_path").alias("p")).distinct()
    return sorted(r["p"] for r in found.collect())


def files_containing(lines: DataFrame, pattern: str) -> DataFrame:
    """Files with a raw line that matches an authored literal; may over-select, never drops."""
    return lines.where(F.rlike("value", F.lit(pattern))).select("file_path").distinct()
