"""Threads, copies and their lineage: views over tables, nothing is written back.

A transcript is a tree: each turn names its parent, an edit starts a sibling. Most turns name the
turn just before them, so a transcript is a few unbroken runs ("segments") joined by links. The
ancestors of a turn are the head of its own segment plus the segments reached by following links.
Links are followed by pointer doubling over segments: log2(number of links) joins on narrow rows,
however long a transcript is, and no task holds a transcript.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.ids import id_matches
from threadloom.operators.ordered import lookup, matching, previous_value, running_count
from threadloom.session import cut_lineage

_TURN = """type STRING, uuid STRING, parentUuid STRING, isSidechain BOOLEAN, timestamp STRING,
  cwd STRING, gitBranch STRING, version STRING, promptId STRING,
  _lineage ARRAY<STRUCT<`as`: STRING, id: STRING>>, _converted_from STRUCT<kind: STRING, id: STRING, project: STRING>,
  message STRING"""


def turns(lines: DataFrame) -> DataFrame:
    """User and assistant lines that carry a message object, with what the views need."""
    keep = [c for c in lines.columns if c != "value"]
    # One-element explode: the filter stays above the parse, so a line is parsed once.
    rows = lines.select(*keep, F.explode(F.array(F.from_json("value", _TURN))).alias("t")).where(
        F.col("t.type").isin(V.CONVERSATION_TYPES) & F.startswith("t.message", F.lit("{"))
    )
    rows = rows.withColumn("_m", F.from_json("t.message", "model STRING, content STRING"))
    rows = rows.withColumn("_e", F.from_json("t.message", "content ARRAY<STRING>")["content"])
    part = F.transform("_e", lambda x: F.from_json(x, "type STRING, text STRING"))
    rows = rows.withColumn("_p", part)
    listed = F.array_join(
        F.transform(F.filter("_p", lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), " "
    )
    text = F.when(F.col("_e").isNotNull(), listed).otherwise(F.coalesce("_m.content", F.lit("")))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    other = F.coalesce(F.exists("_p", lambda p: F.coalesce(p["type"], F.lit("")) != "text"), F.lit(False))
    call = F.coalesce(F.exists("_p", lambda p: p["type"] == "tool_use"), F.lit(False))
    return rows.select(
        *keep,
        F.col("t.type").alias("type"),
        blank("t.uuid").alias("uuid"), blank("t.parentUuid").alias("parent_uuid"),
        F.coalesce("t.isSidechain", F.lit(False)).alias("is_sidechain"),
        F.col("t.timestamp").alias("ts_text"), "t.cwd", F.col("t.gitBranch").alias("git_branch"), "t.version",
        F.col("_m.model").alias("model"),
        F.col("t._lineage").alias("lineage"), F.col("t._converted_from").alias("converted_from"),
        F.col("t.message").alias("message_json"),
        text.alias("text"), other.alias("has_other_block"), call.alias("has_call"),
    )


def is_trailing_noise() -> Column:
    """A user turn of text only that is empty, an interrupt or command scaffolding."""
    bare = F.btrim("text", F.lit(V.WHITESPACE))
    marked = F.lit(False)
    for marker in V.TRAILING_NOISE_MARKERS:
        marked = marked | F.contains(bare, F.lit(marker))
    return (F.col("type") == "user") & ~F.col("has_other_block") & ((bare == "") | marked)


# --- F6 to F9 ------------------------------------------------------------------------------------------


def relinearize(rows: DataFrame, order: str = "line_no", group: list[str] | None = None) -> DataFrame:
    """parent_uuid becomes the id of the turn before; null on the first."""
    return previous_value(rows.drop("parent_uuid"), group or ["file_path"], order, F.col("uuid"), "parent_uuid")


def trim_tail(rows: DataFrame, order: str = "line_no", group: list[str] | None = None, resumable: bool = False) -> DataFrame:
    """Rows up to the last one that is no noise; `resumable` also drops trailing calls."""
    keys = group or ["file_path"]
    noise = is_trailing_noise()
    if resumable:
        noise = noise | ((F.col("type") == "assistant") & F.col("has_call"))
    last = rows.groupBy(*keys).agg(F.max(F.when(~noise, F.col(order))).alias("_last"))
    return lookup(rows, last, keys).where(F.col(order) <= F.col("_last")).drop("_last")


def tail_state(rows: DataFrame, order: str = "line_no", group: list[str] | None = None) -> DataFrame:
    last = F.max_by("type", order)
    return rows.groupBy(*(group or ["file_path"])).agg(
        F.when(last == "assistant", "clean").otherwise("pending_user_input").alias("tail_state")
    )


# --- the graph --------------------------------------------------------------------------------------------


def _segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with (segment, turn number), and one link row per segment."""
    slim = cut_lineage(rows.select("file_path", "line_no", "uuid", "parent_uuid"))
    by_uuid = slim.where(F.col("uuid").isNotNull()).groupBy("file_path", F.col("uuid").alias("parent_uuid")).agg(
        F.max("line_no").alias("parent_line")
    )
    # Rows without a parent skip the join: they would all meet in one partition.
    child = lookup(slim.where(F.col("parent_uuid").isNotNull()), by_uuid, ["file_path", "parent_uuid"])
    linked = child.unionByName(slim.where(F.col("parent_uuid").isNull()), allowMissingColumns=True)
    numbered = running_count(linked, ["file_path"], "line_no", "turn_no")
    numbered = previous_value(numbered, ["file_path"], "line_no", F.col("line_no"), "_prev")
    starts = ~F.coalesce(F.col("parent_line") == F.col("_prev"), F.lit(False))
    numbered = running_count(numbered.withColumn("_start", starts), ["file_path"], "line_no", "segment", F.col("_start"))
    numbered = cut_lineage(numbered.drop("_prev"))
    heads = numbered.where("_start")
    home = numbered.select("file_path", F.col("line_no").alias("parent_line"),
                           F.col("segment").alias("to_segment"), F.col("turn_no").alias("to_turn"))
    links = heads.where(F.col("parent_line").isNotNull()).join(home, ["file_path", "parent_line"]).unionByName(
        heads.where(F.col("parent_line").isNull()), allowMissingColumns=True
    )
    state = (
        F.when(F.col("parent_uuid").isNull(), "root").when(F.col("parent_line").isNull(), "missing").otherwise("linked")
    )
    return numbered.drop("_start"), links.select(
        "file_path", "segment", F.col("turn_no").alias("first_turn"), F.col("uuid").alias("head_uuid"),
        state.alias("state"), "to_segment", "to_turn",
    )


def _reached(targets: DataFrame, links: DataFrame) -> DataFrame:
    """Segments on the way from each target to its root: where each is entered, and how far away.

    `targets` has key, file_path, segment, turn_no. `distance` is the number of turns walked before
    the segment is entered.
    """
    starts = links.select("file_path", "segment", "first_turn")
    jump = links.where(F.col("state") == "linked").select(
        "file_path", "segment", "to_segment", "to_turn", F.lit(0).cast("bigint").alias("cost")
    )
    jump = cut_lineage(jump)
    reached = targets.select("key", "file_path", "segment", F.col("turn_no").alias("entry_turn"),
                             F.lit(0).cast("bigint").alias("distance"))
    if jump.isEmpty():
        return reached
    reached = cut_lineage(reached)
    known = reached.count()
    while True:
        steps = reached.join(jump, ["file_path", "segment"]).join(starts, ["file_path", "segment"])
        steps = steps.select(
            "key", "file_path", F.col("to_segment").alias("segment"), F.col("to_turn").alias("entry_turn"),
            (F.col("distance") + F.col("entry_turn") - F.col("first_turn") + 1 + F.col("cost")).alias("distance"),
        )
        grown = reached.unionByName(steps).groupBy("key", "file_path", "segment").agg(
            F.max("entry_turn").alias("entry_turn"), F.min("distance").alias("distance")
        )
        grown = cut_lineage(grown)
        size = grown.count()
        reached = grown
        if size == known:
            return reached
        known = size
        onward = jump.select("file_path", F.col("segment").alias("to_segment"), F.col("to_segment").alias("_s2"),
                             F.col("to_turn").alias("_t2"), F.col("cost").alias("_c2"))
        via = starts.select("file_path", F.col("segment").alias("to_segment"), F.col("first_turn").alias("_f"))
        jump = cut_lineage(
            jump.join(onward, ["file_path", "to_segment"]).join(via, ["file_path", "to_segment"]).select(
                "file_path", "segment", F.col("_s2").alias("to_segment"), F.col("_t2").alias("to_turn"),
                (F.col("cost") + F.col("to_turn") - F.col("_f") + 1 + F.col("_c2")).alias("cost"),
            )
        )


def _chain(numbered: DataFrame, reached: DataFrame) -> DataFrame:
    """Turns on the way, numbered from the root (1) to the target."""
    # An unbroken transcript is one segment, so this key may be hot on the left.
    on = lookup(numbered, reached, ["file_path", "segment"]).where(F.col("turn_no") <= F.col("entry_turn"))
    away = F.col("distance") + F.col("entry_turn") - F.col("turn_no")
    on = cut_lineage(on.select("key", "file_path", "line_no", away.alias("_away")))
    far = on.groupBy("key").agg(F.max("_away").alias("_far"))
    return lookup(on, far, ["key"]).select("key", "file_path", "line_no", (F.col("_far") - F.col("_away") + 1).alias("chain_no"))


def ancestor_chain(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Root-to-target chain of each target; a gap or a cycle ends the walk.

    `targets` has key, file_path and line_no.
    """
    numbered, links = _segments(rows)
    at = numbered.join(targets, ["file_path", "line_no"]).select("key", "file_path", "segment", "turn_no")
    return _chain(numbered, _reached(at, links))


def active_thread(rows: DataFrame, drop_sidechain: bool = False) -> DataFrame:
    """The thread that ends in each transcript's last turn, in order, with the count dropped.

    Falls back to all turns in file order when a link is missing, the links form a circle, or the
    root reached is not the first turn.
    """
    candidates = rows.where(~F.col("is_sidechain")) if drop_sidechain else rows
    numbered, links = _segments(candidates)
    ends = numbered.groupBy("file_path").agg(
        F.max_by(F.struct("segment", "turn_no"), "line_no").alias("tip"),
        F.min_by("uuid", "line_no").alias("first_uuid"),
        F.count("uuid").alias("ids"),
    )
    tips = ends.where(F.col("ids") > 0).select(
        F.col("file_path").alias("key"), "file_path", "tip.segment", "tip.turn_no"
    )
    reached = _reached(tips, links)
    root = reached.join(links, ["file_path", "segment"]).join(ends.select("file_path", "first_uuid"), "file_path").where(
        (F.col("state") == "root")
        & (F.col("head_uuid").isNull() | F.coalesce(F.col("head_uuid") == F.col("first_uuid"), F.lit(False)))
    )
    whole = cut_lineage(root.select("file_path").distinct())
    chain = matching(_chain(numbered, reached).drop("key"), whole, ["file_path"])
    threaded = rows.join(chain, ["file_path", "line_no"]).withColumn("is_thread", F.lit(True))
    rest = running_count(matching(rows, whole, ["file_path"], anti=True), ["file_path"], "line_no", "chain_no")
    kept = cut_lineage(threaded.unionByName(rest.withColumn("is_thread", F.lit(False))))
    sizes = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("_all"))
    kept_sizes = kept.groupBy("file_path").agg(F.count(F.lit(1)).alias("_kept"))
    dropped = sizes.join(kept_sizes, "file_path").select("file_path", (F.col("_all") - F.col("_kept")).alias("dropped"))
    return lookup(kept, dropped, ["file_path"])


# --- views of a copy and of a rewind -----------------------------------------------------------------------


def prior_lineage(rows: DataFrame) -> DataFrame:
    """The first breadcrumb of earlier copies in each transcript."""
    return rows.where(F.col("lineage").isNotNull()).groupBy("file_path").agg(
        F.min_by("lineage", "line_no").alias("prior")
    )


def thread_copy(rows: DataFrame, requests: DataFrame, to_agent: bool) -> DataFrame:
    """What a copy of the active thread would hold, as rows; ids are given, not made.

    `requests` has file_path, source_id, source_project, new_id and parent_session.
    """
    wanted = cut_lineage(matching(rows, requests, ["file_path"]))
    prior = prior_lineage(wanted)
    thread = active_thread(wanted, drop_sidechain=to_agent)
    linear = cut_lineage(relinearize(thread, "chain_no"))
    kept = trim_tail(linear, "chain_no")
    hop = lambda kind, i: F.struct(F.lit(kind).alias("as"), F.col(i).alias("id"))
    source, target = ("session", "subagent") if to_agent else ("subagent", "session")
    empty = F.array().cast("array<struct<as:string,id:string>>")
    return lookup(lookup(kept, requests, ["file_path"]), prior, ["file_path"]).select(
        "file_path", "chain_no", "type", "uuid", "parent_uuid", "message_json", "model", "dropped", "is_thread",
        F.lit(to_agent).alias("is_sidechain"),
        (F.col("parent_session") if to_agent else F.col("new_id")).alias("session_id"),
        (F.col("new_id") if to_agent else F.lit(None).cast("string")).alias("agent_id"),
        F.struct(F.lit(source).alias("kind"), F.col("source_id").alias("id"), F.col("source_project").alias("project")).alias("converted_from"),
        F.concat(F.coalesce("prior", empty), F.array(hop(source, "source_id"), hop(target, "new_id"))).alias("lineage"),
        F.array(*[F.lit(k) for k in (V.STRIP_TO_AGENT if to_agent else V.STRIP_TO_SESSION)]).alias("stripped"),
    )


def rewind_view(rows: DataFrame, requests: DataFrame, copies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept turns of each rewind and a report of counts or the reason it cannot be done.

    `requests` has request_id, file_path, turn and cut ('after' keeps the turn, 'before' drops it).
    """
    # A turn is named by eight characters at least, so those are part of the key.
    head = lambda c: F.substring(c, 1, V.SHORT_ID)
    named = rows.withColumn("_head", head("uuid")).join(requests.withColumn("_head", head("turn")), ["file_path", "_head"]).where(
        id_matches(F.col("uuid"), F.col("turn")) & F.startswith("uuid", F.col("turn"))).drop("_head")
    found = named.groupBy("request_id").agg(
        F.count_distinct("uuid").alias("ids"), F.count(F.lit(1)).alias("hits"), F.max("line_no").alias("line_no"),
        F.max("uuid").alias("target"),
    )
    good = found.where((F.col("ids") == 1) & (F.col("hits") == 1)).join(requests, "request_id")
    chain = ancestor_chain(rows, good.select(F.col("request_id").alias("key"), "file_path", "line_no"))
    chain = chain.withColumnRenamed("key", "request_id")
    cut = good.select("request_id", "cut", F.col("line_no").alias("_target"))
    kept = chain.join(cut, "request_id").where((F.col("cut") == "after") | (F.col("line_no") != F.col("_target"))).drop("cut", "_target")
    kept = cut_lineage(kept.join(rows, ["file_path", "line_no"]))
    keys = ["request_id"]
    tail = cut_lineage(trim_tail(kept, "chain_no", keys, resumable=True))
    sized = lambda df, name: df.groupBy("request_id").agg(F.count(F.lit(1)).alias(name))
    before = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("turns_before"))
    last = tail.groupBy("request_id").agg(F.max("chain_no").alias("_end"))
    cut_off = kept.join(last, "request_id", "left").where(F.col("chain_no") > F.coalesce("_end", F.lit(0)))
    lost = cut_off.groupBy("request_id").agg(
        F.count_if(is_trailing_noise()).alias("trimmed_trailing"), F.count_if(~is_trailing_noise()).alias("trimmed_calls")
    )
    report = requests.join(found, "request_id", "left").join(before, "file_path", "left")
    for frame in (sized(kept, "_kept"), sized(tail, "turns_after"), lost, tail_state(tail, "chain_no", keys)):
        report = report.join(frame, "request_id", "left")
    gone = F.lit(False)
    if copies is not None:
        report = report.join(copies.select("file_path", "rewound_to"), "file_path", "left")
        gone = F.coalesce(F.startswith("rewound_to", F.col("turn")), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = (
        F.when(F.col("ids").isNull() & gone, "already_rewound")
        .when(F.col("ids").isNull(), "unknown_turn")
        .when(F.col("ids") > 1, "ambiguous_turn")
        .when(F.col("hits") > 1, "repeated_turn")
        .when(zero("turns_after") == 0, "nothing_left")
        .otherwise("ok")
    )
    report = report.select(
        "request_id", "file_path", "turn", "cut", status.alias("status"), "target", zero("turns_before").alias("turns_before"),
        zero("turns_after").alias("turns_after"),
        (zero("turns_before") - zero("_kept")).alias("removed_after_cut"),
        zero("trimmed_trailing").alias("trimmed_trailing"), zero("trimmed_calls").alias("trimmed_calls"), "tail_state",
    )
    return relinearize(tail, "chain_no", keys), report


# --- copies -----------------------------------------------------------------------------------------------------


def with_growth(copies: DataFrame, transcripts: DataFrame, as_of: datetime) -> DataFrame:
    """Copies with whether they grew since they were made, and their age in seconds."""
    born = F.coalesce(F.col("converted_at").try_cast("timestamp"), F.col("file_mtime"))
    return copies.join(transcripts, "file_path").withColumns({
        "grown": F.col("n_lines") > F.col("lines_at_creation"),
        "age_seconds": (F.unix_micros(F.lit(as_of)) - F.unix_micros(born)) / 1_000_000,
    })


def removal_report(resolved: DataFrame, grown: DataFrame, force: bool = False) -> DataFrame:
    """Per id from `resolve_artifacts`: deletable or the reason it is refused."""
    facts = grown.where(F.col("agent_id").isNotNull()).select(F.col("agent_id").alias("full_id"), "grown")
    rows = resolved.join(facts.groupBy("full_id").agg(F.max("grown").alias("grown")), "full_id", "left")
    kept = F.lit(False) if force else F.col("grown")
    reason = (
        F.when(F.col("status") != "unique", F.col("status"))
        .when(F.col("kind") == "session", "session")
        .when(F.col("grown").isNull(), "not_an_artifact")
        .when(kept, "grown")
    )
    return rows.select(
        "raw_id", "kind", "full_id",
        F.when(reason.isNull(), "deletable").otherwise("refused").alias("decision"), reason.alias("reason"),
    )


def stale_copies(grown: DataFrame, age_seconds: float) -> DataFrame:
    """Agent copies nobody built upon that are older than the given age."""
    return grown.where(F.col("agent_id").isNotNull() & ~F.col("grown") & (F.col("age_seconds") > age_seconds))
