"""Key/value chat stores: counters, prompts, generations, headers and whole conversations.

Input is a table kv(source_db, table_name, key, value) exported from many stores. A store may keep
a whole list under one key; lists are exploded in the scan and never gathered again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.fence import fenced, let
from threadloom.functions.ids import keys_under, successor
from threadloom.functions.text import snippet
from threadloom.operators.ordered import first_rows, lookup

_TOTAL = "TOTAL"


def named(kv: DataFrame, key: str, prefix: bool = False) -> DataFrame:
    test = F.startswith("key", F.lit(key)) if prefix else F.col("key") == key
    return kv.where(test)


def _rate(accepted: Column, suggested: Column) -> Column:
    return F.try_divide(accepted, suggested)


def acceptance_text(rate: Column) -> Column:
    return F.when(rate.isNull(), "-").otherwise(F.concat(F.bround(rate * 100).cast("int").cast("string"), F.lit("%")))


def daily_stats(kv: DataFrame) -> DataFrame:
    """Suggested and accepted lines per day with their rates, and one TOTAL row."""
    s = F.from_json("value", """date STRING, tabSuggestedLines BIGINT, tabAcceptedLines BIGINT,
        composerSuggestedLines BIGINT, composerAcceptedLines BIGINT""")
    rows = named(kv, V.DAILY_STATS_KEY, prefix=True).select(s.alias("s")).where(F.col("s").isNotNull())
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    sums = rows.withColumn("date", F.coalesce("s.date", F.lit("?"))).rollup("date").agg(
        zero("s.tabSuggestedLines").alias("tab_suggested"), zero("s.tabAcceptedLines").alias("tab_accepted"),
        zero("s.composerSuggestedLines").alias("composer_suggested"),
        zero("s.composerAcceptedLines").alias("composer_accepted"),
        F.grouping("date").alias("_total"),
    )
    return sums.withColumns({
        "date": F.when(F.col("_total") == 1, F.lit(_TOTAL)).otherwise(F.col("date")),
        "tab_rate": _rate(F.col("tab_accepted"), F.col("tab_suggested")),
        "composer_rate": _rate(F.col("composer_accepted"), F.col("composer_suggested")),
    }).where(
        (F.col("_total") == 1)
        | (F.col("tab_suggested") + F.col("tab_accepted") + F.col("composer_suggested") + F.col("composer_accepted") > 0)
    ).drop("_total")


def daily_summary(stats: DataFrame) -> DataFrame:
    days = stats.where(F.col("date") != _TOTAL)
    active = F.col("tab_suggested") + F.col("composer_suggested") > 0
    return days.agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(active).alias("active_days"),
        F.sum(F.col("tab_suggested") + F.col("composer_suggested")).alias("suggested"),
        F.sum(F.col("tab_accepted") + F.col("composer_accepted")).alias("accepted"),
    )


# --- prompts --------------------------------------------------------------------------------------------


def prompts(kv: DataFrame) -> DataFrame:
    """source, pos, text and command type of every prompt in every store."""
    items = F.from_json("value", "ARRAY<STRUCT<text: STRING, commandType: INT>>")
    return named(kv, V.PROMPTS_KEY).select(
        F.col("source_db").alias("source"), F.posexplode(items).alias("pos", "p")
    ).select("source", "pos", F.coalesce("p.text", F.lit("")).alias("text"), F.col("p.commandType").alias("command_type"))


def prompt_categories(text: Column) -> Column:
    """All behaviour categories of a prompt; patterns are tried on the lower-cased text.

    A pattern walks every word of a text, so it is tried only on texts with one of the literals that all its matches hold.
    """
    def tried(lowered: Column, pattern: str) -> Column:
        there = reduce(Column.__or__, [F.contains(lowered, F.lit(t)) for t in V.PROMPT_LITERALS[pattern]])
        return there & F.rlike(lowered, F.lit("(?Ud)" + pattern))

    def found(lowered: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(reduce(Column.__or__, [tried(lowered, p) for p in patterns]), F.lit(name))
            for name, patterns in V.PROMPT_CATEGORIES.items() if patterns
        ]))

    return let(F.lower(text), found)


def classified(rows: DataFrame, min_length: int = V.PROMPT_MIN_CHARS) -> DataFrame:
    long = rows.where(F.length("text") >= min_length)
    return fenced(long, prompt_categories(F.col("text")).alias("categories")).withColumn(
        "category", F.explode("categories")
    )


def category_counts(rows: DataFrame, min_length: int = V.PROMPT_MIN_CHARS) -> DataFrame:
    return classified(rows, min_length).groupBy("category").agg(F.count(F.lit(1)).alias("prompts"))


def category_examples(rows: DataFrame, min_length: int = V.PROMPT_MIN_CHARS, k: int = V.PROMPT_EXAMPLES) -> DataFrame:
    """The first prompts of each category, cut to 400 characters."""
    cut = classified(rows, min_length).select(
        "category", "source", "pos", "categories", F.length("text").alias("full_length"),
        F.substring("text", 1, V.PROMPT_EXAMPLE_CHARS).alias("text"),
    )
    return first_rows(cut, ["category"], ["source", "pos"], k, "example_no")


def search_terms(rows: DataFrame, terms: list[str], min_length: int = V.PROMPT_MIN_CHARS) -> DataFrame:
    """Prompts that contain any of the terms, with the terms found and where they were typed."""
    lowered = F.lower("text")
    found = F.array_compact(F.array(*[
        F.when(F.contains(lowered, F.lit(t.strip().lower())), F.lit(t.strip().lower())) for t in terms
    ]))
    return rows.where(F.length("text") >= min_length).withColumn("matched", found).where(F.size("matched") > 0).withColumn(
        "typed_in", F.when(F.col("command_type") == 4, "composer").otherwise("cmd-k")
    )


def search_snippets(rows: DataFrame, term: str) -> DataFrame:
    return rows.withColumn("snippet", snippet(F.col("text"), term)).where(F.col("snippet").isNotNull())


def search_totals(rows: DataFrame, term: str) -> DataFrame:
    hit = F.contains(F.lower("text"), F.lit(term.lower()))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("prompts"), F.count_if(hit).alias("hits"))


# --- generations -----------------------------------------------------------------------------------------


def generations(kv: DataFrame) -> DataFrame:
    """One row per generation with its raw JSON; which fields exist varies by store."""
    return named(kv, V.GENERATIONS_KEY).select(
        F.col("source_db").alias("source"), F.explode(F.from_json("value", "ARRAY<STRING>")).alias("g")
    )


def generation_time(rows: DataFrame) -> Column:
    return F.timestamp_millis(F.get_json_object("g", "$.unixMs").cast("bigint"))


def model_usage(rows: DataFrame) -> DataFrame:
    """Counts by (section, value): fields present, model fields, types, months, weekdays, sources.

    One pass: each generation lists its (section, value) pairs, which are counted together.
    """
    at = F.when(F.coalesce(F.get_json_object("g", "$.unixMs").cast("bigint"), F.lit(0)) != 0, generation_time(rows))
    pair = lambda s, v: F.struct(F.lit(s).alias("section"), v.alias("value"))
    keys = F.filter(F.json_object_keys("g"), lambda k: ~F.startswith(k, F.lit("_")))
    fields = F.transform(keys, lambda k: pair("field", k))
    models = [
        F.when(F.coalesce(F.get_json_object("g", f"$.{m}"), F.lit("")) != "", pair(m, F.get_json_object("g", f"$.{m}")))
        for m in V.MODEL_FIELDS
    ]
    fixed = F.array_compact(F.array(
        *models,
        pair("type", F.coalesce(F.get_json_object("g", "$.type"), F.lit("unknown"))),
        F.when(at.isNotNull(), pair("month", F.date_format(at, "yyyy-MM"))),
        F.when(at.isNotNull(), pair("weekday", F.date_format(at, "EEEE"))),
        pair("source", F.col("source")),
    ))
    return rows.select(F.explode(F.concat(fields, fixed)).alias("p")).groupBy(
        F.col("p.section").alias("section"), F.col("p.value").alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))


def usage_span(rows: DataFrame) -> DataFrame:
    at = generation_time(rows)
    return rows.agg(
        F.date_format(F.min(at), "yyyy-MM-dd HH:mm").alias("first_generation"),
        F.date_format(F.max(at), "yyyy-MM-dd HH:mm").alias("last_generation"),
        F.floor((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 86_400_000_000).alias("span_days"),
    )


# --- conversations --------------------------------------------------------------------------------------


def headers(kv: DataFrame) -> DataFrame:
    h = F.from_json("value", """allComposers ARRAY<STRUCT<composerId: STRING, name: STRING, createdAt: BIGINT,
        lastUpdatedAt: BIGINT, totalLinesAdded: BIGINT, totalLinesRemoved: BIGINT, filesChangedCount: BIGINT,
        contextUsagePercent: DOUBLE, unifiedMode: STRING>>""")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return named(kv, V.HEADERS_KEY).select(
        F.col("source_db").alias("source"), F.explode(h["allComposers"]).alias("h")
    ).select(
        "source", F.col("h.composerId").alias("conversation_id"), F.coalesce("h.name", F.lit("unnamed")).alias("name"),
        F.when(zero("h.createdAt") == 0, "unknown").otherwise(
            F.date_format(F.timestamp_millis("h.createdAt"), "yyyy-MM-dd")
        ).alias("created"),
        zero("h.totalLinesAdded").alias("lines_added"), zero("h.totalLinesRemoved").alias("lines_removed"),
        zero("h.filesChangedCount").alias("files"), zero("h.contextUsagePercent").alias("context_pct"),
        F.coalesce("h.unifiedMode", F.lit("?")).alias("mode"),
    )


def triage_headers(rows: DataFrame, k: int = V.TRIAGE_ROWS) -> DataFrame:
    """The conversations that changed most lines."""
    return rows.orderBy(F.desc(F.col("lines_added") + F.col("lines_removed")), "source", "conversation_id").limit(k)


def conversation_turns(kv: DataFrame, typed: list[str] | None = None) -> DataFrame:
    """Turns of the stored conversations that typed ids or prefixes name (of all when there are none typed); a turn without
    text takes its bubble's.

    A bubble is one row of the store, so the join is one-to-one on its full key. Both kinds of keys hold the conversation's
    id, so ids become ranges of keys that reach the scan.
    """
    stored, inner = named(kv, V.CONVERSATION_KEY, prefix=True), named(kv, V.BUBBLE_KEY, prefix=True)
    if typed is not None:
        stored, inner = stored.where(keys_under(F.col("key"), V.CONVERSATION_KEY, typed)), inner.where(_bubbles_under(typed))
    c = F.from_json("value", """composerId STRING, name STRING,
        conversation ARRAY<STRUCT<type: INT, bubbleId: STRING, text: STRING>>""")
    whole = stored.select(
        F.substring_index("key", ":", -1).alias("conversation_id"), c.alias("c")
    ).select("conversation_id", F.posexplode("c.conversation").alias("turn", "t"))
    rows = whole.select(
        "conversation_id", "turn",
        F.when(F.col("t.type") == 1, "USER").when(F.col("t.type") == 2, "ASSISTANT").otherwise(
            F.concat(F.lit("TYPE_"), F.coalesce(F.col("t.type").cast("string"), F.lit("?")))
        ).alias("role"),
        F.coalesce("t.bubbleId", F.lit("")).alias("bubble_id"), F.coalesce("t.text", F.lit("")).alias("text"),
    )
    b = F.from_json("value", "text STRING, content STRING, message STRING")
    bubbles = inner.select(
        "key", F.coalesce(b["text"], b["content"], b["message"]).alias("bubble_text")
    ).groupBy("key").agg(F.min("bubble_text").alias("bubble_text"))
    bare = F.col("text") == ""
    keyed = rows.where(bare).withColumn("key", F.concat_ws(":", F.lit(V.BUBBLE_KEY[:-1]), "conversation_id", "bubble_id"))
    filled = lookup(keyed, bubbles, ["key"]).withColumn("text", F.coalesce("bubble_text", F.lit(""))).drop("key", "bubble_text")
    return rows.where(~bare).unionByName(filled)


def _bubbles_under(typed: list[str]) -> Column:
    """A bubble's key goes on after the id, so an id that is shorter than a typed one is followed by a colon."""
    shorter = [V.BUBBLE_KEY + one[:k] + ":" for one in typed for k in range(1, min(len(one), V.FULL_ID))]
    found = keys_under(F.col("key"), V.BUBBLE_KEY, [one for one in typed if one])
    for lead in sorted(set(shorter)):
        found = found | ((F.col("key") >= lead) & (F.col("key") < successor(lead)))
    return found


def cut_middle(text: Column) -> Column:
    """Long text keeps its first 1000 and last 500 characters around a note."""
    note = F.concat(F.lit("\n\n[...truncated, "), F.length(text).cast("string"), F.lit(" chars total...]\n\n"))
    return F.when(
        F.length(text) > V.TURN_TEXT_MAX,
        F.concat(F.substring(text, 1, V.TURN_TEXT_HEAD), note, F.right(text, F.lit(V.TURN_TEXT_TAIL))),
    ).otherwise(text)


def pull_conversations(kv: DataFrame, typed: list[str] | None = None) -> DataFrame:
    """Readable turns of the conversations that are typed in full or by prefix (all when none are); a typed id that is
    longer than a stored one names that, too."""
    rows = conversation_turns(kv, typed)
    return rows.withColumn("full_length", F.length("text")).withColumn("text", cut_middle(F.col("text")))
