"""Registered queries over key/value stores, and over raw texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.functions.tools import canonical_server, tool_server, tool_short_name
from threadloom.operators import kvmine
from threadloom.plans import sql
from threadloom.session import cut_lineage
from threadloom.sources import projects, tables

TERMS = ["the", "und", "est"]
TERM = "tion"


def daily_stats(spark, d):
    out = kvmine.daily_stats(tables.kv(spark, d, "daily"))
    return out.withColumns({"tab_rate": F.round("tab_rate", 6), "composer_rate": F.round("composer_rate", 6)})


def daily_summary(spark, d):
    return kvmine.daily_summary(kvmine.daily_stats(tables.kv(spark, d, "daily")))


def prompt_categories(spark, d):
    return kvmine.category_counts(kvmine.prompts(tables.kv(spark, d, "prompts")))


def document_categories(spark, d):
    return kvmine.category_counts(tables.document_prompts(spark, d))


def category_examples(spark, d):
    found = kvmine.category_examples(tables.document_prompts(spark, d))
    return found.select("category", "example_no", "source", "pos", "full_length", "text")


def prompt_search(spark, d):
    found = kvmine.search_terms(kvmine.prompts(tables.kv(spark, d, "prompts")), TERMS)
    return found.select("source", F.md5("text").alias("text"), F.array_join("matched", ",").alias("matched"), "typed_in")


def prompt_snippets(spark, d):
    return kvmine.search_snippets(kvmine.prompts(tables.kv(spark, d, "prompts")), TERM).select("source", "snippet")


def prompt_totals(spark, d):
    return kvmine.search_totals(kvmine.prompts(tables.kv(spark, d, "prompts")), TERM)


def model_usage(spark, d):
    return kvmine.model_usage(kvmine.generations(tables.kv(spark, d, "generations")))


def usage_span(spark, d):
    return kvmine.usage_span(kvmine.generations(tables.kv(spark, d, "generations")))


def conversation_triage(spark, d):
    return kvmine.triage_headers(kvmine.headers(tables.kv(spark, d, "headers")))


def conversation_pull(spark, d):
    kv = cut_lineage(tables.kv(spark, d, "conversations"))
    return kvmine.pull_conversations(kv).select("conversation_id", "role", "bubble_id", "full_length", F.md5("text").alias("text"))


#: A full id, a prefix of several, one longer than any stored id, and one that names nothing.
PULLED = ["00010003" + tables.SESSION_TAIL, "0002000", "00030001" + tables.SESSION_TAIL + "-copy", "ffffffff"]


def conversation_pull_ids(spark, d):
    kv = cut_lineage(tables.kv(spark, d, "conversations").sortWithinPartitions("key"))
    return kvmine.pull_conversations(kv, PULLED).select("conversation_id", "role", "bubble_id", "full_length", F.md5("text").alias("text"))


def strip_xml(spark, d):
    p = tables.table(spark, d, "pages")
    return p.select("page_id", F.md5(X.strip_system_xml(F.col("html"))).alias("stripped"))


def collapse_text(spark, d):
    t = F.col("text")
    return tables.table(spark, d, "documents").select(
        "doc_id", X.collapse_ws(t, 160).alias("head"), F.md5(X.collapse(t)).alias("whole"), X.looks_like_no_match(t).alias("no_match"),
        X.first_line(t).alias("first_line"),
    )


def truncated_text(spark, d):
    """First lines of conversations' turns cut at words."""
    return tables.table(spark, d, "conversations").select("conv_id", "turn", X.smart_truncate(F.col("text"), 60).alias("cut"))


def match_examples(spark, d):
    rows = tables.table(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("t"))
    rows = rows.withColumn("ms", X.match_start(F.col("t"), X.user_regex(TERM)))
    return X.with_excerpt(rows, "t", "ms", V.EXAMPLE_WIDTH, "excerpt").select("doc_id", "excerpt")


def tool_names(spark, d):
    """Part names as tool names, in both spellings of a server."""
    kind, key = F.col("p_brand"), F.col("p_partkey")
    server = F.when(key % 2 == 0, F.translate(kind, "# ", "--")).otherwise(F.translate(kind, "# ", "__"))
    name = F.when(key % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("mcp__"), F.translate(server, "_", "-"), F.lit("__"), F.col("p_name")))
    rows = tables.table(spark, d, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", tool_server(F.col("name")).alias("server"), tool_short_name(F.col("name")).alias("short_name"),
                       canonical_server(tool_server(F.col("name"))).alias("server_key"))


def worktree_roots(spark, d):
    """Page addresses as working folders, some below a worktree marker."""
    n = F.col("page_id")
    cwd = F.when(n % 3 == 0, F.concat("url", F.lit("/.claude/worktrees/w"), n)).when(n % 3 == 1, F.concat("url", F.lit("/.claude-worktrees/w"), n)).otherwise(F.col("url"))
    rows = tables.table(spark, d, "pages").select("page_id", "url", cwd.alias("cwd"))
    return rows.select("page_id", F.coalesce(projects.fold_worktree_path(F.col("cwd")), F.col("cwd")).alias("root"))


QUERIES = {
    "daily_stats": daily_stats,
    "daily_summary": daily_summary,
    "prompt_categories": prompt_categories,
    "document_categories": document_categories,
    "category_examples": category_examples,
    "prompt_search": prompt_search,
    "prompt_snippets": prompt_snippets,
    "prompt_totals": prompt_totals,
    "model_usage": model_usage,
    "usage_span": usage_span,
    "conversation_triage": conversation_triage,
    "conversation_pull": conversation_pull,
    "conversation_pull_ids": conversation_pull_ids,
    "strip_xml": strip_xml,
    "collapse_text": collapse_text,
    "truncated_text": truncated_text,
    "match_examples": match_examples,
    "tool_names": tool_names,
    "worktree_roots": worktree_roots,
}

# --- the same in SQL -----------------------------------------------------------------------------------------


def _matches(text: str, patterns: list[str]) -> str:
    return f"regexp_matches(lower({text}), {sql.quote('|'.join(f'(?:{p})' for p in patterns))})"


_CATS = "list_filter(list_value(" + ", ".join(
    f"CASE WHEN {_matches('text', ps)} THEN '{name}' END" for name, ps in V.PROMPT_CATEGORIES.items() if ps
) + "), lambda x: x IS NOT NULL)"
_OPEN = "list_value(" + ", ".join(sql.quote(o) for o in tables.OPENINGS) + ")"
_PROMPTS = f"""WITH p AS (SELECT 'store-' || (conv_id % 20) AS source, turn, {_OPEN}[1 + (conv_id + turn) % {len(tables.OPENINGS)}] || ' ' || text AS text
 FROM conversations WHERE role = 'user')"""
_DOCS = f"WITH p AS (SELECT source, doc_id AS pos, {_OPEN}[1 + doc_id % {len(tables.OPENINGS)}] || ' ' || text AS text FROM documents)"
_DAILY = """WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS date, event_id % 50 AS a, event_id % 20 AS b,
 CASE WHEN event_id % 3 = 0 THEN event_id % 30 ELSE 0 END AS c, CASE WHEN event_id % 3 = 0 THEN event_id % 10 ELSE 0 END AS d FROM events),
g AS (SELECT CASE WHEN grouping(date) = 1 THEN 'TOTAL' ELSE date END AS date, CAST(sum(a) AS BIGINT) AS tab_suggested, CAST(sum(b) AS BIGINT) AS tab_accepted,
 CAST(sum(c) AS BIGINT) AS composer_suggested, CAST(sum(d) AS BIGINT) AS composer_accepted FROM s GROUP BY ROLLUP (date))"""
_GEN = f"""WITH g AS (SELECT 'store-' || (conv_id % 20) AS source, make_timestamp(({tables.EPOCH} + conv_id * 86400 + turn) * 1000000) AS ts,
 CASE WHEN turn % 3 = 0 THEN 'composer' END AS type, CASE WHEN conv_id % 2 = 0 THEN 'model-' || (conv_id % 3) END AS model FROM conversations WHERE role = 'assistant')"""

ORACLES = {
    "daily_stats": f"""{_DAILY} SELECT *, round(tab_accepted / nullif(tab_suggested, 0), 6) AS tab_rate, round(composer_accepted / nullif(composer_suggested, 0), 6) AS composer_rate
 FROM g WHERE date = 'TOTAL' OR tab_suggested + tab_accepted + composer_suggested + composer_accepted > 0""",
    "daily_summary": f"""{_DAILY} SELECT min(date) AS first_date, max(date) AS last_date, count(*) FILTER (WHERE tab_suggested + composer_suggested > 0) AS active_days,
 CAST(sum(tab_suggested + composer_suggested) AS BIGINT) AS suggested, CAST(sum(tab_accepted + composer_accepted) AS BIGINT) AS accepted FROM g
 WHERE date <> 'TOTAL' AND tab_suggested + tab_accepted + composer_suggested + composer_accepted > 0""",
    "prompt_categories": f"{_PROMPTS} SELECT category, count(*) AS prompts FROM (SELECT unnest({_CATS}) AS category FROM p WHERE length(text) >= 10) GROUP BY 1",
    "document_categories": f"{_DOCS} SELECT category, count(*) AS prompts FROM (SELECT unnest({_CATS}) AS category FROM p WHERE length(text) >= 10) GROUP BY 1",
    "category_examples": f"""{_DOCS}, c AS (SELECT unnest({_CATS}) AS category, source, pos, text FROM p WHERE length(text) >= 10),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY source, pos) AS INTEGER) AS example_no FROM c)
SELECT category, example_no, source, pos, CAST(length(text) AS INTEGER) AS full_length, left(text, 400) AS text FROM r WHERE example_no <= 15""",
    "prompt_search": f"""{_PROMPTS} SELECT source, md5(text) AS text, array_to_string(list_filter(list_value({', '.join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in TERMS)}), lambda x: x IS NOT NULL), ',') AS matched,
 CASE WHEN turn % 2 = 0 THEN 'composer' ELSE 'cmd-k' END AS typed_in FROM p WHERE length(text) >= 10 AND ({' OR '.join(f"contains(lower(text), '{t}')" for t in TERMS)})""",
    "prompt_snippets": f"""{_PROMPTS}, h AS (SELECT *, strpos(lower(text), '{TERM}') - 1 AS i FROM p WHERE contains(lower(text), '{TERM}')),
b AS (SELECT *, greatest(0, i - 80) AS lo, least(length(text), i + {len(TERM)} + 80) AS hi FROM h)
SELECT source, CASE WHEN lo > 0 THEN '...' ELSE '' END || replace(substr(text, lo + 1, hi - lo), chr(10), ' ') || CASE WHEN hi < length(text) THEN '...' ELSE '' END AS snippet FROM b""",
    "prompt_totals": f"{_PROMPTS} SELECT source, count(*) AS prompts, count(*) FILTER (WHERE contains(lower(text), '{TERM}')) AS hits FROM p GROUP BY 1",
    "model_usage": f"""{_GEN} SELECT section, value, count(*) AS n FROM (
 SELECT 'field' AS section, 'unixMs' AS value FROM g UNION ALL SELECT 'field', 'text' FROM g UNION ALL SELECT 'field', 'type' FROM g WHERE type IS NOT NULL
 UNION ALL SELECT 'field', 'modelName' FROM g WHERE model IS NOT NULL UNION ALL SELECT 'modelName', model FROM g WHERE model IS NOT NULL
 UNION ALL SELECT 'type', coalesce(type, 'unknown') FROM g UNION ALL SELECT 'month', strftime(ts, '%Y-%m') FROM g
 UNION ALL SELECT 'weekday', strftime(ts, '%A') FROM g UNION ALL SELECT 'source', source FROM g) GROUP BY 1, 2""",
    "usage_span": f"""{_GEN} SELECT strftime(min(ts), '%Y-%m-%d %H:%M') AS first_generation, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_generation,
 CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span_days FROM g""",
    "conversation_triage": f"""SELECT 'store-' || (conv_id % 20) AS source, printf('%08x{tables.SESSION_TAIL}', conv_id) AS conversation_id, CASE WHEN conv_id % 4 <> 0 THEN 'talk ' || conv_id ELSE 'unnamed' END AS name,
 strftime(make_timestamp(({tables.EPOCH} + conv_id * 86400) * 1000000), '%Y-%m-%d') AS created, CAST(sum(length(text)) AS BIGINT) AS lines_added,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS lines_removed, count(*) AS files, 0.0::DOUBLE AS context_pct, CASE WHEN conv_id % 2 = 0 THEN 'agent' ELSE '?' END AS mode
 FROM conversations GROUP BY conv_id ORDER BY lines_added + lines_removed DESC, source, conversation_id LIMIT {V.TRIAGE_ROWS}""",
    "conversation_pull": f"""SELECT printf('%08x{tables.SESSION_TAIL}', conv_id * 65536 + turn) AS conversation_id, CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'ASSISTANT' ELSE 'TYPE_9' END AS role,
 'b' || turn AS bubble_id, CAST(length(text) AS INTEGER) AS full_length, md5(CASE WHEN length(text) > 2000 THEN left(text, 1000) || chr(10) || chr(10) || '[...truncated, ' || length(text) || ' chars total...]' || chr(10) || chr(10) || right(text, 500) ELSE text END) AS text FROM conversations""",
    "conversation_pull_ids": f"""WITH c AS (SELECT *, printf('%08x{tables.SESSION_TAIL}', conv_id * 65536 + turn) AS conversation_id FROM conversations),
t AS (SELECT unnest({PULLED}) AS typed)
SELECT DISTINCT conversation_id, CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'ASSISTANT' ELSE 'TYPE_9' END AS role, 'b' || turn AS bubble_id,
 CAST(length(text) AS INTEGER) AS full_length, md5(CASE WHEN length(text) > 2000 THEN left(text, 1000) || chr(10) || chr(10) || '[...truncated, ' || length(text) || ' chars total...]' || chr(10) || chr(10) || right(text, 500) ELSE text END) AS text
FROM c JOIN t ON CASE WHEN length(typed) >= {V.FULL_ID} THEN conversation_id = typed ELSE starts_with(conversation_id, typed) END""",
    "strip_xml": f"SELECT page_id, md5({sql.strip_system_xml('html')}) AS stripped FROM pages",
    "collapse_text": f"""SELECT doc_id, {sql.collapse_ws('text', 160)} AS head, md5({sql.collapse('text')}) AS whole, regexp_matches(lower(left(text, 300)), '{"|".join(V.NO_MATCH_MARKERS)}') AS no_match,
 {sql.strip("split_part(text, chr(10), 1)")} AS first_line FROM documents""",
    "truncated_text": f"SELECT conv_id, turn, {sql.truncate('text', 60)} AS cut FROM conversations",
    "match_examples": f"""WITH s AS (SELECT doc_id, {sql.collapse('text')} AS t FROM documents), m AS (SELECT *, regexp_extract(t, '{TERM}', 0, 'i') AS m FROM s),
placed AS (SELECT *, CASE WHEN m = '' THEN NULL ELSE strpos(t, m) - 1 END AS ms FROM m), {sql.excerpt_steps('placed', 'done')} SELECT doc_id, excerpt FROM done""",
    "tool_names": """WITH s AS (SELECT p_partkey, p_name, replace(CASE WHEN p_partkey % 2 = 0 THEN translate(p_brand, '# ', '--') ELSE translate(p_brand, '# ', '__') END, '_', '-') AS server FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN server END AS server, p_name AS short_name, CASE WHEN p_partkey % 3 <> 0 THEN lower(replace(server, '-', '_')) END AS server_key FROM s""",
    "worktree_roots": "SELECT page_id, url AS root FROM pages",
}
