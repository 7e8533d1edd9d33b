"""Building blocks of the SQL twins: the derived tables and the text functions in DuckDB's SQL."""

from __future__ import annotations

from threadloom import fixed_values as V
from threadloom.sources import tables

_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{_SPACE}+', ' ', 'g'), ' ')"


def collapse_ws(e: str, n: int) -> str:
    return f"left({collapse(f'left({e}, {n * V.COLLAPSE_SLACK})')}, {n})"


def strip_system_xml(e: str) -> str:
    for pattern in [*V.SYSTEM_XML_REMOVALS, V.TRANSCRIPT_NOTE]:
        e = f"regexp_replace({e}, {quote(pattern)}, '', 'g')"
    e = f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(e)


def truncate(e: str, n: int) -> str:
    """Word-boundary cut for texts whose words hold no hyphen within reach of the cut."""
    c = collapse(e)
    word = f"regexp_extract({c}, '^(.{{1,{n - 3}}}?.{{0,{n - 3}}}) ', 1)"
    word = f"regexp_extract(left({c}, {n - 2}), '^(.*) ', 1)"
    return (
        f"CASE WHEN length({e}) <= {n} THEN {e} WHEN length({c}) <= {n} THEN {c} "
        f"WHEN {word} <> '' THEN {word} || '...' ELSE left({e}, {n - 3}) || '...' END"
    )


def noise(e: str) -> str:
    return "(" + " OR ".join(f"contains({e}, {quote(m)})" for m in V.TRAILING_NOISE_MARKERS) + ")"


def excerpt_steps(source: str, out: str, width: int = V.EXAMPLE_WIDTH) -> str:
    """CTEs that turn `source`(t, ms) into `out`(…, excerpt)."""
    return f"""
{out}_1 AS (SELECT *, greatest(0, ms - {V.EXAMPLE_LEAD}) AS lo1, least(length(t), greatest(0, ms - {V.EXAMPLE_LEAD}) + {width}) AS hi FROM {source}),
{out}_2 AS (SELECT *, CASE WHEN hi - lo1 < {width} THEN greatest(0, hi - {width}) ELSE lo1 END AS lo2 FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN lo2 > 0 AND strpos(substr(t, lo2 + 1), ' ') > 0 AND lo2 + strpos(substr(t, lo2 + 1), ' ') - 1 < ms
  THEN lo2 + strpos(substr(t, lo2 + 1), ' ') ELSE lo2 END AS lo FROM {out}_2),
{out}_4 AS (SELECT *, substr(t, lo + 1, hi - lo) AS cut FROM {out}_3),
{out}_5 AS (SELECT *, CASE WHEN hi < length(t) AND strpos(reverse(cut), ' ') > 0 AND length(cut) > strpos(reverse(cut), ' ')
  THEN lo + length(cut) - strpos(reverse(cut), ' ') ELSE hi END AS fin FROM {out}_4),
{out} AS (SELECT * EXCLUDE (lo1, lo2, lo, hi, cut, fin), CASE WHEN ms IS NULL THEN left(t, {width}) ELSE
  CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(cut, 1, fin - lo) || CASE WHEN fin < length(t) THEN '...' ELSE '' END END AS excerpt FROM {out}_5)"""


_BASE = f"""
SELECT conv_id, turn, role, text, 'p' || (conv_id % 5) AS project,
  printf('%08x{tables.SESSION_TAIL}', conv_id) AS session_id,
  printf('%08x{tables.TURN_TAIL}', conv_id * 65536 + turn) AS uuid,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS entry_type,
  {tables.EPOCH} + conv_id * 3600 + turn * 37 AS epoch_s,
  CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN list_value('Bash','Read','Grep','mcp__notes__lookup','Agent')[1 + (conv_id + turn) % 5] END AS tool,
  CASE WHEN role = 'assistant' THEN CAST(length(text) * 50 + (conv_id % 7) * 100 + turn * 1000 AS BIGINT) END AS tokens_in,
  CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) END AS tokens_out
FROM conversations"""

# conversations as transcripts: ids, texts, tool inputs and the full display of every turn.
CONV = f"""WITH conv AS (
SELECT *, CASE WHEN entry_type = 'human' THEN body WHEN entry_type = 'assistant' THEN
  concat_ws('  ', CASE WHEN thinking <> '' THEN '[thinking] ' || thinking END, nullif(body, ''),
    CASE WHEN tool IS NOT NULL THEN '→ ' || tool || '(' || input_json || ')' END) ELSE '[?]' END AS display
FROM (
SELECT *, CASE WHEN role <> 'system' THEN {strip_system_xml('text')} END AS body,
  CASE WHEN role = 'assistant' AND conv_id % 3 = 0 AND turn % 2 = 1 THEN {strip("'considering ' || text")} ELSE '' END AS thinking,
  CASE tool WHEN 'Bash' THEN 'Bash' || chr(10) || text || chr(10) || 'step' WHEN 'Read' THEN 'Read' || chr(10) || '/src/' || conv_id || '.py'
    WHEN 'Grep' THEN 'Grep' || chr(10) || 'the' || chr(10) || '/src' WHEN 'mcp__notes__lookup' THEN tool || chr(10) || text
    WHEN 'Agent' THEN 'Agent' || chr(10) || text || chr(10) || 'step' ELSE '' END AS tool_text,
  CASE tool WHEN 'Bash' THEN '{{"command":' || CAST(to_json(text) AS VARCHAR) || ',"description":"step"}}' WHEN 'Read' THEN '{{"file_path":"/src/' || conv_id || '.py"}}'
    WHEN 'Grep' THEN '{{"pattern":"the","path":"/src"}}' WHEN 'mcp__notes__lookup' THEN '{{"query":' || CAST(to_json(text) AS VARCHAR) || ',"limit":' || turn || '}}'
    WHEN 'Agent' THEN '{{"description":"step","subagent_type":"scout","prompt":' || CAST(to_json(text) AS VARCHAR) || '}}' END AS input_json,
  CASE tool WHEN 'Bash' THEN text WHEN 'Read' THEN '/src/' || conv_id || '.py' WHEN 'Grep' THEN '/the/ /src'
    WHEN 'mcp__notes__lookup' THEN '{{"query":' || CAST(to_json(text) AS VARCHAR) || ',"limit":' || turn || '}}'
    WHEN 'Agent' THEN '{{"description":"step","subagent_type":"scout","prompt":' || CAST(to_json(text) AS VARCHAR) || '}}' END AS telling
FROM ({_BASE})))"""

MOVES = """WITH moves AS (SELECT conv_id AS run_id, turn // 2 + 1 AS round, role,
 CASE WHEN length(text) % 3 = 0 THEN CASE WHEN role = 'user' THEN 'DISPUTE' ELSE 'UPDATE' END WHEN length(text) % 7 = 0 THEN 'WITHDRAW' ELSE 'HOLD' END AS move_type
 FROM conversations)"""
