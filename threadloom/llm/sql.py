"""SQL twins, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from threadloom.llm import mixing, sharding

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
kept AS (SELECT doc_id, string_agg(ws[p], ' ' ORDER BY p) AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)"""

OP8 = f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {mixing.HASH_BITS // 4}) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
r AS (SELECT *, {mixing.MAX_EPOCHS} * source_size AS cap, {mixing.MAX_EPOCHS} * source_size / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * (SELECT first(level ORDER BY ratio, level) FROM l WHERE ratio >= level), cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
  sum(size) OVER (PARTITION BY d.source, place) AS here FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR (upto - here <= rest AND upto - rest < rest - (upto - here))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) m USING (doc_id)"""


OP12 = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
m AS (SELECT part, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic,
  (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM d),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS mine, length(translate(fails, earlier, '')) < length(fails) AS gone FROM c, s),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, CAST(coalesce(sum(n) FILTER (NOT mine AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mine AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (mine AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (mine AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mine AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


def _leaf(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


#: CRC-32 of the decimal doc_id, bit by bit: a byte is xored in, then eight shifts follow.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda k: CAST(-1 AS BIGINT)))))),
  lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295)"""


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels above `leaves` (tree, idx, h), and their runs, as two common table expressions."""
    return f"""{name}(tree, lvl, idx, h) AS (SELECT tree, 0, idx, h FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, max(idx) OVER (PARTITION BY tree, lvl) AS last FROM {name}) WHERE last > 0 GROUP BY tree, lvl, idx // 8),
{name}_runs AS (SELECT tree, lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM (SELECT *, max(idx) OVER (PARTITION BY tree, lvl) AS last FROM {name}) WHERE last > 0 GROUP BY ALL),
{name}_roots AS (SELECT tree, h FROM (SELECT *, max(idx) OVER (PARTITION BY tree, lvl) AS last FROM {name}) WHERE last = 0)"""


def _climb(name: str, tree: str, start: str) -> str:
    """Fold `start` (doc_id, tree, idx, f, proof) up its tree: (doc_id, lvl, f, proof) of every level."""
    step = "array_to_string(hs[1:idx % 8], '')", "array_to_string(hs[idx % 8 + 2:], '')"
    return f"""{name}(doc_id, tree, lvl, idx, f, proof) AS (SELECT doc_id, tree, 0, idx, f, proof FROM {start}
  UNION ALL SELECT c.doc_id, c.tree, c.lvl + 1, c.idx // 8, sha256({step[0]} || f || {step[1]}), proof || {step[0]} || {step[1]}
  FROM {name} c JOIN {tree}_runs r ON r.tree = c.tree AND r.lvl = c.lvl AND r.run = c.idx // 8)"""


OP11 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(':' || lang, '-') AS tree, {_leaf('text')} AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM documents),
l AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
{_tree('low', 'l')},
t AS (SELECT 'top' AS tree, tree AS part, h, row_number() OVER (ORDER BY tree) - 1 AS idx FROM low_roots),
{_tree('top', 't')},
s AS (SELECT doc_id, tree, idx, coalesce(other, leaf) AS f, '' AS proof FROM l),
{_climb('up', 'low', 's')},
m AS (SELECT doc_id, 'top' AS tree, t.idx, f, proof FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1) u JOIN t ON t.part = u.tree),
{_climb('fin', 'top', 'm')}
SELECT l.doc_id, leaf, r.h AS subroot, x.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = x.h AS verified
FROM l JOIN low_roots r ON r.tree = l.tree CROSS JOIN top_roots x
JOIN (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1) z ON z.doc_id = l.doc_id"""


def op6(shards: list[str], slots: int = sharding.SLOTS) -> str:
    """The lookup table is given: it depends on the shards' names alone."""
    owners = ",".join(map(str, sharding.fill(shards, slots)))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""WITH t AS (SELECT unnest(string_split('{owners}', ',')) AS k, generate_subscripts(string_split('{owners}', ','), 1) - 1 AS slot),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot FROM documents)
SELECT doc_id, d.slot, ([{names}])[1 + CAST(k AS INTEGER)] AS shard FROM d JOIN t ON d.slot = t.slot"""
