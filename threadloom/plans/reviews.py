"""Registered queries over line items read as review findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.operators import findings as FN
from threadloom.session import cut_lineage
from threadloom.sources import tables


def _findings(spark, d):
    return FN.reported(tables.returns(spark, d))


def _numbered(spark, d):
    return cut_lineage(FN.numbered(FN.staged(FN.merge(_findings(spark, d)))))


def _flat(rows):
    return rows.withColumn("reviewers", F.array_join("reviewers", ","))


def findings_rejected(spark, d):
    return FN.rejected(_findings(spark, d))


def findings_merge(spark, d):
    merged = FN.merge(_findings(spark, d))
    return _flat(merged).drop("island", "file")


def findings_stages(spark, d):
    rows = FN.staged(FN.merge(_findings(spark, d)))
    return rows.groupBy("review_id", "stage", "queue", "soft_bucket").agg(F.count(F.lit(1)).alias("n"))


def findings_numbered(spark, d):
    return _numbered(spark, d).select("review_id", "number", "severity", "confidence", "file_key", "line", "title_key", "queue")


def findings_suppressed(spark, d):
    return FN.suppressed_counts(FN.staged(FN.merge(_findings(spark, d))))


def findings_soft(spark, d):
    return FN.soft_entries(FN.staged(FN.merge(_findings(spark, d))))


def findings_budget(spark, d):
    chosen, _ = FN.validation_budget(_numbered(spark, d))
    return chosen.select("review_id", "budget_rank", "number", "severity", "confidence")


def findings_over_budget(spark, d):
    return FN.validation_budget(_numbered(spark, d))[1]


def findings_coverage(spark, d):
    return FN.coverage(FN.whole_returns(tables.returns(spark, d)))


def returns_dropped(spark, d):
    return FN.dropped_returns(tables.returns(spark, d))


def finding_verdicts(spark, d):
    rows = _numbered(spark, d)
    verdicts = rows.where(F.col("number") % 3 != 0).select(
        "review_id", "number", (F.col("number") % 2 == 0).alias("validated"), F.concat(F.lit("at line "), F.col("line").cast("string")).alias("reason")
    )
    return FN.apply_verdicts(rows, verdicts).select("review_id", "number", "survives", "drop_reason")


def finding_details(spark, d):
    given = FN.validate(_findings(spark, d))
    details = given.withColumn("detail", F.concat_ws(" ", F.lit("because"), "severity", F.col("line").cast("string")))
    found = FN.detail_join(_numbered(spark, d), details)
    return found.select("review_id", "number", "detail")


QUERIES = {
    "returns_dropped": returns_dropped,
    "findings_rejected": findings_rejected,
    "findings_merge": findings_merge,
    "findings_stages": findings_stages,
    "findings_numbered": findings_numbered,
    "findings_suppressed": findings_suppressed,
    "findings_soft": findings_soft,
    "findings_budget": findings_budget,
    "findings_over_budget": findings_over_budget,
    "findings_coverage": findings_coverage,
    "finding_verdicts": finding_verdicts,
    "finding_details": finding_details,
}

# --- the same in SQL ------------------------------------------------------------------------------------------


def _in(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _rank(column: str, values: list[str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values)) + " END"


def _value(rank: str, values: list[str]) -> str:
    return "CASE " + rank + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_F = """WITH f AS (SELECT l_suppkey % 20 AS review_id,
 list_value('security','correctness','testing','maintainability','performance','standards')[1 + l_partkey % 6] AS reviewer,
 'Issue ' || list_value('A','b!','C  c')[1 + l_orderkey % 3] AS title, list_value('P0','P1','P2','P3','P9')[1 + l_linenumber % 5] AS severity,
 'src/f' || (l_partkey % 50) || '.py' AS file_key, list_value('issue a','issue b','issue c c')[1 + l_orderkey % 3] AS title_key,
 CAST(l_orderkey % 200 AS INTEGER) AS line, CAST(25 * (CAST(l_quantity AS BIGINT) % 5) AS INTEGER) AS confidence,
 list_value('safe_auto','gated_auto','manual','advisory')[1 + CAST(l_quantity AS BIGINT) % 4] AS autofix_class,
 list_value('review-fixer','downstream-resolver','human','release')[1 + l_suppkey % 4] AS owner,
 l_returnflag = 'R' AS requires_verification, l_linestatus = 'O' AND l_orderkey % 3 = 0 AS pre_existing,
 CASE WHEN l_partkey % 2 = 0 THEN 'fix ' || (l_partkey % 10) END AS suggested_fix FROM lineitem WHERE l_orderkey % 50 NOT IN (7, 9, 11))"""
_M = f"""{_F}, v AS (SELECT *, {_rank('severity', V.SEVERITIES)} AS sr, {_rank('autofix_class', V.AUTOFIX_CLASSES)} AS rr, {_rank('owner', V.OWNERS)} AS orr,
 CASE WHEN autofix_class = 'safe_auto' THEN 1 WHEN autofix_class = 'advisory' THEN 0 WHEN suggested_fix IS NOT NULL THEN 1 ELSE 2 END AS ar
 FROM f WHERE severity <> 'P9' AND line >= 1),
st AS (SELECT *, CASE WHEN line - lag(line) OVER w <= {V.LINE_GAP} THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY review_id, file_key, title_key ORDER BY line)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY review_id, file_key, title_key ORDER BY line RANGE UNBOUNDED PRECEDING) AS island FROM st),
g AS (SELECT review_id, file_key, title_key, CAST(island AS BIGINT) AS island, first(title ORDER BY sr, confidence DESC, line, reviewer, title) AS title, min(line) AS line, min(sr) AS sr0, max(sr) AS sr1,
 max(confidence) AS raw_confidence, min(rr) AS rr0, max(rr) AS rr1, min(orr) AS or0, max(orr) AS or1, max(ar) AS ar1, bool_or(requires_verification) AS requires_verification,
 bool_and(pre_existing) AS pre_existing, min(suggested_fix) AS suggested_fix, list_sort(list(DISTINCT reviewer)) AS rv, list_sort(list(DISTINCT reviewer || ' (' || severity || ')')) AS said, count(*) AS reports
 FROM isl GROUP BY 1, 2, 3, island),
m AS (SELECT review_id, file_key, title_key, island, title, line, {_value('sr0', V.SEVERITIES)} AS severity,
 CAST(CASE WHEN len(rv) >= 2 AND raw_confidence >= 50 THEN least(100, raw_confidence + 25) ELSE raw_confidence END AS INTEGER) AS confidence, raw_confidence,
 {_value('rr1', V.AUTOFIX_CLASSES)} AS autofix_class, {_value('or1', V.OWNERS)} AS owner, requires_verification, pre_existing, suggested_fix,
 {_value('ar1', V.ACTIONS)} AS action, rv, reports,
 CASE WHEN sr0 <> sr1 OR rr0 <> rr1 OR or0 <> or1 THEN array_to_string(said, ', ') || ' -- kept ' || {_value('sr0', V.SEVERITIES)} END AS disagreement FROM g)"""
_S = f"""{_M}, s AS (SELECT *, CASE WHEN pre_existing THEN 'pre_existing'
 WHEN severity IN ('P2','P3') AND autofix_class = 'advisory' AND len(list_filter(rv, lambda x: x NOT IN {_in(V.WEAK_REVIEWERS)})) = 0 THEN 'weak'
 WHEN NOT (confidence >= 75 OR (severity = 'P0' AND confidence >= 50)) THEN 'suppressed' ELSE 'primary' END AS stage FROM m),
q AS (SELECT *, CASE WHEN stage = 'primary' THEN CASE WHEN autofix_class = 'safe_auto' AND owner = 'review-fixer' THEN 'fixer'
 WHEN autofix_class IN ('gated_auto','manual') AND owner = 'downstream-resolver' THEN 'residual' ELSE 'report' END END AS queue,
 CASE WHEN stage = 'weak' THEN CASE WHEN list_contains(rv, 'testing') THEN 'testing_gaps' ELSE 'residual_risks' END END AS soft_bucket FROM s)"""
_N = f"""{_S}, n AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY severity, confidence DESC, file_key, line, title_key, island) AS number FROM q WHERE stage = 'primary')"""

ORACLES = {
    "returns_dropped": "SELECT l_suppkey % 20 AS review_id, count(*) AS dropped_returns FROM lineitem WHERE l_orderkey % 50 IN (7, 9, 11) GROUP BY 1",
    "findings_rejected": f"{_F} SELECT review_id, CASE WHEN severity = 'P9' THEN 'severity' ELSE 'line' END AS rule, count(*) AS dropped FROM f WHERE severity = 'P9' OR line < 1 GROUP BY 1, 2",
    "findings_merge": f"{_M} SELECT * EXCLUDE (island, rv), array_to_string(rv, ',') AS reviewers FROM m",
    "findings_stages": f"{_S} SELECT review_id, stage, queue, soft_bucket, count(*) AS n FROM q GROUP BY ALL",
    "findings_numbered": f"{_N} SELECT review_id, number, severity, confidence, file_key, line, title_key, queue FROM n",
    "findings_suppressed": f"{_S} SELECT review_id, confidence, count(*) AS suppressed FROM q WHERE stage = 'suppressed' GROUP BY 1, 2",
    "findings_soft": f"{_S} SELECT review_id, soft_bucket AS kind, './' || file_key || ':' || line || ' -- ' || title AS entry FROM q WHERE stage = 'weak'",
    "findings_budget": f"{_N} SELECT review_id, CAST(number AS INTEGER) AS budget_rank, number, severity, confidence FROM n WHERE number <= {V.VALIDATION_BUDGET}",
    "findings_over_budget": f"{_N} SELECT review_id, greatest(0, count(*) - {V.VALIDATION_BUDGET}) AS over_budget FROM n GROUP BY 1",
    "findings_coverage": """SELECT DISTINCT l_suppkey % 20 AS review_id, 'residual_risk' AS kind, 'risk ' || (l_partkey % 50) AS entry FROM lineitem WHERE l_orderkey % 50 NOT IN (7, 9, 11)
UNION SELECT DISTINCT l_suppkey % 20, 'testing_gap', 'gap ' || (l_orderkey % 40) FROM lineitem WHERE l_orderkey % 50 NOT IN (7, 9, 11)""",
    "finding_verdicts": f"""{_N} SELECT review_id, number, number % 3 <> 0 AND number % 2 = 0 AS survives,
 CASE WHEN number % 3 = 0 THEN 'validator failed' WHEN number % 2 <> 0 THEN 'at line ' || line END AS drop_reason FROM n""",
    "finding_details": f"""{_N}, l AS (SELECT review_id, number, file_key, title_key, line, unnest(rv) AS reviewer, unnest(range(len(rv))) AS pos FROM n),
j AS (SELECT l.review_id, l.number, first('because ' || v.severity || ' ' || v.line ORDER BY pos, v.title_key <> l.title_key, abs(v.line - l.line), v.line, v.title_key, 'because ' || v.severity || ' ' || v.line) AS detail
  FROM l JOIN v ON v.review_id = l.review_id AND v.reviewer = l.reviewer AND v.file_key = l.file_key AND abs(v.line - l.line) <= {V.LINE_GAP} GROUP BY 1, 2)
SELECT n.review_id, n.number, j.detail FROM n LEFT JOIN j USING (review_id, number)""",
}
