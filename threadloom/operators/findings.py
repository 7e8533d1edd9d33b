"""Merging the findings of several reviewers, many reviews in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.text import collapse
from threadloom.operators.ordered import first_rows, lookup, previous_value, rank_by_sort, running_count
from threadloom.session import cut_lineage

_SPOT = ["review_id", "file_key", "title_key"]


def _rank(column: Column, values: list) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), column) - 1


def _value(rank: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank + 1).cast("int"))


def normalise_file(path: Column) -> Column:
    return F.regexp_replace(F.translate(F.btrim(path), "\\", "/"), "^(\\./)+", "")


def normalise_title(title: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(title), "(?U)[^\\w\\s]+", " "))


# --- O1 ----------------------------------------------------------------------------------------------------


def _fault() -> Column:
    """First rule a finding breaks, null when it keeps all."""
    missing = lambda c: F.col(c).isNull()
    text = lambda c: F.coalesce(F.btrim(F.col(c)), F.lit("")) == ""
    outside = lambda c, vs: ~F.coalesce(F.col(c).isin(vs), F.lit(False))
    return (
        F.when(text("reviewer"), "reviewer").when(text("title"), "title").when(text("file"), "file")
        .when(outside("severity", V.SEVERITIES), "severity")
        .when(outside("autofix_class", V.AUTOFIX_CLASSES), "autofix_class")
        .when(outside("owner", V.OWNERS), "owner")
        .when(outside("confidence", V.CONFIDENCES), "confidence")
        .when(missing("line") | (F.col("line") < 1), "line")
        .when(missing("requires_verification"), "requires_verification")
        .when(missing("pre_existing"), "pre_existing")
    )


_RETURN_PARTS = ["reviewer", "findings", "residual_risks", "testing_gaps"]


def _whole() -> Column:
    return F.coalesce(F.btrim("reviewer"), F.lit("")).__ne__("") & F.forall(
        F.array(*[F.col(c).isNotNull() for c in _RETURN_PARTS]), lambda there: there)


def whole_returns(returns: DataFrame) -> DataFrame:
    """Returns of reviewers that have all their parts; one that lacks a part drops with all its findings."""
    return returns.where(_whole())


def dropped_returns(returns: DataFrame) -> DataFrame:
    """Returns that lack a part, per review."""
    return returns.where(~_whole()).groupBy("review_id").agg(F.count(F.lit(1)).alias("dropped_returns"))


def reported(returns: DataFrame) -> DataFrame:
    """Findings of whole returns, one row each, under the reviewer of the return. What a return lacks drops before its
    findings are looked at, so none of them counts in a merge."""
    kept = whole_returns(returns).select("review_id", "reviewer", F.explode("findings").alias("_f"))
    own = [c for c in kept.schema["_f"].dataType.names if c not in ("review_id", "reviewer")]
    return kept.select("review_id", "reviewer", *[F.col(f"_f.{c}").alias(c) for c in own])


def validate(findings: DataFrame) -> DataFrame:
    return findings.where(_fault().isNull())


def rejected(findings: DataFrame) -> DataFrame:
    """Dropped findings per review and broken rule."""
    return findings.withColumn("rule", _fault()).where(F.col("rule").isNotNull()).groupBy("review_id", "rule").agg(
        F.count(F.lit(1)).alias("dropped")
    )


# --- O2 to O7 ------------------------------------------------------------------------------------------------


def recommended_action(autofix: Column, has_fix: Column) -> Column:
    return (
        F.when(autofix == "safe_auto", "Apply")
        .when(autofix == "advisory", "Acknowledge")
        .when(has_fix, "Apply").otherwise("Defer")
    )


def with_place(findings: DataFrame) -> DataFrame:
    """Keys of the spot: review, normalised file and title, and the island of lines.

    Lines of a spot at most three apart belong together, transitively. Only distinct lines are
    ordered, so a spot that everybody flagged costs one row per line.
    """
    # Written once: the distinct lines and the rows they are joined to come from the same small table.
    slim = cut_lineage(_per_reviewer(findings.where(F.col("review_id").isNotNull())))
    lines = cut_lineage(slim.select(*_SPOT, "line").distinct())
    stepped = previous_value(lines, _SPOT, "line", F.col("line"), "_before")
    fresh = F.col("_before").isNull() | (F.col("line") - F.col("_before") > V.LINE_GAP)
    islands = running_count(stepped.withColumn("_fresh", fresh), _SPOT, "line", "island", F.col("_fresh"))
    # One row per distinct line on the right, and each row on the left finds its own. As a left join it never broadcasts the
    # left: a table that packs a hundred times smaller than its rows are looks small to the planner.
    return lookup(slim, islands.select(*_SPOT, "line", "island"), [*_SPOT, "line"])


def _per_reviewer(findings: DataFrame) -> DataFrame:
    """Equal findings as one row with their number, before anything is shuffled twice.

    Texts are keys, not minima: an aggregate that keeps a text sorts all rows of a map task. They are normalised
    after equal ones met.
    """
    counted = findings.groupBy(
        "review_id", "file", "title", "line", "reviewer", "severity", "autofix_class", "owner", "confidence",
        "requires_verification", "pre_existing", "suggested_fix",
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({
        "file_key": normalise_file(F.col("file")), "title_key": normalise_title(F.col("title")),
        "has_fix": F.coalesce("suggested_fix", F.lit("")) != "",
    })


def merge(findings: DataFrame) -> DataFrame:
    """One row per spot: strongest severity and confidence, most conservative route and action.

    Two or more reviewers lift the confidence by one step, from 50 on.
    """
    rows = with_place(validate(findings))
    sev, conf = _rank(F.col("severity"), V.SEVERITIES), F.col("confidence")
    route, owner = _rank(F.col("autofix_class"), V.AUTOFIX_CLASSES), _rank(F.col("owner"), V.OWNERS)
    act = _rank(recommended_action(F.col("autofix_class"), F.col("has_fix")), V.ACTIONS)
    said = F.concat(F.col("reviewer"), F.lit(" ("), F.col("severity"), F.lit(")"))
    merged = rows.groupBy(*_SPOT, "island").agg(
        F.min(F.struct(sev.alias("s"), (-conf).alias("c"), "line", "reviewer", "title", "file")).alias("_best"),
        F.min(sev).alias("_sev"), F.max(sev).alias("_sev_max"),
        F.max(conf).alias("raw_confidence"),
        F.min(route).alias("_route_min"), F.max(route).alias("_route"),
        F.min(owner).alias("_owner_min"), F.max(owner).alias("_owner"),
        F.max(act).alias("_act"),
        F.bool_or("requires_verification").alias("requires_verification"),
        F.bool_and("pre_existing").alias("pre_existing"),
        F.min("suggested_fix").alias("suggested_fix"),
        # Sets of reviewer names and of their verdicts: bounded by the roster, not by the rows.
        F.array_sort(F.collect_set("reviewer")).alias("reviewers"),
        F.array_sort(F.collect_set(said)).alias("_said"),
        F.min("line").alias("line"), F.sum("n").alias("reports"),
    )
    lifted = F.when(
        (F.size("reviewers") >= 2) & (F.col("raw_confidence") >= 50), F.least(F.lit(100), F.col("raw_confidence") + 25)
    ).otherwise(F.col("raw_confidence"))
    differs = (
        (F.col("_sev") != F.col("_sev_max")) | (F.col("_route") != F.col("_route_min")) | (F.col("_owner") != F.col("_owner_min"))
    )
    kept = _value(F.col("_sev"), V.SEVERITIES)
    return merged.select(
        "review_id", "file_key", "title_key", "island",
        F.col("_best.title").alias("title"), F.col("_best.file").alias("file"), "line",
        kept.alias("severity"), lifted.cast("int").alias("confidence"), "raw_confidence",
        _value(F.col("_route"), V.AUTOFIX_CLASSES).alias("autofix_class"), _value(F.col("_owner"), V.OWNERS).alias("owner"),
        "requires_verification", "pre_existing", "suggested_fix", _value(F.col("_act"), V.ACTIONS).alias("action"),
        "reviewers", "reports",
        F.when(differs, F.concat(F.array_join("_said", ", "), F.lit(" -- kept "), kept)).alias("disagreement"),
    )


# --- O4, O8 to O11 ----------------------------------------------------------------------------------------------


def is_weak() -> Column:
    weak = F.array(*[F.lit(r) for r in V.WEAK_REVIEWERS])
    return (
        F.col("severity").isin("P2", "P3") & (F.col("autofix_class") == "advisory")
        & F.forall("reviewers", lambda r: F.array_contains(weak, r))
    )


def passes_gate() -> Column:
    return (F.col("confidence") >= V.GATE_CONFIDENCE) | (
        (F.col("severity") == "P0") & (F.col("confidence") >= V.GATE_CONFIDENCE_P0)
    )


def staged(merged: DataFrame, mode: str = "report-only") -> DataFrame:
    """Every merged finding with the stage it ends in.

    Stages: pre_existing; weak (soft buckets, or suppressed in headless and autofix mode);
    suppressed by the confidence gate; primary.
    """
    weak = "weak" if mode in ("interactive", "report-only") else "weak_suppressed"
    stage = (
        F.when(F.col("pre_existing"), "pre_existing").when(is_weak(), weak)
        .when(~passes_gate(), "suppressed").otherwise("primary")
    )
    queue = (
        F.when((F.col("autofix_class") == "safe_auto") & (F.col("owner") == "review-fixer"), "fixer")
        .when(F.col("autofix_class").isin("gated_auto", "manual") & (F.col("owner") == "downstream-resolver"), "residual")
        .otherwise("report")
    )
    bucket = F.when(F.array_contains("reviewers", "testing"), "testing_gaps").otherwise("residual_risks")
    return merged.withColumn("stage", stage).withColumns({
        "queue": F.when(F.col("stage") == "primary", queue),
        "soft_bucket": F.when(F.col("stage") == "weak", bucket),
    })


def numbered(rows: DataFrame) -> DataFrame:
    """Stable numbers over the primary findings of each review, however many one review has."""
    order = [
        _rank(F.col("severity"), V.SEVERITIES).asc(), F.col("confidence").desc(), F.col("file").asc(),
        F.col("line").asc(), F.col("title_key").asc(), F.col("island").asc(),
    ]
    return rank_by_sort(rows.where(F.col("stage") == "primary"), ["review_id"], order, "number")


def suppressed_counts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("stage") == "suppressed").groupBy("review_id", "confidence").agg(
        F.count(F.lit(1)).alias("suppressed")
    )


def coverage(returns: DataFrame) -> DataFrame:
    """Union of residual risks and testing gaps over the reviewers of a review.

    `returns` has review_id, residual_risks and testing_gaps (arrays of text).
    """
    risk = returns.select("review_id", F.lit("residual_risk").alias("kind"), F.explode("residual_risks").alias("entry"))
    gap = returns.select("review_id", F.lit("testing_gap").alias("kind"), F.explode("testing_gaps").alias("entry"))
    return risk.unionByName(gap).distinct()


def soft_entries(rows: DataFrame) -> DataFrame:
    """Coverage lines of demoted findings."""
    return rows.where(F.col("stage") == "weak").select(
        "review_id", F.col("soft_bucket").alias("kind"),
        F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" -- "), F.col("title")).alias("entry"),
    )


# --- G8, O13, D12 --------------------------------------------------------------------------------------------------


def validation_budget(rows: DataFrame, k: int = V.VALIDATION_BUDGET) -> tuple[DataFrame, DataFrame]:
    """The k most severe numbered findings of each review, and how many are over budget."""
    order = [_rank(F.col("severity"), V.SEVERITIES), F.desc("confidence"), "number"]
    chosen = first_rows(rows, ["review_id"], order, k, "budget_rank")
    over = rows.groupBy("review_id").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - k).alias("over_budget"))
    return chosen, over


def apply_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Numbered findings with what their validation said; no verdict counts as failed.

    `verdicts` has review_id, number, validated and reason.
    """
    joined = rows.join(verdicts, ["review_id", "number"], "left")
    ok = F.coalesce("validated", F.lit(False))
    return joined.withColumns({
        "survives": ok,
        "drop_reason": F.when(~ok, F.when(F.col("validated").isNull(), "validator failed").otherwise(F.col("reason"))),
    })


def detail_join(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Detail of each finding from its reviewers' artifacts: same file, line within three.

    `details` has review_id, reviewer, file, line, title and detail. Lines are cut into strips of
    seven and a finding looks into its own and both neighbours, which makes the range an equi-join.
    Order of preference: reviewer list order, same title, nearest line.
    """
    strip = 2 * V.LINE_GAP + 1
    looks = rows.select(
        "review_id", "number", "file_key", "title_key", "line", F.posexplode("reviewers").alias("_at", "reviewer")
    ).withColumn("_strip", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col("line") / strip) + o)))
    have = details.select(
        "review_id", "reviewer", normalise_file(F.col("file")).alias("file_key"),
        F.floor(F.col("line") / strip).alias("_strip"), F.col("line").alias("_line"),
        normalise_title(F.col("title")).alias("_title"), "detail",
    )
    spot = ["review_id", "reviewer", "file_key", "_strip"]
    # One detail per line and title, and one per line for any title: a strip never meets more than
    # its seven lines, so no pairs of many findings with many details arise.
    titled = have.groupBy(*spot, "_line", "_title").agg(F.min("detail").alias("detail"))
    any_title = titled.groupBy(*spot, "_line").agg(F.min(F.struct("_title", "detail")).alias("d")).select(
        *spot, "_line", "d._title", "d.detail"
    )
    same = looks.withColumn("_title", F.col("title_key")).join(titled, [*spot, "_title"])
    near = same.unionByName(looks.join(any_title, spot)).where(
        F.abs(F.col("line") - F.col("_line")) <= V.LINE_GAP
    )
    best = near.groupBy("review_id", "number").agg(
        F.min(F.struct(
            "_at", (F.col("_title") != F.col("title_key")).alias("other"), F.abs(F.col("line") - F.col("_line")).alias("gap"),
            "_line", "_title", "detail",
        )).alias("b")
    ).select("review_id", "number", F.col("b.detail").alias("detail"))
    return rows.join(best, ["review_id", "number"], "left")
