"""Text functions as Column expressions (all JVM-side except the word-boundary cut)."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import fixed_values as V

_SPACES = "(?U)[\\s\\x1c-\\x1f]+"


def strip(text: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(text, F.lit(V.WHITESPACE))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; ends trimmed."""
    return F.btrim(F.regexp_replace(text, _SPACES, " "), F.lit(" "))


def collapse_ws(text: Column, limit: int) -> Column:
    """Collapsed leading slice, cut before it is normalised so cost follows `limit`."""
    return F.substring(collapse(F.substring(text, 1, limit * V.COLLAPSE_SLACK)), 1, limit)


def user_regex(pattern: str) -> str:
    """A caller's regex, case-insensitive and Unicode-aware, with `.` stopping only at newline."""
    return "(?iUd)" + pattern


def strip_system_xml(text: Column) -> Column:
    tagged = text
    for pattern in V.SYSTEM_XML_REMOVALS:
        tagged = F.regexp_replace(tagged, pattern, "")
    # Nine of the removals need an opening bracket: plain text skips them all.
    out = F.when(F.contains(text, F.lit("<")), tagged).otherwise(text)
    out = F.regexp_replace(out, "(?d)" + V.TRANSCRIPT_NOTE, "")
    return strip(F.regexp_replace(out, "\\n{3,}", "\n\n"))


def strip_leading_xml(text: Column) -> Column:
    out = text
    for _ in range(V.LEADING_WRAPPER_ROUNDS):
        out = F.regexp_replace(out, "(?U)" + V.LEADING_WRAPPER, "")
    return F.when(F.startswith(text, F.lit("<")), out).otherwise(text)


def command_args(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(V.COMMAND_ARGS), F.lit(1))
    return strip(F.array_join(F.transform(found, strip), " "))


def parse_teammate(text: Column) -> Column:
    """Struct(teammate_id, color, summary, body) of a teammate message, else null."""
    lead = F.ltrim(text, F.lit(V.WHITESPACE))
    opening = "(?i)" + V.TEAMMATE_OPEN
    attributes = F.regexp_extract(lead, opening, 1)
    pattern = F.lit("(?U)" + V.TEAMMATE_ATTRIBUTE)
    pairs = F.arrays_zip(
        F.regexp_extract_all(attributes, pattern, F.lit(1)).alias("k"),
        F.regexp_extract_all(attributes, pattern, F.lit(2)).alias("v"),
    )

    def attribute(name: str) -> Column:
        named = F.filter(pairs, lambda p: p["k"] == name)
        return F.try_element_at(named, F.lit(-1))["v"]

    rest = F.regexp_replace(lead, opening, "")
    body = strip(F.regexp_replace(rest, "(?iU)" + V.TEAMMATE_CLOSE, ""))
    return F.when(
        F.rlike(lead, F.lit(opening)) & attribute("teammate_id").isNotNull(),
        F.struct(
            attribute("teammate_id").alias("teammate_id"),
            attribute("color").alias("color"),
            attribute("summary").alias("summary"),
            body.alias("body"),
        ),
    )


@F.pandas_udf(T.StringType())
def _shorten(text: pd.Series, width: pd.Series) -> pd.Series:
    def one(value, limit):
        if value is None:
            return None
        cut = textwrap.shorten(value, width=limit, placeholder="...")
        return cut if cut != "..." else None

    return pd.Series([one(v, w) for v, w in zip(text, width)], dtype=object)


def smart_truncate(text: Column, width: int) -> Column:
    """Cut at a word boundary with '...', hard cut when there is none; 0 keeps everything.

    Only the head of the texts that are too long travels to Python: a word that starts within
    the width and runs past the head is longer than the width either way.
    """
    if not width:
        return text
    long = F.length(text) > width
    collapsed = collapse(F.when(long, text))
    head = F.substring(collapsed, 1, 2 * width + 16)
    words = _shorten(head, F.lit(width))
    hard = F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return F.when(long, F.coalesce(words, hard)).otherwise(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _shorten_all(texts: pd.Series, width: pd.Series) -> pd.Series:
    def one(value, limit):
        if value is None:
            return None
        cut = textwrap.shorten(value, width=limit, placeholder="...")
        return cut if cut != "..." else None

    return pd.Series(
        [None if row is None else [one(v, w) for v in row] for row, w in zip(texts, width)],
        dtype=object,
    )


def truncate_all(texts: Column, width: int) -> Column:
    """smart_truncate over every element of an array."""
    if not width:
        return texts
    heads = F.transform(
        texts,
        lambda t: F.when(
            F.length(t) > width, F.substring(collapse(t), 1, 2 * width + 16)
        ),
    )
    # Rows without a long element send nothing to Python.
    words = _shorten_all(F.when(F.exists(heads, lambda h: h.isNotNull()), heads), F.lit(width))
    filled = F.coalesce(words, F.transform(texts, lambda t: F.lit(None).cast("string")))
    return F.zip_with(
        texts,
        filled,
        lambda t, w: F.when(
            F.length(t) > width,
            F.coalesce(w, F.concat(F.substring(t, 1, width - 3), F.lit("..."))),
        ).otherwise(t),
    )


def cut_ellipsis(text: Column, limit: int) -> Column:
    """Cut to `limit` characters, the last being an ellipsis; 0 keeps everything."""
    if not limit:
        return text
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    ).otherwise(text)


def match_start(text: Column, pattern: str) -> Column:
    """Zero-based character position of the first match in `text`, null when there is none."""
    return F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0)) - 1


def with_excerpt(df: DataFrame, text: str, start: str, width: int, out: str) -> DataFrame:
    """Excerpt of collapsed column `text` around position `start` (null: the head).

    Up to 30 characters lead in; both ends snap to blanks; '...' marks a cut end.
    """
    t, ms = F.col(text), F.col(start)
    size = F.length(t)
    df = df.withColumn("_lo", F.greatest(F.lit(0), ms - V.EXAMPLE_LEAD))
    df = df.withColumn("_hi", F.least(size, F.col("_lo") + width))
    df = df.withColumn(
        "_lo",
        F.when(F.col("_hi") - F.col("_lo") < width, F.greatest(F.lit(0), F.col("_hi") - width))
        .otherwise(F.col("_lo")),
    )
    blank = F.expr(f"locate(' ', `{text}`, _lo + 1)") - 1
    df = df.withColumn("_blank", F.when(F.col("_lo") > 0, blank))
    df = df.withColumn(
        "_lo",
        F.when((F.col("_blank") >= 0) & (F.col("_blank") < ms), F.col("_blank") + 1)
        .otherwise(F.col("_lo")),
    )
    df = df.withColumn("_cut", F.expr(f"substring(`{text}`, _lo + 1, _hi - _lo)"))
    back = F.expr("locate(' ', reverse(_cut))")
    last = F.col("_lo") + F.length("_cut") - back
    df = df.withColumn(
        "_end",
        F.when((F.col("_hi") < size) & (back > 0) & (last > F.col("_lo")), last)
        .otherwise(F.col("_hi")),
    )
    body = F.expr("substring(_cut, 1, _end - _lo)")
    excerpt = F.concat(
        F.when(F.col("_lo") > 0, F.lit("...")).otherwise(F.lit("")),
        body,
        F.when(F.col("_end") < size, F.lit("...")).otherwise(F.lit("")),
    )
    df = df.withColumn(
        out, F.when(ms.isNull(), F.substring(t, 1, width)).otherwise(excerpt)
    )
    return df.drop("_lo", "_hi", "_blank", "_cut", "_end")


def snippet(text: Column, term: str) -> Column:
    """One line of context around the first case-insensitive hit of a literal term."""
    needle = term.lower()
    size, reach = len(needle), V.SNIPPET_RADIUS
    at = F.instr(F.lower(text), needle) - 1
    lo = F.greatest(F.lit(0), at - reach)
    hi = F.least(F.length(text), at + size + reach)
    cut = F.translate(F.substr(text, lo + 1, hi - lo), "\n", " ")
    return F.when(
        at >= 0,
        F.concat(
            F.when(lo > 0, F.lit("...")).otherwise(F.lit("")),
            cut,
            F.when(hi < F.length(text), F.lit("...")).otherwise(F.lit("")),
        ),
    )


def looks_like_no_match(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, V.NO_MATCH_HEAD))
    return F.coalesce(F.rlike(head, F.lit("|".join(V.NO_MATCH_MARKERS))), F.lit(False))


def first_line(text: Column) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def notification_fields(text: Column) -> Column:
    """Struct of a task notification: task id, status, result, token, tool and time counts."""

    def inside(tag: str, body: str = "[^<]+") -> Column:
        found = F.regexp_extract(text, f"<{tag}>({body})</{tag}>", 1)
        return F.when(F.rlike(text, F.lit(f"<{tag}>({body})</{tag}>")), strip(found))

    usage = inside("usage", "[\\s\\S]*?")

    def number(name: str) -> Column:
        # Both written forms occur: `name: 12` and `<name>12</name>`.
        plain = F.regexp_extract(usage, f"{name}(?::\\s*|>)(\\d+)", 1)
        return F.nullif(plain, F.lit("")).cast("bigint")

    return F.when(
        F.rlike(text, F.lit("<task-id>[^<]+</task-id>")),
        F.struct(
            inside("task-id").alias("task_id"),
            F.coalesce(inside("status"), F.lit("completed")).alias("status"),
            inside("result", "[\\s\\S]*?").alias("result"),
            number("total_tokens").alias("total_tokens"),
            number("tool_uses").alias("tool_uses"),
            number("duration_ms").alias("duration_ms"),
        ),
    )
