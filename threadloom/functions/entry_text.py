"""The texts of an entry: what was said, what can be searched, what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.functions.fence import fenced
from threadloom.functions.tools import searchable_inputs, telling_input

TALK = ["human", "meta", "tool_result", "assistant"]


def _of(kind: str, blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] == kind)


def body_text(blocks: Column) -> Column:
    cleaned = F.transform(_of("text", blocks), lambda b: X.strip_system_xml(b["text"]))
    kept = F.filter(cleaned, lambda t: (t != "") & ~F.startswith(t, F.lit(V.INTERRUPT_USER_SENTINEL)))
    return F.array_join(kept, "\n")


def marker_text(blocks: Column) -> Column:
    return F.array_join(F.transform(_of("text", blocks), lambda b: b["text"]), " ")


def thinking_text(blocks: Column) -> Column:
    stripped = F.transform(_of("thinking", blocks), lambda b: X.strip(b["text"]))
    return F.array_join(F.filter(stripped, lambda t: t != ""), "\n")


def output_text(blocks: Column) -> Column:
    return F.array_join(F.transform(_of("tool_result", blocks), lambda b: b["text"]), "\n")


def tool_text(blocks: str) -> Column:
    return F.array_join(searchable_inputs(f"filter({blocks}, b -> b.type = 'tool_use')"), "\n")


def has_failure(blocks: Column) -> Column:
    return F.coalesce(
        F.exists(blocks, lambda b: F.coalesce(b["is_error"], F.lit(False))), F.lit(False)
    )


def substantive_text(body: Column, marker: Column, teammate: Column) -> Column:
    """What the human said; '' for scaffolding and for messages of team mates."""
    text = X.strip(body)
    bare = X.strip(X.strip_leading_xml(text))
    said = F.when(text != "", F.coalesce(F.nullif(bare, F.lit("")), text)).otherwise(
        X.command_args(marker)
    )
    return F.when(teammate.isNotNull(), F.lit("")).otherwise(said)


def origin(entry_type: Column, is_meta: Column, marker: Column, teammate: Column, said: Column) -> Column:
    """What a user-role entry really is; null for every other entry."""
    cut = F.contains(marker, F.lit(V.INTERRUPT_SENTINEL))
    return (
        F.when(entry_type == "tool_result", F.when(cut, "interrupt").otherwise("tool_result"))
        .when(entry_type == "meta", "meta")
        .when(
            entry_type == "human",
            F.when(is_meta, "meta")
            .when(cut, "interrupt")
            .when(teammate.isNotNull(), "teammate")
            .when(said != "", "human")
            .otherwise("command_scaffolding"),
        )
    )


def with_texts(df: DataFrame) -> DataFrame:
    """Adds every text of an entry and, for user-role entries, its origin."""
    b, kind = F.col("blocks"), F.col("entry_type")
    df = fenced(
        df,
        F.when(kind.isin("human", "meta", "assistant"), body_text(b)).alias("body_text"),
        F.when(kind.isin("human", "meta", "tool_result"), marker_text(b)).alias("marker_text"),
    )
    df = fenced(df, F.when(kind == "human", X.parse_teammate(F.col("marker_text"))).alias("teammate"))
    said = substantive_text(F.col("body_text"), F.col("marker_text"), F.col("teammate"))
    df = fenced(df, F.when(kind == "human", said).alias("substantive_text"))
    # These are read by few queries and stay plain, so that they are pruned when they are not.
    return df.withColumns({
        "thinking_text": F.when(kind == "assistant", thinking_text(b)),
        "tool_text": F.when(kind == "assistant", tool_text("blocks")),
        "output_text": F.when(kind == "tool_result", output_text(b)),
        "origin": origin(
            kind, F.col("is_meta"), F.col("marker_text"), F.col("teammate"), F.col("substantive_text")
        ),
    })


def _human_display(truncate: int) -> Column:
    tm = F.col("teammate")
    head = F.concat(
        F.lit("[teammate: "), tm["teammate_id"], F.lit(" → "),
        F.coalesce(F.nullif("agent_name", F.lit("")), F.lit("?")), F.lit("]"),
    )
    gloss = F.btrim(F.concat(tm["summary"], F.lit(" — "), tm["body"]), F.lit(" —"))
    body = F.when(F.coalesce(tm["summary"], F.lit("")) != "", gloss).otherwise(tm["body"])
    line = F.when(body != "", X.strip(F.concat(head, F.lit(" "), body))).otherwise(head)
    return X.smart_truncate(F.when(tm.isNotNull(), line).otherwise(F.col("body_text")), truncate)


def _tool_display(truncate: int) -> Column:
    shown = F.flatten(
        F.transform(
            _of("tool_result", F.col("blocks")),
            lambda b: F.transform(
                b["parts"],
                lambda p: F.struct(
                    (p["kind"] == "image").alias("image"),
                    F.coalesce(b["is_error"], F.lit(False)).alias("error"),
                    p["text"].alias("text"),
                ),
            ),
        )
    )
    texts = X.truncate_all(F.transform(shown, lambda s: s["text"]), truncate)
    lines = F.zip_with(
        shown,
        texts,
        lambda s, t: F.when(s["image"], F.lit("[image]")).otherwise(
            F.concat(F.when(s["error"], F.lit("[error] ")).otherwise(F.lit("")), t)
        ),
    )
    return F.array_join(lines, "  ")


def _assistant_display(truncate: int, hide: frozenset[str]) -> Column:
    b = F.col("blocks")
    parts = []
    if "thinking" not in hide:
        thoughts = F.filter(
            F.transform(_of("thinking", b), lambda x: X.strip(x["text"])), lambda t: t != ""
        )
        cut = X.truncate_all(thoughts, truncate)
        parts.append(F.transform(cut, lambda t: F.concat(F.lit("[thinking] "), t)))
    body = X.smart_truncate(F.col("body_text"), truncate)
    parts.append(F.when(F.col("body_text") != "", F.array(body)).otherwise(F.array().cast("array<string>")))
    if "inputs" not in hide:
        uses = _of("tool_use", b)
        detail = F.transform(
            uses,
            lambda u: telling_input(u["tool_name"], u["input_json"]) if truncate else u["input_json"],
        )
        calls = F.zip_with(
            uses,
            X.truncate_all(detail, truncate),
            lambda u, d: F.concat(F.lit("→ "), u["tool_name"], F.lit("("), d, F.lit(")")),
        )
        parts.append(calls)
    return F.array_join(F.concat(*parts), "  ")


def display(truncate: int = 0, hide: frozenset[str] = frozenset()) -> Column:
    """What a row of `with_texts` shows; `hide` drops thinking, inputs or outputs."""
    kind = F.col("entry_type")
    tool = F.lit("") if "outputs" in hide else _tool_display(truncate)
    return (
        F.when(kind == "human", _human_display(truncate))
        .when(kind == "tool_result", tool)
        .when(kind == "assistant", _assistant_display(truncate, hide))
        .otherwise(F.lit("[?]"))
    )


def with_display(df: DataFrame, hide: frozenset[str] = frozenset()) -> DataFrame:
    return df.withColumn("display", display(0, hide)).withColumn("display_len", F.length("display"))


def raw_searchable() -> Column:
    """All text a search looks at, joined; used to show a hit the display does not contain."""
    kind = F.col("entry_type")
    parts = F.filter(F.array("body_text", "tool_text", "thinking_text"), lambda t: t != "")
    return (
        F.when(kind == "human", F.col("body_text"))
        .when(kind == "assistant", F.array_join(parts, "\n"))
        .when(kind == "tool_result", F.col("output_text"))
        .otherwise(F.lit(""))
    )


def role_letter() -> Column:
    kind = F.col("entry_type")
    return F.when(kind == "human", "U").when(kind == "tool_result", "T").otherwise("A")


def entry_line(shown: Column, uuid8: Column) -> Column:
    """turn|epoch|role|full_length|display on one physical line."""
    return F.concat_ws(
        "|",
        uuid8,
        F.coalesce(F.unix_timestamp("ts"), F.lit(0)).cast("string"),
        role_letter(),
        F.col("display_len").cast("string"),
        F.replace(shown, F.lit("\n"), F.lit("\\n")),
    )
