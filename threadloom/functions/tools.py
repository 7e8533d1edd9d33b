"""Tool names, tool inputs and the classification of failed results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.fence import let
from threadloom.functions.text import collapse_ws, cut_ellipsis, smart_truncate

_QUALIFIED = "^mcp__((?:(?!__)[\\s\\S])+)__([\\s\\S]+)$"


def tool_server(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, _QUALIFIED, 1), F.lit(""))


def tool_short_name(name: Column) -> Column:
    return F.when(F.rlike(name, F.lit(_QUALIFIED)), F.regexp_extract(name, _QUALIFIED, 2)).otherwise(name)


def canonical_server(server: Column) -> Column:
    return F.lower(F.translate(server, "-", "_"))


def failure_kind_of_window(window: Column) -> Column:
    kind = F.lit(V.UNCLASSIFIED[0])
    for name, _, pattern in reversed(V.FAILURE_RULES):
        kind = F.when(F.rlike(window, F.lit("(?i)" + pattern)), F.lit(name)).otherwise(kind)
    return kind


def failure_kind(text: Column) -> Column:
    """Kind of an already-failed result, read from its first 1000 collapsed characters."""
    return let(collapse_ws(F.coalesce(text, F.lit("")), V.FAILURE_WINDOW), failure_kind_of_window)


def failure_category(kind: Column) -> Column:
    category = F.lit(V.UNCLASSIFIED[1])
    for name, owner, _ in V.FAILURE_RULES:
        category = F.when(kind == name, F.lit(owner)).otherwise(category)
    return category


FAILURE_KINDS = [name for name, _, _ in V.FAILURE_RULES] + [V.UNCLASSIFIED[0]]


def chosen(typed: str | None, allowed: list[str]) -> frozenset[str]:
    """The names in a comma-separated list a user typed; a name that is not allowed is an error."""
    names = frozenset(filter(None, map(str.strip, (typed or "").split(","))))
    if not names.issubset(allowed):
        raise ValueError(f"{sorted(names.difference(allowed))} not among {allowed}")
    return names


def telling_input(name: Column, input_json: Column) -> Column:
    """The one input that tells what a call does, uncut; the JSON text when none does."""
    field = lambda key: F.get_json_object(input_json, f"$.{key}")
    by_key: dict[str, list[str]] = {}
    for tool, key in V.TELLING_INPUT.items():
        by_key.setdefault(key, []).append(tool)
    picked = F.when(
        name == "Grep",
        F.concat(F.lit("/"), field("pattern"), F.lit("/"), F.coalesce(F.concat(F.lit(" "), field("path")), F.lit(""))),
    ).when(
        name == "Glob",
        F.concat(field("pattern"), F.coalesce(F.concat(F.lit(" in "), field("path")), F.lit(""))),
    )
    for key, tools in by_key.items():
        picked = picked.when(name.isin(tools), field(key))
    return F.coalesce(picked, input_json)


def tool_input_summary(name: Column, input_json: Column, truncate: int) -> Column:
    if not truncate:
        return input_json
    return smart_truncate(telling_input(name, input_json), truncate)


def input_one_line(input_json: Column, truncate: int) -> Column:
    """Compact one-line JSON of a call's input; an empty object shows as nothing."""
    line = F.translate(input_json, "\n", " ")
    return F.when(input_json.isNull() | (input_json == "{}"), F.lit("")).otherwise(
        cut_ellipsis(line, truncate)
    )


def searchable_inputs(uses: str) -> Column:
    """Names and searchable input strings of the tool_use blocks in array expression `uses`.

    Each `transform` is one step: parse the input, keep its string values in their order, then
    take the keys that matter for the tool (all of them for a tool that is not listed).
    """
    wanted = " ".join(
        f"WHEN '{tool}' THEN array({', '.join(repr(k) for k in keys)})" for tool, keys in V.SEARCHABLE_INPUTS.items()
    )
    parsed = f"""transform({uses}, u -> named_struct('name', u.tool_name,
        'all', map_entries(from_json(u.input_json, 'map<string,string>')),
        'typed', try_variant_get(try_parse_json(u.input_json), '$', 'map<string,variant>')))"""
    strings = f"""transform({parsed}, u -> named_struct('name', u.name, 'keys', CASE u.name {wanted} END,
        'strings', filter(u.all, e -> schema_of_variant(try_element_at(u.typed, e.key)) = 'STRING')))"""
    values = f"""transform({strings}, u -> concat(array(u.name), coalesce(if(u.keys IS NULL,
        transform(u.strings, e -> e.value),
        flatten(transform(u.keys, k -> transform(filter(u.strings, e -> e.key = k), e -> e.value)))), array())))"""
    return F.expr(f"flatten({values})")
