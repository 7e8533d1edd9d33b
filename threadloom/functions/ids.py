"""Identifiers: full ids are keys, prefixes are only accepted at the edge."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import fixed_values as V


def id8(identifier: Column) -> Column:
    return F.coalesce(
        F.nullif(F.substring(identifier, 1, V.SHORT_ID), F.lit("")), F.lit(V.EMPTY_ID)
    )


def id_matches(left: Column, right: Column) -> Column:
    """Prefix equality when either side is short, exact otherwise; empty matches nothing."""
    short = (F.length(left) < V.FULL_ID) | (F.length(right) < V.FULL_ID)
    prefix = F.startswith(left, right) | F.startswith(right, left)
    return (left != "") & (right != "") & F.when(short, prefix).otherwise(left == right)


def names(column: Column, typed: str) -> Column:
    """`id_matches` with an id a user typed, in a form that reaches the scan: equality or a prefix one way, a list
    of the typed id's own prefixes the other way."""
    forward = column == typed if len(typed) >= V.FULL_ID else F.startswith(column, F.lit(typed)) & F.lit(bool(typed))
    shorter = [typed[:k] for k in range(1, min(len(typed), V.FULL_ID))]
    return forward | column.isin(shorter) if shorter else forward


def successor(prefix: str) -> str:
    """The smallest text that sorts after every text that starts with `prefix`; empty if there is none."""
    kept = prefix.rstrip("\U0010ffff")
    following = ord(kept[-1]) + 1 if kept else 0
    return kept[:-1] + chr(0xE000 if following == 0xD800 else following) if kept else ""


def keys_under(key: Column, lead: str, typed: list[str]) -> Column:
    """Keys `<lead><id>..` whose id one of the typed ids names, as in `names`, as ranges and equalities: a scan
    of a sorted table reads the pages in which they lie."""
    found = F.lit(False)
    for one in filter(None, typed):
        low, high = lead + one, successor(lead + one)
        found = found | ((key >= low) & (key < high) if high else key >= low)
        found = found | key.isin([lead + one[:k] for k in range(1, min(len(one), V.FULL_ID))]) if len(one) > 1 else found
    return found


def check_turn_id(turn: str) -> str:
    if not turn or not re.match(V.TURN_ID_PATTERN, turn):
        raise ValueError(f"{turn!r} is not a turn id or a prefix of at least 8 hex digits")
    return turn


def valid_turn_id(turn: Column) -> Column:
    return F.rlike(turn, F.lit(V.TURN_ID_PATTERN))
