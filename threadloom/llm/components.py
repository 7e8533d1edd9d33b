"""Connected components of an edge list, as joins and aggregations on narrow rows.

Every round points each node to its smallest neighbour, if that is smaller, and follows the pointers to
their roots by doubling. Then the roots are the nodes, and what is left of the edges between different ones are the
edges, of the next round; each component has at most half as many nodes in it, so rounds are few and all
but the first are small. Nothing is collected; a hub with very many links is a minimum per map task
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.sized import checked
from threadloom.session import cut_lineage, drop_table


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id of `edges` (columns a, b) the smallest id it can reach."""
    left = cut_lineage(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = _roots(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
        ends = [labels.select(F.col("id").alias(x), F.col("label").alias(f"at_{x}")) for x in "ab"]
        apart = left.join(ends[0], "a").join(ends[1], "b").where("at_a != at_b")
        rest = cut_lineage(apart.select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b")).distinct())
        # What the roots of the rounds before have become.
        found = labels if found is None else cut_lineage(_followed(found, labels))
        drop_table(left)
        left = rest
        if left.isEmpty():
            drop_table(left)
            return found.select("id", F.col("label").alias("component"))


def _followed(labels: DataFrame, further: DataFrame) -> DataFrame:
    """labels (id, label), each label replaced by what `further` says of it, if anything. Only labels that move are
    joined: the root that very many ids share stays, or is one row of a small side."""
    moves = further.where("id != label").select(F.col("id").alias("label"), F.col("label").alias("further"))
    moves = cut_lineage(moves.join(labels.select("label").distinct(), "label", "left_semi"))
    return labels.join(checked(moves), "label", "left").select("id", F.coalesce("further", "label").alias("label"))


def _roots(pointers: DataFrame) -> DataFrame:
    """(id, label) of pointers that lead to smaller ids, each label followed to its root; a written table."""
    labels = cut_lineage(pointers)
    while True:
        moved = cut_lineage(_followed(labels, labels).join(labels.select("id", F.col("label").alias("old")), "id"))
        changed = not moved.where("label != old").isEmpty()
        drop_table(labels)
        labels = moved.select("id", "label")
        if not changed:
            return labels


def bucket_links(
    members: DataFrame, facts: DataFrame, confirm: Callable[[DataFrame], DataFrame], fits: Column,
    across: Callable[[DataFrame], DataFrame] | None = None, pairs: DataFrame | None = None,
) -> DataFrame:
    """Links (a, b) that connect what the members of each bucket have to do with each other.

    members: rows (bucket, id). facts: one row per id, id and n of any type. confirm: keeps the pairs (a, b) that are
    links. fits: a necessary condition on n_a and n_b; joins evaluate it before they make a row.
    A bucket of m members is not paired with itself: members are paired with one hub, first the smallest, then the
    largest id. Only members whose components still differ are then paired with each other, so the result has
    the components of all links: a pair that is never tried lies in one component already.
    across: makes those pairs itself, from rows (id, c) of the members that have a fitting one in another component
    c; for groups so alike that pairing them by bucket would make very many rows.
    pairs: further pairs (a, b), a < b, to be tried with the first ones.
    """
    hubs = members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high")
    shared = cut_lineage(members.join(hubs, "bucket"))
    a, b = (facts.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")

    def star(hub: str) -> DataFrame:
        pairs = shared.where(f"id != {hub}").select(F.least("id", hub).alias("a"), F.greatest("id", hub).alias("b")).distinct()
        return pairs.join(a, "a").join(b, "b").where(fits).select("a", "b")

    tried = star("low").unionByName(star("high"))
    tried = cut_lineage((tried if pairs is None else tried.unionByName(pairs)).distinct())
    links = cut_lineage(confirm(tried))
    labels = shared.select("bucket", "id").join(components(links), "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("c"))
    apart = labels.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("bucket")
    rest = cut_lineage(labels.join(apart, "bucket", "left_semi").join(facts, "id"))
    left, right = (
        rest.select(F.col("bucket").alias(f"in_{x}"), F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("c").alias(f"c_{x}")) for x in "ab")
    apart = (F.col("in_a") == F.col("in_b")) & (F.col("c_a") != F.col("c_b")) & fits
    if across is None:
        cross = left.join(right, apart & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    else:
        unsettled = cut_lineage(left.join(right, apart, "left_semi").select(F.col("a").alias("id"), F.col("c_a").alias("c")).distinct())
        cross = across(unsettled)
    more = cut_lineage(confirm(cross.join(tried, ["a", "b"], "left_anti")))
    for t in (shared, tried, rest):
        drop_table(t)
    return links.unionByName(more)
