"""Merkle dataset manifest by sibling-shift self-joins.

Leaves are numbered densely within their tree (range partition, places inside ranges, offsets between
them; a tree that holds a third of all rows is many ranges). A level is one table of nodes
(tree, idx, digest). Every node computes the places of its run, idx XOR offset for two children a
parent, idx - slot + (slot + offset) mod arity otherwise, and an equi-join on (tree, place) brings
their digests; at most `arity` rows meet in one group. Slot-zero rows then emit the parents, which
are the nodes of the next level. A node with place 0 and no sibling is its tree's root. The roots,
in order of their trees, are the leaves of a top tree built by the same code.

Proofs come down again: a node's path is its own step (siblings on its left, on its right) before the
path of its parent, joined on (tree, idx div arity), so each parent meets its at most `arity` children,
and long paths are made last, on rows that are not shuffled any more. Each level is a written table:
a lost executor costs tasks of one level.

Defined results: a null field hashes as `-`, an empty text as `0:`. Leaves without an id come first
in their tree; rows that share an id are ordered by their leaf, so the result does not depend on how
rows arrive, and rows equal in all hashed fields share a leaf, each with a place and a proof of its own.
A null tree name is a tree, the first. An empty table gives an empty manifest without a root. Only the
named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ordered import rank_by_sort
from threadloom.session import cut_lineage

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<slot int, others array<binary>>>"
_TOP = ""


def digest(*parts: Column) -> Column:
    """H as hex text: SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(name: Column) -> Column:
    """Text that sorts as the names do, bytewise, with null first; never empty and never null."""
    return F.coalesce(F.concat(F.lit(":"), name.cast("string")), F.lit("-"))


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _join_hex(raws: Column) -> Column:
    return F.array_join(F.transform(raws, _hex), "")


def _level(nodes: DataFrame, arity: int) -> DataFrame:
    """tree, idx, digest, payload, slot, others: each node with the digests of its run's other nodes, left to right."""
    idx, offset = F.col("idx"), F.col("offset")
    slot = idx % arity
    place = idx.bitwiseXOR(offset) if arity == 2 else idx - slot + (slot + offset) % arity
    asked = nodes.select("tree", "idx", F.explode(F.sequence(F.lit(0), F.lit(arity - 1)).cast("array<bigint>")).alias("offset"))
    asked = asked.select("tree", "idx", place.alias("place"))
    told = nodes.select("tree", F.col("idx").alias("place"), "digest", "payload")
    met = asked.join(told, ["tree", "place"])
    own = F.col("place") == F.col("idx")
    sibling = F.when(~own, F.struct("place", "digest"))
    runs = met.groupBy("tree", "idx").agg(
        F.any_value(F.when(own, F.struct("digest", "payload")), ignoreNulls=True).alias("own"), F.sort_array(F.collect_list(sibling)).alias("others"))
    return runs.select("tree", "idx", "own.digest", "own.payload", slot.cast("int").alias("slot"), F.col("others.digest").alias("others"))


def _is_root() -> Column:
    return (F.col("idx") == 0) & (F.size("others") == 0)


def levels(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """Written tables of all levels, from leaves (tree, idx, digest binary, payload) up to the last root.

    Roots stay in the level in which their tree ends; the others of a level have parents in the next.
    """
    if arity < 2:
        raise ValueError("a parent has two children at least")
    out, nodes = [], leaves
    while True:
        level = cut_lineage(_level(nodes, arity))
        out.append(level)
        inner = level.where(~_is_root())
        if inner.isEmpty():
            return out
        # Slot zero is the first of its run: all others are on its right.
        parent = digest(_hex(F.col("digest")), _join_hex(F.col("others")))
        nodes = inner.where("slot = 0").select("tree", F.expr(f"idx div {arity}").alias("idx"), F.unhex(parent).alias("digest"), F.lit(None).cast(leaves.schema["payload"].dataType).alias("payload"))


def roots(tables: list[DataFrame]) -> DataFrame:
    """tree, digest: one row per tree."""
    found = [t.where(_is_root()).select("tree", "digest") for t in tables]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def paths(tables: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """Each leaf of `tables[0]`: tree, idx, digest, payload, and what its tree has in `above` (tree, path, named): the
    columns `named`, and its path, which gets the leaf's own steps in front."""
    down = None
    for table in reversed(tables):
        step = F.array(F.struct("slot", "others"))
        top = table.where(_is_root()).join(above, "tree")
        here = table.where(~_is_root()).withColumn("up", F.expr(f"idx div {arity}"))
        if down is not None:
            parents = down.select("tree", F.col("idx").alias("up"), "path", "named")
            joined = here.join(parents, ["tree", "up"]).withColumn("path", F.concat(step, "path")).drop("up")
            down = joined.select(*_CARRIED).unionByName(top.select(*_CARRIED))
        else:
            down = top.select(*_CARRIED)
    return down


_CARRIED = ("tree", "idx", "digest", "payload", "path", "named")


def proof(path: Column) -> Column:
    """The digests of all siblings on a path, level by level, as hex text."""
    return F.array_join(F.transform(path, lambda s: _join_hex(s["others"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf (hex text) has with the siblings on its path."""

    def up(below: Column, s: Column) -> Column:
        left = F.slice(s["others"], F.lit(1), s["slot"])
        right = F.slice(s["others"], s["slot"] + 1, F.size(s["others"]))
        return F.sha2(F.concat(_join_hex(left), below, _join_hex(right)), 256)

    return F.aggregate(path, leaf, up)


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", arity: int = ARITY,
    extra: Column | None = None,
) -> DataFrame:
    """One row per row of `docs`: id, leaf, subroot, root (hex text) and path (slot and siblings, level by level, up
    to the root). extra: one more text column of `docs` to carry along, as `extra`."""
    leaf = F.unhex(digest(*[field(F.col(c)) for c in fields]))
    extra = F.lit(None).cast("string") if extra is None else extra
    hashed = cut_lineage(docs.select(F.col(id_col).alias("id"), tree_key(F.col(tree_col)).alias("tree"), leaf.alias("digest"), extra.alias("extra")))
    numbered = rank_by_sort(hashed, ["tree"], [F.col("id"), F.col("digest")], "place")
    below = levels(numbered.select("tree", (F.col("place").cast("bigint") - 1).alias("idx"), "digest", F.struct("id", "extra").alias("payload")), arity)
    subroots = cut_lineage(roots(below))
    ordered = rank_by_sort(subroots.withColumn("top", F.lit(_TOP)), ["top"], [F.col("tree")], "place")
    above = levels(ordered.select(
        F.col("top").alias("tree"), (F.col("place").cast("bigint") - 1).alias("idx"), "digest", F.col("tree").alias("payload")), arity)
    start = roots(above).select("tree", F.array().cast(_STEP).alias("path"), F.struct(F.col("digest").alias("root")).alias("named"))
    heads = paths(above, start, arity).select(
        F.col("payload").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), "named.root").alias("named"))
    # One row per tree, with all its path above: written, so that its size is known to the planner.
    out = paths(below, cut_lineage(heads), arity)
    return out.select(
        F.col("payload.id").alias(id_col), _hex(F.col("digest")).alias("leaf"), _hex(F.col("named.subroot")).alias("subroot"),
        _hex(F.col("named.root")).alias("root"), "path", F.col("payload.extra").alias("extra"))


def verify(manifest_rows: DataFrame, leaf: Column) -> DataFrame:
    """Adds proof_sha256, folded_root (of `leaf`, with the siblings the manifest has) and verified."""
    rows = manifest_rows.select("*", leaf.alias("_leaf"))
    rows = rows.select("*", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.col("_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).drop("_leaf")
