"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, components.

A document is the set of its distinct word shingles. Two permutations make all coordinates of its
signature: the first places each shingle in a universe of 2**20 slots, the second orders the slots,
and coordinate k is the smallest second value at the slots shifted circularly by k. With the second
permutation laid out twice in a row, a shingle's values for all k are consecutive memory.

1. One task pass over texts makes a narrow sketch: set size, 128-bit key of the set, signature.
2. Documents with the same set are one class, represented by the smallest id.
3. Signatures fall into BANDS bands of ROWS rows; representatives that share a band are candidates.
   A band's bucket may hold very many of them, so no bucket is paired with itself: each member is
   paired with one hub, first the smallest then the largest id of the bucket. Members that still have
   a fitting one of another component in their bucket are what is left of a group once its bulk is
   connected. They are paired across components by their rarest shingles: two sets that reach the
   threshold share one among the first n - ceil(0.75 n) + 1 of each, in order of frequency, early
   enough for the rest of both to hold the common part. That is exact, so no link is given up.
4. Pairs pass a bound on set sizes (needed for the threshold) and a comparison of one bit per
   coordinate, both inside the joins that pair them; a pair at the threshold fails the bits with a
   chance below one in a million. Then comes the exact test on full sets:
   den * |A and B| >= num * |A or B|. Only sets of candidates are written.
5. Components of confirmed links; every document gets the smallest id it can reach.

A pair at similarity 0.75 shares no band with chance (1 - 0.75**4)**32, about five in a million.

Defined results: a text without words (or null) has an empty set and links with nothing; a text with
fewer words than a shingle is one shingle; rows that share an id are linked, whatever their texts; a row
without an id links with nothing and is kept. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.components import bucket_links, components
from threadloom.llm.sized import checked
from threadloom.llm.words import hash_words, mix, slices, split
from threadloom.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 32, 4
SLOT_BITS = 20
#: Of two sets' signatures, each coordinate's lowest bit differs with chance (1 - similarity) / 2. A pair is not
#: verified if more bits differ than this many standard deviations above what the threshold expects.
DEVIATIONS = 5.3
#: Candidates up to which their ids are broadcast to the scan of the texts; beyond, texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
_STEP = 1024


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, ASCII letters lower-cased."""
    offsets, codes, distinct = split(pc.ascii_lower(texts))
    values = mix(hash_words(distinct)[:, 0].copy())[codes]
    n = max(len(values) - width + 1, 0)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += values[k : k + n]
    rolled = mix(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield np.frombuffer(xxhash.xxh3_64_digest(values[a:b].tobytes(), seed=b - a), dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


@lru_cache(maxsize=2)
def second_permutation(coordinates: int) -> np.ndarray:
    """Row s holds the values of slot s under all shifts; a view, the memory is one permutation and a bit."""
    size = 1 << SLOT_BITS
    order = np.random.Generator(np.random.PCG64(20240229)).permutation(size).astype(np.uint32)
    twice = np.concatenate([order[size - coordinates + 1 :], order])
    return np.lib.stride_tricks.sliding_window_view(twice, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash signature of one non-empty set."""
    rows = second_permutation(coordinates)
    slots = (mix(shingles) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(slots), _STEP):
        np.minimum(out, rows[slots[a : a + _STEP]].min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, n (set size), key (of the set; null if empty), bands (64-bit hash per band) and bits (one per coordinate,
    64 to a number)."""
    coordinates = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                n, keys, hashes, bits = [], [], [], []
                for own in shingle_sets(part.column(1), width):
                    n.append(len(own))
                    if not len(own):
                        keys.append(None), hashes.append(None), bits.append(None)
                        continue
                    sig = signature(own, coordinates)
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                    wide = sig.reshape(bands, rows).astype(np.uint64)
                    band = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + wide[:, r])
                    hashes.append(band.view(np.int64))
                    bits.append(np.packbits((sig & 1).astype(bool)).view(np.int64))
                yield pa.record_batch({
                    "id": part.column(0), "n": pa.array(n, pa.int64()), "key": pa.array(keys, pa.binary()),
                    "bands": pa.array(hashes, pa.list_(pa.int64())), "bits": pa.array(bits, pa.list_(pa.int64())),
                })

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n bigint, key binary, bands array<bigint>, bits array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id and shingles (bytes of the sorted hashes) of the wanted nodes (id, rep, key). A text is read where its document
    is the node's, and kept if its set has the node's key: other texts of that document are other nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found, keep = [], []
                for own, key in zip(shingle_sets(part.column(1), width), part.column(2), strict=True):
                    found.append(own.tobytes())
                    keep.append(xxhash.xxh3_128_digest(found[-1]) == key.as_py())
                yield pa.record_batch({"id": part.column(0), "shingles": pa.array(found, pa.binary())}).filter(pa.array(keep, pa.bool_()))

    wanted = checked(cut_lineage(wanted.select(F.col("id").alias("node"), F.col("rep").alias("id"), "key")), BROADCAST_IDS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted, "id")
    return rows.select("node", "text", "key").mapInArrow(run, "id bigint, shingles binary").groupBy("id").agg(F.any_value("shingles").alias("shingles"))


def _sharing_rare(sets: DataFrame, unsettled: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that pass the prefix and position filters of a set similarity join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(s.as_buffer(), dtype=np.int64) for s in batch.column(1)]
            yield pa.record_batch({"id": batch.column(0), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    kind = sets.schema["id"].dataType.simpleString()
    tokens = cut_lineage(sets.mapInArrow(run, f"id {kind}, tokens array<bigint>"))
    single = tokens.select("id", F.explode("tokens").alias("token"))
    # A document's shingles, rarest first; a document bounds its own list.
    ranked = single.join(single.groupBy("token").agg(F.count(F.lit(1)).alias("f")), "token").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("f", "token"))).alias("ordered"))
    n = F.size("ordered")
    prefix = ranked.select("id", n.alias("n"), F.slice("ordered", 1, n - F.ceil(n * num / F.lit(den)).cast("int") + 1).alias("p"))
    prefix = prefix.join(unsettled, "id").select("id", "c", "n", F.posexplode(F.transform("p", lambda e: e["token"])).alias("pos", "token"))
    # Of a pair in different components one is outside the component that is most frequent at the token.
    prefix = cut_lineage(prefix)
    most = prefix.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(
        F.max_by("c", F.struct("k", "c")).alias("usual"), F.count(F.lit(1)).alias("cs")).where("cs > 1").drop("cs")
    prefix = prefix.join(most, "token")
    left, right = (prefix.select(F.col("token").alias(f"t_{x}"), F.col("id").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in ("c", "n", "pos", "usual")]) for x in "ab")
    common = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    enough = common * (num + den) >= num * (F.col("n_a") + F.col("n_b"))
    pairs = left.where("c_a != usual_a").join(right, (F.col("t_a") == F.col("t_b")) & (F.col("c_a") != F.col("c_b")) & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, num: int = 75, den: int = 100,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept."""
    sketch = cut_lineage(sketches(docs, id_col, text_col, width, bands, rows))
    named = sketch.where("id IS NOT NULL AND key IS NOT NULL")
    # Sets that are equal are one node; what belongs to the set is the same in all its rows. Nodes are numbered as they
    # are written, in order of their smallest ids: two texts of one id are two nodes, and a group's first document,
    # from which copies were made, is the hub of its buckets.
    sets = named.groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"))
    reps = cut_lineage(sets.repartitionByRange("rep", "key").sortWithinPartitions("rep", "key").withColumn("id", F.monotonically_increasing_id()))
    members = reps.select(F.explode("bands").alias("bucket"), "id")
    words = bands * rows // 64
    facts = reps.select("id", F.struct("n", *[F.col("bits")[k].alias(f"b{k}") for k in range(words)]).alias("n"))
    sizes = F.col("n_a.n").cast("double") / F.col("n_b.n")
    differing = sum((F.bit_count(F.col(f"n_a.b{k}").bitwiseXOR(F.col(f"n_b.b{k}"))) for k in range(words)), F.lit(0))
    chance = (1 - num / den) / 2
    most = bands * rows * chance + DEVIATIONS * (bands * rows * chance * (1 - chance)) ** 0.5
    fits = (sizes * den >= num) & (sizes * num <= den) & (differing <= int(most))

    def sets_of(nodes: DataFrame) -> DataFrame:
        return _sets(docs, reps.select("id", "rep", "key").join(nodes.distinct(), "id"), id_col, text_col, width)

    def confirm(pairs: DataFrame) -> DataFrame:
        near = cut_lineage(pairs)
        if near.isEmpty():
            return near
        wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id")))
        return _confirmed(near, cut_lineage(sets_of(wanted)), num, den)

    def across(unsettled: DataFrame) -> DataFrame:
        return _sharing_rare(sets_of(unsettled.select("id")), unsettled, num, den)

    links = cut_lineage(bucket_links(members, facts, confirm, fits, across))
    # An id with several texts joins their nodes.
    home = named.select("key", F.col("id").alias("doc")).join(reps.select("key", "id"), "key").select("doc", "id").distinct()
    several = cut_lineage(home.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b"))
    if not several.isEmpty():
        more = home.join(several.select("doc", "a"), "doc").where("id != a").select("a", F.col("id").alias("b"))
        links = links.unionByName(more)
    # A node's component is named by the smallest id of all its documents.
    found = cut_lineage(components(links).join(reps.select("id", "rep", "key"), "id"))
    least = cut_lineage(found.groupBy("component").agg(F.min("rep").alias("least")))
    linked = cut_lineage(found.join(checked(least), "component").select("key", "least"))
    reps = reps.select("key", "rep").join(linked, "key", "left").select("key", F.coalesce("least", "rep").alias("c"))
    final = named.select("id", "key").join(reps, "key").groupBy("id").agg(F.min("c").alias("c"))
    out = sketch.select("id", "n").join(final, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns, that represent their component."""
    dropped = checked(cut_lineage(classes(docs, id_col, **options).where("NOT kept").select(id_col).distinct()), BROADCAST_IDS)
    return docs.join(dropped, id_col, "left_anti")
