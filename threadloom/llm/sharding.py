"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table: offset + j * skip
modulo the size. The shards take turns; in its turn a shard claims its first free slot. Shards get
nearly equal numbers of slots, and a changed list of shards moves few slots. A row goes to the
shard of the slot its key hashes to: one equi-join with the broadcast table, whose number of rows is
the fixed `slots`, whatever the data. No shuffle of rows.

Native DataFrame operations on the rows. Defined results: a null key counts as the empty key;
equal keys share a shard; every row gets exactly one shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and at least 100 times the number of shards for shares within about one per cent.
SLOTS = 65537


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard that owns each slot. Needs only the names of the shards, no data."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    order = []
    for name in shards:
        h = hashlib.md5(name.encode()).digest()
        order.append((int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1))
    owner, tried, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for shard, (offset, skip) in enumerate(order):
            while owner[slot := (offset + tried[shard] * skip) % slots] >= 0:
                tried[shard] += 1
            owner[slot] = shard
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot a key hashes to: the first 60 bits of its MD5, modulo the size of the table."""
    head = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10)
    return (head.cast("bigint") % slots).cast("int")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Rows (slot, shard): `slots` of them."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",").cast("array<int>")
    names = F.array(*[F.lit(s) for s in shards])
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "number"))
    return table.select("slot", F.get(names, F.col("number")).alias("shard"))


def assign(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """The rows of `docs`, all columns, with `shard_slot` and `shard` added (they replace columns of that name)."""
    table = F.broadcast(lookup_table(docs.sparkSession, shards, slots).select(
        F.col("slot").alias("shard_slot"), F.col("shard")))
    rows = docs.drop("shard", "shard_slot") if key not in ("shard", "shard_slot") else docs
    return rows.withColumn("shard_slot", slot_of(F.col(key), slots)).join(table, "shard_slot")


def manifest(assigned: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows and text bytes of each shard."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"))


def write(assigned: DataFrame, path: str) -> None:
    """One folder per shard. Every map task writes its own files, so no shard meets in one task."""
    assigned.drop("shard_slot").write.partitionBy("shard").parquet(path)
