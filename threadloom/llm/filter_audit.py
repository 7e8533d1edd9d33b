"""Filter interaction audit: what five filters remove in every order, with duplicates found by radix text tries.

1. One task pass over whole texts judges the four filters that need one text only (a bit each) and folds equal texts of
   a slice: all but those with the smallest id are settled as duplicates there, so a text that a third of all rows hold
   goes on once a slice. A settled row is (id, part, mask); an open one carries its text too. Both are one written table.
2. Texts are range-partitioned by prefixes. A prefix is lengthened only where the texts that share it weigh more than
   a trie should hold, for as long as they are not one and the same text; this needs sums per prefix, not an order of texts.
3. A task inserts the full texts of its range into a compressed trie. A terminal holds the smallest id of its text and
   the rows that have it: a larger id is a duplicate at once, a smaller one turns the rows held so far into duplicates.
   What is held at the end, read off in one traversal, is none. Rows stream; the trie holds each text once.
4. Rows, now narrow, meet their labels by id and are counted by (part, mask): at most 32 masks a part. Every order of the
   filters, every step and the Shapley shares are sums over those.

A mask has bit k if the row fails filter k of FILTERS. Filters: A below 200 words; B fewer distinct words than half of
them; C more than 2 % of the characters are A-Z; D holds one of `#$%&*|`; E the same text has a smaller id anywhere.

Defined results: a null text counts as the empty one, which fails A alone, and E if it is repeated; a null source
counts in part ''. A row without an id is no duplicate and makes none; rows that share id and text do not make each
other duplicates. Labels without an id label nothing; of several labels of an id, any that says quality 1 or toxic 1
counts. An empty table has no parts. Only the named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.words import slices
from threadloom.session import cut_lineage, drop_table

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))
#: Text bytes of a slice whose equal texts are folded before they are shuffled.
FOLD_BYTES = 32 << 20
#: Text bytes that one trie should hold.
TRIE_BYTES = 32 << 20
#: Bytes of the first prefix; each lengthening doubles them.
FIRST_PREFIX = 16
#: Prefixes to lengthen (8 bytes each) up to which they are broadcast; beyond, texts are joined by shuffle.
BROADCAST_PREFIXES = 1_000_000


def mask_of(text: bytes) -> int:
    """Bits of the filters that judge one text."""
    words = text.split()
    n = len(words)
    points = len(text.translate(None, _INNER))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (
        (n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * n) << 1
        | (100 * upper > MAX_UPPER_PERCENT * points) << 2 | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3)


class Trie:
    """A compressed radix trie of whole byte strings. A node is [edge, children by first byte, terminal or None]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def node(self, text: bytes) -> list:
        """The node of `text`, made if need be."""
        at, done = self.root, 0
        while done < len(text):
            children = at[1]
            below = children.get(text[done])
            if below is None:
                below = children[text[done]] = [text[done:], {}, None]
                return below
            edge = below[0]
            if text.startswith(edge, done):
                at, done = below, done + len(edge)
                continue
            # The text leaves this edge: halve what is left of it until the place is found.
            low, high = 1, min(len(edge), len(text) - done)
            while low < high:
                middle = (low + high + 1) // 2
                if text.startswith(edge[:middle], done):
                    low = middle
                else:
                    high = middle - 1
            fork = children[text[done]] = [edge[:low], {edge[low]: below}, None]
            below[0] = edge[low:]
            at, done = fork, done + low
        return at

    def terminals(self) -> Iterator[list]:
        """What the terminals hold, without recursion: an edge may be one byte, and texts are long."""
        open_ = [self.root]
        while open_:
            at = open_.pop()
            if at[2] is not None:
                yield at[2]
            open_.extend(at[1].values())


class Holder:
    """Rows of one text: the smallest id so far, and how many rows have it, by part."""

    __slots__ = ("id", "mask", "parts")

    def __init__(self, id_: int, mask: int) -> None:
        self.id, self.mask, self.parts = id_, mask, {}

    def offer(self, id_: int, part: str, n: int) -> list[tuple]:
        """Rows (id, part, mask, n) that turn out to be duplicates."""
        late = []
        if id_ > self.id:
            return [(id_, part, self.mask | DUPLICATE, n)]
        if id_ < self.id:
            late = [(self.id, p, self.mask | DUPLICATE, k) for p, k in self.parts.items()]
            self.id, self.parts = id_, {}
        self.parts[part] = self.parts.get(part, 0) + n
        return late

    def rows(self) -> list[tuple]:
        return [(self.id, p, self.mask, n) for p, n in self.parts.items()]


_KINDS = {"id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "n": pa.int64(), "text": pa.binary()}
_OPEN, _NARROW = "id bigint, part string, mask int, n bigint, text binary", "id bigint, part string, mask int, n bigint"


def _batch(rows: list[tuple], width: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * width
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=False)], list(_KINDS)[:width])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, n, text): n rows each; the text is null where no more comparison is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2, FOLD_BYTES):
                held: dict[bytes, Holder] = {}
                out: list[tuple] = []
                for id_, part, text in zip(*[piece.column(k).to_pylist() for k in range(3)], strict=True):
                    if id_ is None:
                        out.append((None, part, mask_of(text), 1, None))
                        continue
                    holder = held.get(text)
                    if holder is None:
                        holder = held[text] = Holder(id_, mask_of(text))
                    out += [(*row, None) for row in holder.offer(id_, part, 1)]
                out += [(*row, text) for text, holder in held.items() for row in holder.rows()]
                yield _batch(out, 5)

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, _OPEN)


def prefixed(rows: DataFrame, heavy: int = TRIE_BYTES, width: int = FIRST_PREFIX) -> DataFrame:
    """Adds key: a prefix of the text, of width, 2 width, 4 width, .. bytes. It is the first of them under which
    texts weigh at most `heavy` bytes, or are all the same one."""
    rows = rows.withColumn("key", F.substring("text", 1, width))
    while True:
        weight = F.sum(F.octet_length("text")) > heavy
        several = F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))
        # At most as many prefixes as all bytes hold `heavy`.
        found = cut_lineage(rows.groupBy(F.xxhash64("key").alias("print")).agg((weight & several).alias("split")).where("split"))
        n = found.count()
        if not n:
            drop_table(found)
            return rows
        width *= 2
        marks = found.select("print", "split")
        marks = F.broadcast(marks) if n <= BROADCAST_PREFIXES else marks
        # A prefix that merely shares a hash is lengthened too; all rows of a text still have the same key.
        rows = rows.withColumn("print", F.xxhash64("key")).join(marks, "print", "left").withColumn(
            "key", F.when(F.col("split"), F.substring("text", 1, width)).otherwise(F.col("key"))).drop("print", "split")


def duplicates(rows: DataFrame, heavy: int = TRIE_BYTES) -> DataFrame:
    """(id, part, mask, n) of open rows (id, part, mask, n, text), with the bit of E where a smaller id has the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            out: list[tuple] = []
            for id_, part, mask, n, text in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                node = trie.node(text)
                if node[2] is None:
                    node[2] = Holder(id_, mask)
                out += node[2].offer(id_, part, n)
            yield _batch(out, 4)
        out = []
        for holder in trie.terminals():
            out += holder.rows()
            if len(out) >= 10_000:
                yield _batch(out, 4)
                out = []
        yield _batch(out, 4)

    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total // heavy)
    # No prefix holds more than a task's even share, so that the ranges can be even.
    dealt = prefixed(rows, min(heavy, 1 + total // ranges)).repartitionByRange(ranges, "key")
    return dealt.select("id", "part", "mask", "n", "text").mapInArrow(run, _NARROW)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", heavy: int = TRIE_BYTES, **columns) -> DataFrame:
    """part, mask, n, good (of them with quality 1), toxic (with toxic 1): a written table of at most 32 rows a part."""
    rows = cut_lineage(judged(docs, id_col, **columns))
    flags = duplicates(rows.where("text IS NOT NULL"), heavy).unionByName(rows.where("text IS NULL").drop("text"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    n = F.col("n")
    out = cut_lineage(flags.join(said, "id", "left").groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic")))
    drop_table(rows)
    return out


def report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley."""
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(filters[j] for j in order), step, 1 << k, before))
            before |= 1 << k
    names = ("filter_order", "step", "bit", "before")
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, s, strict=True)]) for s in steps])
    orders = len(steps) // len(filters)
    # At most 2 ** len(filters) masks meet in one list.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.explode(table).alias("s")).select("part", "masks", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(value, where) -> Column:
        return F.aggregate("masks", F.lit(0).cast("bigint"), lambda t, m: t + F.when(where(m["mask"]), value(m)).otherwise(F.lit(0).cast("bigint")))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    # Of a row that fails k filters, each removes it in one k-th of all orders.
    share = lambda m: m["n"] * F.floor(F.lit(orders) / F.bit_count(m["mask"]))
    return rows.select(
        "part", "filter_order", "step", total(lambda m: m["n"], lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(lambda m: m["n"], here).alias("removed"), total(lambda m: m["n"], lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m["n"], lambda m: m == bit).alias("unique_fails"), total(lambda m: m["good"], here).alias("good_lost"),
        total(lambda m: m["toxic"], here).alias("toxic_lost"), total(share, fails).alias("shapley"))
