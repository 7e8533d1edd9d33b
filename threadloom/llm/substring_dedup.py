"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

1. A task hashes every window of its documents (a rolling polynomial over word hashes). Windows that
   repeat inside a slice of the task are settled there: only the first occurrence by (id, start)
   goes on, so a passage that a third of all documents hold sends one entry per slice. The others
   are packed into one block per hash bucket: hashes, and per document its starts.
2. A bucket brings together all occurrences of its hashes. All but the first by (id, start) are
   marked. A bucket is a task: their number follows the bytes of all texts, which are summed first, so a
   task's share stays some tens of megabytes whatever the input.
3. Marked starts return to their document as packed lists; overlapping or touching windows merge
   into maximal removal intervals.

Hashes have 64 bits, or 96 with lanes=2 (half as much more to shuffle). With 64, among 10**8 different windows
the chance that any two share a hash is about 3 in 10,000; with 96, among 2 * 10**13 (100 TB) about 3 in 1,000.

Defined results: a null text has no words; a text shorter than the window loses nothing; rows that
share an id are repeats of one document, lose the same words, and none of them because of another;
rows without an id lose nothing and remove nothing elsewhere. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.words import hash_words, inner_starts, mix, rolling, slices, split
from threadloom.session import cut_lineage

WINDOW = 20
#: Text bytes whose windows make up one bucket; about three times as much is shuffled.
BUCKET_BYTES = 12 << 20


def _bytes_of(hashes: list[np.ndarray]) -> bytes:
    """The first lane whole, of the second its upper half."""
    return b"".join([hashes[0].tobytes(), *[(h >> np.uint64(32)).astype(np.uint32).tobytes() for h in hashes[1:]]])


def _hashes_of(raw: pa.Buffer, lanes: int) -> np.ndarray:
    if lanes == 1:
        return np.frombuffer(raw, dtype=np.uint64).reshape(1, -1)
    n = len(raw) // 12
    return np.stack([np.frombuffer(raw, dtype=np.uint64, count=n), np.frombuffer(raw, dtype=np.uint32, offset=8 * n).astype(np.uint64)])


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def _later(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of all occurrences that come after the first by (id, start) of each hash. hashes: one row per lane.

    Repeats of one row have equal ids and starts and are not after each other.
    """
    order = np.argsort(hashes[0], kind="stable")
    first = hashes[0][order]
    same = first[1:] == first[:-1]
    among = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(among):
        return among
    among = among[np.lexsort((starts[among], ids[among], *[lane[among] for lane in hashes[::-1]]))]
    heads = np.zeros(len(among), dtype=bool)
    heads[0] = True
    for lane in hashes:
        heads[1:] |= lane[among][1:] != lane[among][:-1]
    head = among[np.maximum.accumulate(np.where(heads, np.arange(len(among)), 0))]
    return among[(ids[among] != ids[head]) | (starts[among] != starts[head])]


def _fold(ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes]:
    """Packs positions that are sorted by (id, start): ids with their counts, and gaps between starts."""
    firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    gaps = np.diff(starts, prepend=0)
    gaps[firsts] = starts[firsts]
    counts = np.diff(np.concatenate([firsts, [len(ids)]]))
    return _pack(np.concatenate([ids[firsts], counts])), _pack(gaps.astype(np.uint32))


def _unfold(docs: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
    names, counts = np.split(_unpack(docs, np.int64), 2)
    total = np.cumsum(_unpack(gaps, np.uint32), dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    base = np.where(firsts > 0, total[firsts - 1], 0)
    return np.repeat(names, counts), total - np.repeat(base, counts)


def _blocks(rows: DataFrame, window: int, buckets: int, lanes: int) -> DataFrame:
    """Per slice and bucket one block of packed positions with their hashes; without hashes: what the slice settled itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                offsets, codes, distinct = split(part.column(1))
                at = inner_starts(offsets, window)
                if not len(at):
                    continue
                words = hash_words(distinct, lanes)
                hashes = [rolling(mix(words[:, k].copy())[codes], window)[at] for k in range(lanes)]
                hashes[1:] = [h & ~np.uint64(0xFFFFFFFF) for h in hashes[1:]]
                counts = np.maximum(np.diff(offsets) - window + 1, 0)
                own = part.column(0).to_numpy(zero_copy_only=False)
                # Any name does: slices that share one are only unpacked together.
                name = int(np.frombuffer(xxhash.xxh3_64_digest(own.tobytes()), dtype=np.int64)[0])
                ids, starts = np.repeat(own, counts), at - np.repeat(offsets[:-1], counts)
                settled = _later(np.stack(hashes), ids, starts)
                out: list[tuple] = []
                if len(settled):
                    order = settled[np.lexsort((starts[settled], ids[settled]))]
                    out.append((name % buckets, *_fold(ids[order], starts[order]), None))
                alive = np.ones(len(ids), dtype=bool)
                alive[settled] = False
                left = np.flatnonzero(alive)
                home = ((hashes[0][left] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(home, kind="stable")
                left, home = left[order], home[order]
                bounds = np.searchsorted(home, np.arange(buckets + 1))
                for bucket in np.flatnonzero(np.diff(bounds)).tolist():
                    some = left[bounds[bucket] : bounds[bucket + 1]]
                    out.append((bucket, *_fold(ids[some], starts[some]), _bytes_of([h[some] for h in hashes])))
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([
                    pa.array([name] * len(out), pa.int64()), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]],
                ], ["slice", "bucket", "docs", "starts", "hashes"])

    return rows.mapInArrow(run, "slice bigint, bucket int, docs binary, starts binary, hashes binary")


def _marks(blocks: DataFrame, buckets: int, lanes: int) -> DataFrame:
    """id, starts: packed starts of windows that also start earlier. A bucket answers each block with one block, and
    the answers to a slice, which is bounded, are unpacked together."""

    def judge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        answers = [tuple(r) for r in zip(*[table.filter(pc.is_null(table["hashes"]))[c].to_pylist() for c in ("slice", "docs", "starts")], strict=True)]
        table = table.filter(pc.is_valid(table["hashes"]))
        if table.num_rows:
            parts = [_unfold(d, g) for d, g in zip(table["docs"].to_pylist(), table["starts"].to_pylist(), strict=True)]
            block = np.repeat(np.arange(len(parts)), [len(i) for i, _ in parts])
            ids, starts = (np.concatenate(c) for c in zip(*parts, strict=True))
            hashes = np.concatenate([_hashes_of(h.as_buffer(), lanes) for h in table["hashes"]], axis=1)
            late = np.sort(_later(hashes, ids, starts))
            names = table["slice"].to_pylist()
            for own in np.split(late, np.flatnonzero(np.diff(block[late])) + 1) if len(late) else ():
                own = own[np.lexsort((starts[own], ids[own]))]
                answers.append((names[block[own[0]]], *_fold(ids[own], starts[own])))
        columns = list(zip(*answers, strict=True)) or [(), (), ()]
        return pa.table({"slice": pa.array(columns[0], pa.int64()), "docs": pa.array(columns[1], pa.binary()), "starts": pa.array(columns[2], pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for answers in batch.column(0).to_pylist():
                ids, starts = (np.concatenate(c) for c in zip(*[_unfold(r["docs"], r["starts"]) for r in answers], strict=True))
                order = np.lexsort((starts, ids))
                ids, starts = ids[order], starts[order]
                cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
                packed = [_pack(np.diff(starts[a:b], prepend=0).astype(np.uint32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch({"id": pa.array(ids[cuts[:-1]]), "starts": pa.array(packed, pa.binary())})

    answers = blocks.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(judge, "slice bigint, docs binary, starts binary")
    gathered = answers.groupBy("slice").agg(F.collect_list(F.struct("docs", "starts")).alias("answers")).select("answers")
    return gathered.mapInArrow(unpack, "id bigint, starts binary")


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of `n_words` words lie in a window that starts at one of `starts`."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, lanes: int = 1) -> DataFrame:
    """One row per row of `docs`: id, text, marks (packed starts of removed windows; null if none)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // BUCKET_BYTES)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = _blocks(rows.where("id IS NOT NULL"), window, buckets, lanes)
    marks = cut_lineage(_marks(blocks, buckets, lanes).groupBy("id").agg(F.collect_list("starts").alias("marks")))
    return rows.join(marks, "id", "left")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, lanes: int = 1) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, intervals (maximal runs of removed words, [start, stop)),
    kept_text (kept words joined by one space) and kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                offsets, codes, distinct = split(part.column(1))
                gone = np.zeros(len(codes), dtype=bool)
                spans = []
                for row, marks in enumerate(part.column(2).to_pylist()):
                    own: list[list[int]] = []
                    if marks:
                        starts = np.concatenate([np.cumsum(_unpack(m, np.uint32), dtype=np.int64) for m in marks])
                        n = int(offsets[row + 1] - offsets[row])
                        mask = covered(n, starts[starts <= n - window], window)
                        gone[offsets[row] : offsets[row + 1]] = mask
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                        own = edges.reshape(-1, 2).tolist()
                    spans.append(own)
                upto = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                words = distinct.cast(pa.string()).take(pa.array(codes[~gone]))
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words), " ")
                yield pa.record_batch({
                    "id": part.column(0), "n_words": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(offsets) - np.diff(upto)),
                    "intervals": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept_text": kept,
                    "kept_sha256": pa.array([hashlib.sha256(k.as_buffer()).hexdigest() for k in kept], pa.string()),
                })

    marked = removals(docs, id_col, text_col, window, lanes)
    out = marked.mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, intervals array<array<bigint>>, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
