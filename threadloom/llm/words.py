"""Words of whole texts as numpy arrays, for the tasks that hash windows and shingles.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D. Arrow splits and
numbers the words, so the only Python loop runs over the distinct words of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once inside a task; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of `batch` of at most `limit` text bytes each, or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct): row i has the words distinct[codes[offsets[i]:offsets[i + 1]]].

    A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])
    words = flat.filter(pa.array(real)).dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    return before[bounds], words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def hash_words(distinct: pa.Array, lanes: int = 1) -> np.ndarray:
    """One row of `lanes` (1 or 2) 64-bit hashes per distinct word."""
    digest = xxhash.xxh3_64_digest if lanes == 1 else xxhash.xxh3_128_digest
    raw = b"".join(map(digest, distinct.cast(pa.large_binary()).to_pylist()))
    return np.frombuffer(raw, dtype=np.uint64).reshape(-1, lanes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all runs of `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = values[:n].copy()
    for k in range(1, width):
        out *= np.uint64(base)
        out += values[k : k + n]
    return mix(out)


def inner_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of `width` words lies within one row."""
    counts = np.diff(offsets) - width + 1
    counts = np.maximum(counts, 0)
    total = int(counts.sum())
    first = np.repeat(offsets[:-1], counts)
    skipped = np.repeat(np.cumsum(counts) - counts, counts)
    return first + (np.arange(total, dtype=np.int64) - skipped)
