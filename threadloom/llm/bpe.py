"""BPE encoding and decoding over a pair occurrence index.

For the distinct words of a piece of a partition, all symbols lie in one array with links to the
next and previous symbol of the same word. The index maps each pair that has a rank to all its
positions. Ranks that occur are applied in ascending order: the pair's live positions are merged at
once, and only the lists of the pairs that touch them are updated. That is the order in which each
word would merge by itself, since a word's merges never depend on another word.

Texts are cut at white space first: neither normalization, the splitting pattern nor the special
strings reach across it, so every distinct piece between white space is encoded once per slice.

The vocabulary file is a parameter, read from a folder that every machine has; it is never copied.
Defined results: a null text counts as the empty text and has no tokens; equal texts have equal ids.
Special strings in a text become their ids, as the public library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.words import slices, split

#: Above every rank; ranks, symbols and positions of a slice are 32-bit numbers.
_NONE = np.int32((1 << 31) - 1)
#: Text bytes encoded at once; one longer text makes a slice of its own.
SLICE_BYTES = 8 << 20
#: Ids laid out at once; one longer text makes a piece of its own. They take many times the bytes of the texts they are from.
TOKENS = 1 << 18
#: Places whose pairs are looked up at once.
PLACES = 1 << 18


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Pieces, merges, special strings and the splitting pattern of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        names = [""] * size
        for table in (ids, self.special):
            for name, i in table.items():
                names[i] = name
        self.names = pa.array(names, pa.string())
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int32)
        self.final = np.array([ids[c + end] for c in letters], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        self.twin = left == right
        self.size = np.int64(size)
        order = np.argsort(left * size + right, kind="stable")
        self.keys = (left * size + right)[order]
        self.order = order.astype(np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space is the Unicode property, without the separators U+001C to U+001F.
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.parts = regex.compile(pattern.replace(r"\s", space))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE for pairs that never merge."""
        key = a * self.size
        key += b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], _NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker."""
    return Vocabulary(path)


def _normal(piece: str) -> str:
    if piece.isascii():
        return piece.lower()
    # Letter by letter: the form of a letter does not depend on its place in the word.
    return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()


def encode_pieces(pieces: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of pieces without white space between their parts' ends."""
    joined, sizes = bytearray(), array("q")
    fixed: list[tuple[int, int]] = []
    per_piece = np.zeros(len(pieces), dtype=np.int64)
    for i, piece in enumerate(pieces):
        before = len(sizes)
        for k, bit in enumerate(v.cut.split(piece)) if v.cut and "<" in piece else ((0, piece),):
            if k % 2:
                fixed.append((len(sizes), v.special[bit]))
                parts = [b" "]
            else:
                parts = [w.encode() for w in v.parts.findall(_normal(bit))]
            joined += b"".join(parts)
            sizes.extend(map(len, parts))
        per_piece[i] = len(sizes) - before
    raw = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum(np.frombuffer(sizes, dtype=np.int64))
    symbols = v.inner[raw]
    symbols[ends - 1] = v.final[raw[ends - 1]]
    for part, special in fixed:
        symbols[ends[part] - 1] = special
    live = merge(symbols, ends, v)
    upto = np.concatenate([[0], np.cumsum(live, dtype=np.int64)])
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_piece)])]
    return symbols[live], np.diff(upto[bounds])


def merge(symbols: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Merges `symbols` (words end before `ends`) in place; returns which positions are left."""
    n = len(symbols)
    live = np.ones(n, dtype=bool)
    if n < 2:
        return live
    # Half the memory of 64-bit places, which a single text of more than 2 GB would need.
    place = np.int32 if n < 1 << 31 else np.int64
    following, previous = np.arange(1, n + 1, dtype=place), np.arange(-1, n - 1, dtype=place)
    following[ends - 1] = -1
    previous[np.concatenate([[0], ends[:-1]])] = -1
    rank = np.full(n, _NONE)
    inner = np.flatnonzero(following >= 0).astype(place)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(positions: np.ndarray) -> None:
        """Enters positions under their pair's rank."""
        ranks = rank[positions]
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        stop = int(np.searchsorted(ranks, _NONE))
        if not stop:
            return
        first = np.flatnonzero(np.concatenate([[True], ranks[1:stop] != ranks[: stop - 1]]))
        for r, a, b in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), stop], strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(positions[a:b])

    for a in range(0, len(inner), PLACES):
        some = inner[a : a + PLACES]
        rank[some] = v.rank(symbols[some], symbols[some + 1])
        add(some)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        if v.twin[r] and len(at) > 1:
            # In a run of equal symbols pairs overlap: every second one counts, from the left.
            at = np.sort(at)
            heads = np.concatenate([[True], following[at[:-1]] != at[1:]])
            numbers = np.arange(len(at))
            at = at[(numbers - np.maximum.accumulate(np.where(heads, numbers, 0))) % 2 == 0]
        gone = following[at]
        after = following[gone]
        symbols[at] = v.made[r]
        live[gone] = False
        rank[gone] = _NONE
        following[at] = after
        linked = after >= 0
        previous[after[linked]] = at[linked]
        before = previous[at]
        touched = np.concatenate([at, before[before >= 0]])
        if len(touched) > len(at):
            touched = np.unique(touched)
        ahead = following[touched]
        rank[touched] = np.where(ahead >= 0, v.rank(symbols[touched], symbols[ahead]), _NONE)
        add(touched)
    return live


def encoded(texts: pa.Array, v: Vocabulary, most: int = TOKENS) -> Iterator[pa.ListArray]:
    """Ids (unsigned 32 bit) of each text, in pieces of consecutive texts with at most `most` ids together, or of one text.

    The distinct pieces of all texts are encoded at once; only what they come to in the texts is laid out by and by.
    """
    offsets, codes, distinct = split(texts)
    ids, counts = encode_pieces(distinct.to_pylist(), v)
    del distinct
    ids = ids.astype(np.uint32)
    first = np.cumsum(counts) - counts
    ends = np.concatenate([[0], np.cumsum(counts[codes])])[offsets]
    start, n = 0, len(texts)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        words = codes[offsets[start] : offsets[stop]]
        lengths = counts[words]
        at = np.repeat(first[words] - np.cumsum(lengths) + lengths, lengths)
        at += np.arange(len(at))
        yield pa.ListArray.from_arrays(pa.array((ends[start : stop + 1] - ends[start]).astype(np.int32)), pa.array(ids[at]))
        start = stop


def encode(texts: pa.Array, v: Vocabulary) -> pa.ListArray:
    """Ids (unsigned 32 bit) of each text."""
    return pa.concat_arrays([pa.array([], pa.list_(pa.uint32())), *encoded(texts, v)])


def decode(ids: pa.ListArray, v: Vocabulary) -> pa.StringArray:
    """Names of the tokens joined by one space, special ones too: what a file without decoder says."""
    names = v.names.take(ids.values)
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, names), " ")


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of ids) and decoded (text) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                row = 0
                for ids in encoded(part.column(1), v):
                    own = part.column(0).slice(row, len(ids))
                    row += len(ids)
                    yield pa.record_batch({"id": own, "ids": ids.cast(pa.list_(pa.int32())), "decoded": decode(ids, v)})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 of every row.

    The same encoding and decoding; hashes are taken in the task, so that ids never leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                row = 0
                for ids in encoded(part.column(1), v):
                    at = ids.offsets.to_numpy()
                    raw = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
                    told = decode(ids, v)
                    yield pa.record_batch({
                        "id": part.column(0).slice(row, len(ids)), "n_tokens": pa.array(np.diff(at).astype(np.int64)),
                        "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)],
                        "decoded_sha256": [hashlib.sha256(t.as_buffer()).hexdigest() for t in told],
                    })
                    row += len(ids)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
