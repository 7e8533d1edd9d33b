"""Language ID by compression: the language whose dictionary encodes a text in the fewest bytes.

Fit: per language a bounded sample of labelled documents (DOCS_PER_LANGUAGE, those of smallest
hashed id) fills a raw-content zstandard dictionary of at most DICT_BYTES. Each document gives pieces
spread over its whole text, cut on the executors, of which only the bytes that the dictionary takes reach
the driver. Every language is learned; with more than 256 of them dictionaries shrink, so that all
together stay below TOTAL_BYTES, and more than MAX_LANGUAGES are an error.
Predict: the whole text, reduced to its lower-case letters, is cut into blocks of BLOCK_BYTES, so
that a long text does not become its own dictionary. Each block is compressed with every
dictionary; sizes add up. The smallest total wins, the margin to the second gives score, and a
margin below MIN_MARGIN is marked as rejected.

Defined results: a null text or one without a letter is `und` with score 0; so is every text when
no language could be learned. Equal totals: the first language by code point order, score 0. With
one learned language the score is 1. Labels, sources and ids are never inputs of a prediction.
Rows that share an id are told each by its own text; of a sampled id's texts one gives the pieces. An
empty table teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCS_PER_LANGUAGE = 200
DICT_BYTES = 64 << 10
#: All dictionaries together; with very many languages each gets less. More languages than MAX_LANGUAGES are an error.
TOTAL_BYTES = 16 << 20
MAX_LANGUAGES = 4096
#: Places of a text from which a dictionary takes its pieces, evenly spread.
PIECES = 4
BLOCK_BYTES = 1000
#: Thorough search for matches of four bytes and more: the parts of short words decide.
SEARCH = zstandard.ZstdCompressionParameters(
    window_log=17, hash_log=17, chain_log=16, search_log=3, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
    write_content_size=False, write_checksum=False, write_dict_id=False,
)
MIN_MARGIN = 0.01
FOLDS = 5


def held_out(id_col: Column) -> Column:
    """Every fifth document by CRC-32 of the id as text; those take no part in learning."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def letters(text: Column) -> Column:
    """Lower-case letters with their marks, other runs of characters as one space; empty without a letter."""
    shown = F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " "))
    return F.when(F.rlike(text, F.lit(r"\p{L}")), shown).otherwise(F.lit(""))


def spread(text: Column, share: Column) -> Column:
    """At most about `share` characters of a text: the text itself, or PIECES pieces of equal length, the first from
    its start, the last up to its end."""
    piece = F.floor(share / PIECES).cast("int")
    step = (F.length(text) - piece) / (PIECES - 1)
    cut = F.concat_ws(" ", *[F.substr(text, F.floor(k * step).cast("int") + 1, piece) for k in range(PIECES)])
    return F.when(F.length(text) <= share, text).otherwise(cut)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = DOCS_PER_LANGUAGE, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw dictionary content per language, from pieces of at most `per_language` documents each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("id")))
    n = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    size = min(dict_bytes, TOTAL_BYTES // max(n, 1))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    # At most per_language ids a language; only the pieces that a dictionary takes leave the executors, one text an id.
    share = F.greatest(F.floor(F.lit(size) / F.count(F.lit(1)).over(Window.partitionBy("lang"))), F.lit(200))
    chosen = chosen.select("id", "lang", share.cast("int").alias("share"))
    lettered = rows.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "id", "share", letters(F.col("text")).alias("t"))
    sample = lettered.select("lang", "id", spread(F.col("t"), F.col("share")).alias("text")).groupBy("lang", "id").agg(F.min("text").alias("text"))
    found: dict[str, list[tuple]] = {}
    for r in sample.collect():
        found.setdefault(r["lang"], []).append((r["id"], r["text"].encode()))
    return dictionaries({lang: [t for _, t in sorted(own)] for lang, own in sorted(found.items())}, size)


def dictionaries(texts: dict[str, list[bytes]], size: int) -> dict[str, bytes]:
    """What a language's texts hold, one after the other; a language without letters gets no dictionary."""
    joined = {lang: b" ".join(own)[:size] for lang, own in texts.items()}
    return {lang: raw for lang, raw in joined.items() if raw.strip()}


def coders(model: dict[str, bytes]) -> list:
    """A compressor per language, in the order of sorted(model)."""
    out = []
    for name in sorted(model):
        d = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=SEARCH)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=SEARCH).compress)
    return out


def judge(raw: bytes, encode: list) -> tuple[int, float]:
    """(number of the best language, its margin to the second)."""
    blocks = [raw[a : a + BLOCK_BYTES] for a in range(0, len(raw), BLOCK_BYTES)]
    sizes = [sum(len(c(b)) for b in blocks) for c in encode]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min((s for k, s in enumerate(sizes) if k != best), default=None)
    return best, 1.0 if second is None else (second - sizes[best]) / second


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
            min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score (0 to 1), margin and rejected."""
    names = sorted(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coders(model)
        for batch in batches:
            langs, scores, margins = [], [], []
            for text in batch.column(1).to_pylist():
                raw = text.strip().encode()
                if not raw or not encode:
                    langs.append("und"), scores.append(0.0), margins.append(0.0)
                    continue
                best, margin = judge(raw, encode)
                langs.append(names[best]), margins.append(margin)
                scores.append(1.0 if len(names) == 1 else margin / (margin + 0.05))
            yield pa.record_batch({"id": batch.column(0), "lang_pred": langs, "score": pa.array(scores, pa.float64()), "margin": pa.array(margins, pa.float64())})

    rows = docs.select(F.col(id_col).alias("id"), letters(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, margin double")
    return out.withColumn("rejected", F.col("margin") < min_margin).withColumnRenamed("id", id_col)
