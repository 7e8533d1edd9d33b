"""The registered queries of this package, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, exact_dedup, filter_audit, html_text, language_id, licenses, line_dedup, merkle, mixing, near_dedup, quality, sharding, sql, substring_dedup

SHARDS = [f"shard-{n:03d}" for n in range(64)]


def vocabulary_path() -> str:
    """The public vocabulary that every machine has; its package is not one of the library's."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language_id.predict(docs, language_id.fit(docs))
    return told.withColumn("held_out", language_id.held_out(F.col("doc_id")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.dedup(docs, lanes=2).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", F.col("shard_slot").alias("slot"), "shard")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs, weights)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", "removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Where 3 divides the id's checksum, the copy that is verified has its text lower-cased.
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.digest(*[
        merkle.field(quality.lower_ascii(F.col(c)) if c == "text" else F.col(c)) for c in merkle.FIELDS]))
    rows = merkle.verify(merkle.manifest(docs, extra=changed), F.coalesce("extra", "leaf"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels_of(licenses.scan(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_language_id, op3_substring_dedup, op4_html_text, op5_bpe, op6_sharding, op7_quality_rules, op8_mixing,
    op9_near_dedup, op10_line_dedup, op11_merkle, op12_filter_audit, op13_license_scan,
)}
#: The others have no SQL: they are tested against plain Python, the public library or held-out labels.
ORACLES = {
    "op1_exact_dedup": sql.OP1,
    "op3_substring_dedup": sql.OP3,
    "op6_sharding": sql.op6(SHARDS),
    "op8_mixing": sql.OP8,
    "op9_near_dedup": sql.OP9,
    "op11_merkle": sql.OP11,
    "op12_filter_audit": sql.OP12,
}
