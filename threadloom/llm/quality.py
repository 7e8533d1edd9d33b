"""Quality rules: a base rule on counts, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to `buckets` counters. One pass over the corpus
sums each bucket over all documents (raw), one over the trusted documents (target). The score of a
text is the mean over its n-grams of log p_target - log p_raw, where the raw multinomial is scaled
to the target's size and both get the same pseudo-count, so an n-gram too rare for evidence scores
about 0. The verdict is score >= threshold: no sampling, no randomness.

Native DataFrame operations only: arrays per document, one explode into a partial aggregation with
at most `buckets` groups, and the weights as one array of fixed length.

Defined results: a null text has no words; a text without words fails the base rule (n_words < 20);
without trusted documents every score is 0 and only the base rule decides. A row without an id is
judged like any other. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.sized import checked
from threadloom.session import cut_lineage

SPACE = " \t\n\x0b\f\r"
_GAP = "[ \\t\\n\\x0B\\f\\r]+"

BUCKETS = 1 << 18
PSEUDO = 5.0
THRESHOLD = -0.12
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Trusted ids up to which they are broadcast; beyond, the planner joins them, and prunes texts with a Bloom filter.
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, _GAP)).otherwise(F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    """The text with A-Z, and no other letters, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def hashed(rows: DataFrame) -> DataFrame:
    """Adds n_words, _h (a 64-bit hash per word) and _h2 (one per pair of neighbours) to rows with _text.

    Arrays that a lambda reads are columns of an earlier select and are mentioned there more than once, so the
    optimizer never copies their computation into the lambda.
    """
    rows = rows.select("*", words(F.col("_text")).alias("_words"))
    rows = rows.select("*", F.size("_words").cast("bigint").alias("n_words"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    return rows.drop("_words").select("*", doubled("_h", 1).alias("_h2"))


def doubled(name: str, step: int) -> Column:
    """Hashes of windows twice as wide: of each value with the one `step` places on."""
    n = F.greatest(F.size(name) - step, F.lit(0))
    return F.zip_with(F.slice(name, 1, n), F.slice(name, step + 1, n), lambda a, b: F.xxhash64(a, b))


def base_metrics(rows: DataFrame) -> DataFrame:
    """Adds word_chars, n_symbols, n_dup_lines and n_repeat_words (for windows of 8 words) to rows with _text, _h, _h2."""
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    bare = F.col("_text")
    for c in SPACE:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    rows = rows.select(
        "*", F.length(bare).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"), lines.alias("_lines"),
        doubled("_h2", 2).alias("_h4"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")).drop("_lines")
    # Two equal windows of 8 words hold five equal pairs of windows of 4: only such texts need windows of 8.
    some = F.size("_h4") >= F.size(F.array_distinct("_h4")) + 5
    rows = rows.withColumn("_win", F.when(some, doubled("_h4", 4))).drop("_h4")
    repeats = F.size("_win") > F.size(F.array_distinct("_win"))
    rows = rows.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform("_win", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    last = F.size("_pairs") - 1
    w = lambda j: F.get("_pairs", j)["w"]
    marked = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & (w(j) == w(j - 1))) | ((j < last) & (w(j) == w(j + 1))))
    rows = rows.withColumn("_marks", F.when(F.col("_pairs").isNotNull(), F.sort_array(F.transform(marked, lambda j: F.get("_pairs", j)["i"]))))
    # Words covered: a window adds its width or the distance to the next one.
    gaps = F.sequence(F.lit(1), F.size("_marks") - 1)
    covered = F.aggregate(gaps, F.lit(8), lambda n, k: n + F.least(F.lit(8), F.get("_marks", k) - F.get("_marks", k - 1)))
    return rows.withColumn(
        "n_repeat_words", F.when(F.size("_marks") > 1, covered).otherwise(0).cast("bigint")
    ).drop("_win", "_pairs", "_marks")


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = BUCKETS, pseudo: float = PSEUDO) -> DataFrame:
    """One row with `weights`: log p_target - log p_raw of each bucket.

    trusted: frame with the ids of trusted documents. Raw counts cover every document, target counts every trusted one.
    """
    chosen = checked(cut_lineage(trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()), BROADCAST_IDS)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def sums(own: DataFrame, name: str) -> DataFrame:
        grams = hashed(own).select(F.concat("_h", "_h2").alias("_grams"))
        # The outer explode keeps the optimizer from deriving a filter that would compute the arrays again.
        grams = grams.select(F.explode_outer("_grams").alias("gram")).where("gram IS NOT NULL")
        return cut_lineage(grams.groupBy(bucket_of(F.col("gram"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name)))

    # Texts of the whole corpus are only scanned; no join stands between the scan and the sums.
    raw, target = sums(rows, "raw"), sums(rows.join(chosen, "_id", "left_semi"), "target")
    counts = raw.join(target, "bucket", "left").withColumn("target", F.coalesce("target", F.lit(0)))
    share = counts.select(F.sum("target") / F.sum("raw")).scalar()
    weight = F.log((F.col("target") + pseudo) / (F.col("raw") * share + pseudo))
    # Exactly `buckets` rows, a fixed number, meet in one list.
    dense = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(
        counts.select("bucket", weight.alias("weight")), "bucket", "left")
    listed = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0.0)).alias("weight"))))
    return cut_lineage(dense.agg(F.transform(listed, lambda e: e["weight"]).alias("weights")))


def judge(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score (mean log-likelihood ratio per n-gram, 0 without words) and kept."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = base_metrics(hashed(rows)).select("*", F.concat("_h", "_h2").alias("_grams"))
    # A scalar subquery, mentioned once: the optimizer puts the array into the expression as a constant, so no
    # row carries it.
    rows = rows.select("*", weights.select("weights").scalar().alias("_table"))
    total = F.aggregate("_grams", F.lit(0.0), lambda t, g: t + F.get("_table", bucket_of(g, buckets)))
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    rows = rows.select(
        "*", ((n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(0.0).alias("score"),
    )
    return rows.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
    )


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(F.col("quality") == 1).select(id_col)


def survivors(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns, that are kept: judged in place, without a join."""
    names, t = docs.columns, "_quality_row"
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(t))
    seen = whole.select(F.struct("*").alias("_id"), F.col(f"{t}.{options.pop('text_col', 'text')}").alias("_text"))
    judged = judge(seen, weights, "_id", "_text", **options).select(F.explode_outer(F.array(F.struct("_id", "kept"))).alias("j"))
    return judged.where("j.kept").select(f"j._id.{t}.*")
