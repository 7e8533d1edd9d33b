"""License scan: ordered signature rules on normalised words. Native DataFrame operations only.

1. A text is normalised to lower-case words with one space between them and one at either end.
2. Prefilter: the keywords of all rules are looked up in the text; a rule runs only where its keyword occurs, so a text
   without any costs a few dozen searches for literals and no regular expression.
3. A rule that runs marks its matches (two control characters, which no normalised text holds, are put around each), and
   the marked words give the places: [start, stop) in words, in linear time.
4. Detections that lie within another one of higher priority, or within a longer one of the same priority, are
   suppressed; of equal ones the earlier rule's stays. Sorted by start and falling stop, a detection's containers come
   before it, so one scan with the furthest stop so far of each priority decides, in blocks, so that a text with very
   many detections costs no square.
Base detections (fixed phrases) are never suppressed.

Everything happens inside a row: no shuffle, and texts never leave the scan.

Defined results: a null or empty text has no words, no detections and score 0. Rows that share an id are judged each by
its own text; a null id stays null. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import license_rules
from threadloom.llm.quality import lower_ascii

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"
#: Detections that one inner scan handles.
BLOCK = 256

Rule = tuple[str, int, str, str]


def _let(value: Column, body) -> Column:
    """body(value) inside a lambda, with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _within(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def normalised(text: Column) -> Column:
    """Lower-case words, each with a space before and after it; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), _GAP, " ")


def places(norm: Column, pattern: Column | str) -> Column:
    """array<struct<start, stop>>: the matches of a pattern, in words."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.split(F.regexp_replace(norm, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), " ")

    def read(words: Column) -> Column:
        starts = F.array_compact(F.transform(words, lambda w, i: F.when(w.startswith(_OPEN), i - 1)))
        stops = F.array_compact(F.transform(words, lambda w, i: F.when(w.endswith(_CLOSE), i)))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))

    return _let(marked, read)


def _base(norm: Column) -> Column:
    """Base detections in order: array<struct<start, stop, label>>."""
    nothing = F.array().cast("array<struct<start:int,stop:int,label:string>>")

    def of(phrase: str, label: str) -> Column:
        own = F.transform(places(norm, _within(phrase)), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.lit(label).alias("label")))
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), own).otherwise(nothing)

    return F.sort_array(F.concat(*[of(p, label) for p, label in license_rules.BASE.items()]))


def _table(rules: list[Rule]) -> Column:
    """The rules as one constant; `nth` is their order."""
    return F.array(*[
        F.struct(F.lit(k).alias("nth"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(keyword).alias("keyword"), F.lit(_within(regex)).alias("regex"))
        for k, (label, priority, keyword, regex) in enumerate(rules)])


_TOLD = "struct<start:int,stop:int,priority:int,label:string,rule:int,kept:boolean>"
_FOUND = "array<struct<start:int,back:int,under:int,nth:int,label:string>>"


def _detections(norm: Column, rule: Column) -> Column:
    """Matches of one rule; the fields sort containers before what they contain."""
    return F.transform(places(norm, rule["regex"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["stop"]).alias("back"), (-rule["priority"]).alias("under"), rule["nth"].alias("nth"), rule["label"].alias("label")))


def _judged(found: Column, levels: int, block: int) -> Column:
    """array<struct<start, stop, priority, label, rule, kept>> of sorted detections."""
    inner, state = f"struct<far:array<int>,done:array<{_TOLD}>>", f"struct<far:array<int>,done:array<array<{_TOLD}>>>"

    def one(s: Column, d: Column) -> Column:
        priority, stop = -d["under"], -d["back"]
        # far[p]: the furthest stop so far of detections of priority p or more.
        kept = F.get(s["far"], priority) < stop
        far = F.transform(s["far"], lambda f, p: F.when(p <= priority, F.greatest(f, stop)).otherwise(f))
        told = F.struct(d["start"].alias("start"), stop.alias("stop"), priority.alias("priority"), d["label"].alias("label"), d["nth"].alias("rule"), kept.alias("kept"))
        return F.struct(far.alias("far"), F.concat(s["done"], F.array(told)).alias("done")).cast(inner)

    def some(s: Column, k: Column) -> Column:
        start = F.struct(s["far"].alias("far"), F.array().cast(f"array<{_TOLD}>").alias("done")).cast(inner)
        scanned = F.aggregate(F.slice(found, k * block + 1, F.lit(block)), start, one)
        return _let(scanned, lambda r: F.struct(r["far"].alias("far"), F.concat(s["done"], F.array(r["done"])).alias("done")).cast(state))

    zero = F.struct(F.array(*[F.lit(0)] * levels).alias("far"), F.array().cast(f"array<array<{_TOLD}>>").alias("done")).cast(state)
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(blocks, zero, some)["done"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: id, n_words, base (array<struct<start, stop, label>>) and detections
    (array<struct<start, stop, priority, label, rule, kept>>, by start; places in words, suppressed ones not kept)."""
    rules = license_rules.rules() if rules is None else rules
    keywords = F.array(*[F.lit(k) for k in sorted({k for _, _, k, _ in rules})])
    norm = F.col("_norm")
    # What a lambda reads is a column of an earlier select and is mentioned there more than once, so that the optimizer
    # does not copy its computation into the lambda.
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    rows = rows.select(
        "_id", "_norm", (F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1).cast("bigint").alias("n_words"),
        _base(norm).alias("base"), F.filter(keywords, lambda k: F.contains(norm, k)).alias("_keys"))
    able = F.when(F.size("_keys") > 0, F.filter(_table(rules), lambda r: F.array_contains(F.col("_keys"), r["keyword"]) & F.regexp_like(norm, r["regex"])))
    rows = rows.select("_id", "_norm", "n_words", "base", able.alias("_able"))
    found = F.when(F.size("_able") > 0, F.sort_array(F.flatten(F.transform("_able", lambda r: _detections(norm, r)))))
    rows = rows.select("_id", "n_words", "base", F.coalesce(found, F.array().cast(_FOUND)).alias("_found"))
    judged = _judged(F.col("_found"), 1 + max((p for _, p, _, _ in rules), default=0), block)
    nothing = F.array().cast(f"array<{_TOLD}>")
    return rows.select(F.col("_id").alias(id_col), "n_words", "base", F.coalesce(judged, nothing).alias("detections"))


def labels_of(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_base, first_word, last_word (of base detections), base_labels, labels (both distinct, sorted, joined
    by commas) and score: the best evidence that is kept."""
    base, kept = F.col("base"), F.col("_kept")
    rows = scanned.select(id_col, "n_words", "base", F.filter("detections", lambda d: d["kept"]).alias("_kept"))
    worth = F.array(*[F.lit(license_rules.EVIDENCE[p]) for p in sorted(license_rules.EVIDENCE)])
    best = F.array_max(F.transform(kept, lambda d: F.get(worth, d["priority"])))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        id_col, "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.get(base, 0)["start"].cast("bigint").alias("first_word"), F.get(base, F.size(base) - 1)["start"].cast("bigint").alias("last_word"),
        joined(base["label"]).alias("base_labels"), joined(F.concat(base["label"], kept["label"])).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
