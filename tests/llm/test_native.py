"""Exact dedup, sharding and quality rules against plain Python."""

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from threadloom.llm import exact_dedup, quality, sharding


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


EXACT = ("keep_id", "group_size", "kept", "text_sha256")


def test_exact(make, copies, odd_texts):
    docs = copies + [(1000 + k, t, "o") for k, t in enumerate(odd_texts * 2)]
    assert by_id(exact_dedup.exact_dedup(make(docs)), *EXACT) == brute.exact(docs)
    kept = {r["doc_id"] for r in exact_dedup.survivors(make(docs)).collect()}
    assert kept == {d for d, v in brute.exact(docs).items() if v[2]}


def test_exact_excludes_collisions(make, copies):
    weak = lambda text: (F.length(text) % 3).cast("string")
    assert by_id(exact_dedup.exact_dedup(make(copies), digest=weak), *EXACT) == brute.exact(copies)


def test_exact_odd_rows(make):
    rows = exact_dedup.exact_dedup(make([(None, "a", None), (None, "a", None), (5, "a", "s"), (5, "a", "s"), (4, "a", "s"), (6, None, "s")])).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [
        ("4", 5, 3, False), ("5", 5, 3, True), ("5", 5, 3, True), ("6", 6, 1, True), ("None", None, 1, True), ("None", None, 1, True)]
    assert exact_dedup.exact_dedup(make([])).count() == 0


def test_shards(spark, make, copies):
    names, slots = ["a", "b", "c"], 1009
    owner = sharding.fill(names, slots)
    # The plain form: each shard lists its whole preference; turns are taken slot by slot.
    import hashlib

    taken, turn = {}, 0
    lists = []
    for n in names:
        h = hashlib.md5(n.encode()).digest()
        offset, skip = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1
        lists.append([(offset + j * skip) % slots for j in range(slots)])
        assert sorted(lists[-1]) == list(range(slots))
    while len(taken) < slots:
        taken[next(s for s in lists[turn % 3] if s not in taken)] = turn % 3
        turn += 1
    assert owner == [taken[s] for s in range(slots)]
    assert max(owner.count(k) for k in range(3)) - min(owner.count(k) for k in range(3)) <= 1
    more = sharding.fill([*names, "d"], slots)
    moved = sum(names[a] != [*names, "d"][b] for a, b in zip(owner, more, strict=True))
    assert moved < 0.4 * slots
    docs = make([*copies, (None, "x", None)])
    rows = sharding.assign(docs, names, slots=slots).collect()
    assert len(rows) == len(copies) + 1 and set(docs.columns) < set(rows[0].asDict())
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % slots
        assert (r["shard_slot"], r["shard"]) == (slot, names[owner[slot]])
    assert sharding.assign(make([]), names).count() == 0
    total = sharding.manifest(sharding.assign(docs, names, slots=slots)).agg(F.sum("n_rows")).first()[0]
    assert total == len(rows)
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def test_quality(spark, make, copies, odd_texts):
    docs = copies + [(1000 + k, t, "o") for k, t in enumerate(odd_texts)]
    docs += [(2000 + k, (t + "\n") * 3 + t[:40], "o") for k, (_, t, _) in enumerate(copies[:9])]
    trusted = {d for d, *_ in docs if d % 2} | {-1}
    ids = spark.createDataFrame([(d,) for d in trusted] + [(None,)], "doc_id bigint")
    frame = make(docs)
    weights = quality.fit(frame, ids, buckets=512, pseudo=2.0)
    got = by_id(quality.judge(frame, weights, buckets=512, threshold=0.0), *COLUMNS)
    want = brute.quality(docs, trusted, 512, 2.0, 0.0)
    for d, row in want.items():
        assert got[d][:6] == row[:6], d
        assert got[d][6] == pytest.approx(row[6], abs=1e-9)
    assert len(got) == len(docs)
    kept = {r["doc_id"] for r in quality.survivors(frame, weights, buckets=512, threshold=0.0).collect()}
    assert kept == {d for d, v in got.items() if v[7]}


def test_quality_odd(spark, make):
    none = spark.createDataFrame([], "doc_id bigint")
    rows = make([(None, "w " * 25, None), (1, None, None)])
    got = {r["doc_id"]: r for r in quality.judge(rows, quality.fit(rows, none)).collect()}
    assert got[1]["base_failed"] and not got[1]["kept"] and got[1]["score"] == 0.0 and got[None]["n_words"] == 25
    empty = make([])
    assert quality.judge(empty, quality.fit(empty, none)).count() == 0


def test_quality_counts_all_trusted(spark):
    docs = spark.range(50_500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 7, F.col("id") % 11).alias("text"))
    # When every document is trusted, nothing sets them apart.
    weights = quality.fit(docs, docs.select("doc_id"), buckets=512).head()["weights"]
    assert max(map(abs, weights)) < 1e-9


def test_one_id_with_several_texts(make):
    rows = [(1, "a", None), (2, "a", None), (1, "b", None), (1, "c", None), (3, "c", None)]
    got = exact_dedup.exact_dedup(make(rows)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [
        (1, 1, 1, True), (1, 2, 2, False), (1, 3, 2, False), (2, 2, 2, True), (3, 3, 2, True)]
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.survivors(make(rows)).collect()) == [(1, "b"), (2, "a"), (3, "c")]


def test_texts_of_single_rows_do_not_move(spark, make, copies):
    plan = exact_dedup.survivors(make(copies))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
