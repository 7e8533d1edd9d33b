"""Filter interaction audit against a plain version that applies every order to every document."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import words
from threadloom.llm import filter_audit

SCHEMA = "doc_id bigint, text string, source string, id string, part bigint, mask string, n string, key int, good int, toxic int, print int"
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(docs):
    """The set of failed filters of each row."""
    out = []
    for d, t, _ in docs:
        t = t or ""
        w = words(t)
        own = {"A"} if len(w) < 200 else set()
        own |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        own |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        own |= {"E"} if d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs) else set()
        out.append(own)
    return out


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    failed, out, share = fails(docs), {}, {}
    parts = {s or "" for *_, s in docs}
    for order in permutations("ABCDE"):
        for part in parts:
            left = [(d, f) for (d, _, s), f in zip(docs, failed, strict=True) if (s or "") == part]
            everyone = list(left)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = len([r for r in everyone if f in r[1]]) - len(gone)
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), before, sum(r[1] == {f} for r in everyone), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                share[part, f] = share.get((part, f), 0) + len(gone)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels, **options):
    frame = spark.createDataFrame([(*r, *[None] * 8) for r in docs], SCHEMA).repartition(4)
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = filter_audit.report(filter_audit.masks(frame, said, **options)).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NAMES) for r in rows}


@pytest.fixture(scope="module")
def docs(odd_texts):
    rng = random.Random(11)
    prose = lambda n, k: " ".join(rng.choice("abcdefgh") + str(rng.randrange(k)) for _ in range(n))
    shared = prose(60, 50)
    texts = list(odd_texts)
    for _ in range(40):
        texts.append(rng.choice(["", "#", "SHOUT ING LOUD ", shared + " "]) + prose(rng.choice([30, 199, 200, 400]), rng.choice([8, 4000])) * rng.choice([1, 1, 2]))
    texts += [shared, shared + "x", shared[:-1], texts[30], texts[31], "hot text"] + ["hot text"] * 40
    texts += rng.sample(texts, 30)
    rng.shuffle(texts)
    rows = [(k * 3 - 20, t, rng.choice([None, "", "s", "é", "only"][: 4 + (k == 5)])) for k, t in enumerate(texts)]
    # Repeated rows, repeated ids with other texts, and rows without an id.
    return rows + rows[:3] + [(rows[4][0], "hot text", "s"), (None, "hot text", "s"), (None, None, None), (None, None, "s")]


@pytest.mark.parametrize("heavy", [1 << 25, 2000, 300])
def test_audit(spark, docs, heavy):
    labels = [(d, k % 2, k % 3 == 0) for k, (d, *_) in enumerate(docs[::2])] + [(docs[0][0], 0, 1), (None, 1, 1), (docs[1][0], None, None), (10**9, 1, 1)]
    labels = [(d, q, None if x is None else int(x)) for d, q, x in labels]
    assert run(spark, docs, labels, heavy=heavy) == brute(docs, labels)


def test_audit_empty(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    got = run(spark, [(1, None, None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_prefixes_grow_only_where_texts_share_them(spark):
    head = "h" * 100
    texts = [head + f"{k:03d} tail" for k in range(50)] + ["same " * 20] * 50 + [f"{k:03d} other text of its own" for k in range(50)]
    rows = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    keys = {bytes(r["text"]).decode(): bytes(r["key"]).decode() for r in filter_audit.prefixed(rows, heavy=1500, width=16).collect()}
    assert all(t.startswith(k) for t, k in keys.items())
    lengths = {t[0]: len(k) for t, k in keys.items()}
    assert lengths["h"] == 108 and lengths["s"] == 16 and max(len(k) for t, k in keys.items() if "other" in t) == 16


def test_trie():
    rng = random.Random(2)
    texts = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(400)} | {b"", b"\xff\x00" * 5000, b"\xff\x00" * 4999}
    trie = filter_audit.Trie()
    for t in sorted(texts, key=lambda t: rng.random()):
        node = trie.node(t)
        assert node[2] is None
        node[2] = t
    assert all(trie.node(t)[2] == t for t in texts) and sorted(trie.terminals()) == sorted(texts)
    open_ = [trie.root]
    while open_:
        node = open_.pop()
        # Compressed: an inner node without a terminal forks.
        assert node is trie.root or node[2] is not None or len(node[1]) > 1
        assert all(child[0][:1] == bytes([first]) for first, child in node[1].items())
        open_.extend(node[1].values())


def test_nothing_but_counts_leaves_the_tries(spark, docs):
    frame = spark.createDataFrame([(*r, *[None] * 8) for r in docs], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    counts = filter_audit.masks(frame, none)
    assert counts.columns == ["part", "mask", "n", "good", "toxic"] and counts.agg(F.sum("n")).first()[0] == len(docs)
