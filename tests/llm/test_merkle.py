"""The Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle, quality


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, arity):
    """Root, and per leaf its proof as a list of (left, right) texts."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for leaf, place in enumerate(at):
            run, slot = runs[place // arity], place % arity
            proofs[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        nodes, at = [H(*r) for r in runs], [k // arity for k in at]
    return nodes[0] if nodes else None, proofs


def brute(rows, arity, tampered=lambda doc_id: False):
    """Rows (doc_id, text, lang, source, n_chars) -> sorted result rows."""
    trees = defaultdict(list)
    for d, text, lang, source, n in rows:
        leaf = H(*map(field, (d, source, lang, n, text)))
        low = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        trees[b"" if lang is None else b":" + lang.encode()].append(((d is not None, d or 0), leaf, d, H(*map(field, (d, source, lang, n, low)))))
    low = {t: sorted(own, key=lambda r: r[:2]) for t, own in sorted(trees.items())}
    made = {t: climb([r[1] for r in own], arity) for t, own in low.items()}
    root, top = climb([made[t][0] for t in low], arity)
    out = []
    for k, (t, own) in enumerate(low.items()):
        for (_, leaf, d, other), proof in zip(own, made[t][1], strict=True):
            path = proof + top[k]
            folded = other if tampered(d) else leaf
            for left, right in path:
                folded = H(left, folded, right)
            out.append((d, leaf, made[t][0], root, H("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def run(docs, arity=8, tamper=False):
    changed = None
    if tamper:
        changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.digest(*[
            merkle.field(quality.lower_ascii(F.col(c)) if c == "text" else F.col(c)) for c in merkle.FIELDS]))
    rows = merkle.verify(merkle.manifest(docs, arity=arity, extra=changed), F.coalesce("extra", "leaf"))
    return sorted(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, tree bigint, idx string, digest bigint, path int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "x", 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_merkle(spark, odd_texts, arity):
    rng = random.Random(arity)
    # Trees of 1, arity and arity + 1 leaves, of a full level and of one more, and one with most rows.
    sizes = {"a": 1, "b": arity, "c": arity + 1, None: arity**2, "é": arity**2 + 1, "Z": 3 * arity + 2, "": 2, "hot": 150}
    langs = [lang for lang, n in sizes.items() for _ in range(n)]
    rng.shuffle(langs)
    rows = [(7 * k - 50, odd_texts[k % len(odd_texts)] if k % 2 else f"Text {k}", lang, rng.choice([None, "s", ""]), k if k % 5 else None)
            for k, lang in enumerate(langs)]
    tampered = lambda d: zlib.crc32(str(d).encode()) % 3 == 0
    got = run(frame(spark, rows).repartition(5), arity, tamper=True)
    assert got == brute(rows, arity, tampered)
    changed = {d for d, t, *_ in rows if tampered(d) and t and any("A" <= c <= "Z" for c in t)}
    assert {r[0] for r in got if not r[-1]} == changed


def test_merkle_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "b", None, None, 2), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1), (3, "X", "en", "s", 1), (1, "", "en", "s", 0)]
    assert run(frame(spark, rows)) == brute(rows, 8)
    assert run(frame(spark, rows[:1])) == brute(rows[:1], 8)
    assert run(frame(spark, [])) == []
    with pytest.raises(ValueError):
        merkle.levels(frame(spark, []), 1)


def test_merkle_finds_every_change(spark):
    rows = [(k, f"text {k}", "en" if k % 3 else "de", "s", k) for k in range(40)]
    made = merkle.manifest(frame(spark, rows))
    later = frame(spark, [(d, t, lang, "other" if d == 7 else s, None if d == 9 else n) for d, t, lang, s, n in rows])
    now = later.select("doc_id", merkle.digest(*[merkle.field(F.col(c)) for c in merkle.FIELDS]).alias("now"))
    told = merkle.verify(made.join(now, "doc_id"), F.col("now"))
    assert {r["doc_id"] for r in told.where("NOT verified").collect()} == {7, 9}
