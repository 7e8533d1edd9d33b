"""License scan against a plain version that compares all detections with each other."""

import random
import re
from re import _parser as parser

import pytest

from threadloom.llm import license_rules, licenses

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in GAP.split(lower) if w]


def brute(text, rules):
    """n_words, base places (start, stop, label), detections (start, stop, priority, label, rule, kept)."""
    w = words(text)
    base = sorted((k, k + len(p.split()), label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    norm, found = " " + "".join(x + " " for x in w), []
    for nth, (label, priority, _, regex) in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{regex})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, priority, label, nth))
    out = []
    for d in found:
        s, e, p, _, nth = d
        kept = not any(
            c != d and c[0] <= s and c[1] >= e and (c[2] > p or (c[2] == p and ((c[0], c[1]) != (s, e) or c[4] < nth))) for c in found)
        out.append((*d, kept))
    return len(w), base, sorted(out, key=lambda d: (d[0], -d[1], -d[2], d[4]))


def digest(text, rules):
    n, base, found = brute(text, rules)
    own, more = {b[2] for b in base}, {d[3] for d in found if d[-1]}
    score = 1.0 if base else max((license_rules.EVIDENCE[d[2]] for d in found if d[-1]), default=0.0)
    return (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | more)), score)


def example(regex, rng):
    """A text the pattern matches."""

    def write(tree):
        out = ""
        for op, arg in tree:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                out += chr(rng.choice([a for o, a in arg if str(o) == "LITERAL"] or [ord("q")]))
            elif kind == "NOT_LITERAL":
                out += "q"
            elif kind == "BRANCH":
                out += write(rng.choice(arg[1]))
            elif kind == "SUBPATTERN":
                out += write(arg[-1])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += "".join(write(inner) for _ in range(rng.randint(low, min(high, low + 2))))
            else:
                raise AssertionError(kind)
        return out

    return write(parser.parse(regex))


def test_keywords_occur_in_what_their_rules_match():
    rng, rules = random.Random(1), license_rules.rules()
    assert len(rules) > 300 and len(set(rules)) == len(rules)
    assert len(license_rules.TAGS) + len(license_rules.SIGNATURES) < len(rules)
    for label, _, keyword, regex in rules:
        for _ in range(12):
            text = example(regex, rng)
            assert " ".join(words(text)) == text and keyword in f" {text} ", (label, keyword, text)


def test_base_is_as_agreed():
    assert license_rules.BASE == BASE


@pytest.fixture(scope="module")
def texts(odd_texts):
    rng, rules = random.Random(5), license_rules.rules()
    out = list(odd_texts)
    for _ in range(120):
        parts = []
        for _ in range(rng.choice([1, 2, 5])):
            parts.append(example(rng.choice(rules)[3], rng))
            parts.append(rng.choice(["", "lorem ipsum", "or any later version", "under the", "version 2", "licensed", "été 日本"]))
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts)), rng.choice(list(BASE)))
        text = " ".join(parts)
        out.append(text.title() if rng.random() < 0.3 else re.sub(" ", lambda _: rng.choice([" ", " ", ", ", "\n", "-", "\x01", "\x7f "]), text))
    many = " ".join(example(rng.choice(rules[-60:])[3], rng) for _ in range(500))
    return [*out, many, "under the MIT License " * 300, "CC-BY-NC-SA 4.0 under the under the mit license.", "mit licenses cc by ncx apache license version 22"]


def test_scan(make, texts):
    rules = license_rules.rules()
    docs = make([(k, t, None) for k, t in enumerate(texts)] + [(3, texts[40], None), (None, texts[41], None)])
    # Blocks of four detections: what a block passes on to the next counts too.
    rows = licenses.scan(docs, block=4).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = [brute(t, rules) for t in ([texts[r["doc_id"]]] + ([texts[40]] if r["doc_id"] == 3 else []) if r["doc_id"] is not None else [texts[41]])]
        assert (r["n_words"], list(map(tuple, r["base"])), list(map(tuple, r["detections"]))) in want
    told = {r["doc_id"]: tuple(r)[1:] for r in licenses.labels_of(licenses.scan(docs.where("doc_id > 3"))).collect()}
    assert told == {k: digest(t, rules) for k, t in enumerate(texts) if k > 3}


def test_suppression(make):
    rules = [("short", 1, "b", "a b"), ("long", 1, "b", "a b c"), ("tag", 3, "b", "b"), ("hint", 0, "c", "c d"), ("twin", 1, "b", "a b c")]
    row = licenses.scan(make([(1, "a b c d", None)]), rules=rules).first()
    assert [(d["label"], d["kept"]) for d in row["detections"]] == [("long", True), ("twin", False), ("short", False), ("tag", True), ("hint", True)]


def test_plain_words_are_no_license(make):
    clean = ["He has a licence to drive.", "mit Freunden unter dem Baum, mit Lizenz", "The apache people; version 2 of the story.", "The commercial use of wool.", "A rail road, a boost, a vim, ruby red."]
    assert {r["labels"] for r in licenses.labels_of(licenses.scan(make([(k, t, None) for k, t in enumerate(clean)]))).collect()} == {""}


def test_empty(make):
    assert licenses.labels_of(licenses.scan(make([]))).count() == 0
