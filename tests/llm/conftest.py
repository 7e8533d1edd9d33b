import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or return.
CLASHES = "id bigint, hash string, n bigint, key string, size bigint, kept boolean, bucket int, keep_id bigint, _text string, place int, s string, row int"


@pytest.fixture(scope="session")
def odd_texts():
    """Empty, blank, null, short, very long and odd texts."""
    rng = random.Random(7)
    return ["", None, " \t\n", "one", "One two three four", "a b c d e", "x " * 30_000, "é ß 日本 🙂 " * 9, "A B C\x1cD \x0b\x0c\r\nE", "#*$%&|<> " * 12,
            *(" ".join(rng.choice("ab cde\n fgh\n".split(" ")) for _ in range(rng.randint(1, 300))) for _ in range(20))]


@pytest.fixture(scope="session")
def copies():
    """(doc_id, text, source): prose with exact copies, near copies of several strengths and shared passages."""
    rng = random.Random(3)
    vocabulary = ["w%d" % k for k in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, docs = prose(60), []
    for k in range(60):
        docs.append(prose(rng.choice([3, 18, 40, 120, 400])))
    for k in range(25):
        w = list(docs[k])
        for _ in range(1 + len(w) // rng.choice([10, 20, 40, 80])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append(w)
    docs += [list(docs[2]) for _ in range(12)] + [docs[k][:50] + passage + docs[k][50:] for k in range(20)]
    rng.shuffle(docs)
    sources = ["b", "a", None, "Z", "é", "hot"]
    return [(d, " ".join(w).capitalize() if d % 3 else "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12)), sources[-1] if d % 3 == 0 else sources[d % 6])
            for d, w in enumerate(docs)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents frame of (doc_id, text, source) rows, with clashing extra columns."""

    def frame(rows, lang="en"):
        full = [(d, t, lang, s, len(t or ""), *[None] * len(CLASHES.split(", "))) for d, t, s in rows]
        return spark.createDataFrame(full, f"{COLUMNS}, {CLASHES}")

    return frame
