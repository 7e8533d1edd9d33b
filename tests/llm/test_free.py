"""The other operators against plain Python, the public library, or held-out labels."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_native import by_id
from threadloom.llm import bpe, html_text, language_id, line_dedup, mixing, near_dedup, queries, substring_dedup
from threadloom.llm.components import components
from threadloom.llm.queries import vocabulary_path

TABLES = "/root/testdata/sf0.001"


def plus(copies, odd_texts):
    return copies + [(1000 + k, t, "o") for k, t in enumerate(odd_texts)]


def test_substrings(make, copies, odd_texts):
    docs = plus(copies, odd_texts)
    for window in (20, 3):
        got = by_id(substring_dedup.dedup(make(docs), window=window), "n_words", "n_removed", "kept_sha256")
        assert got == brute.substrings(docs, window)
    wide = by_id(substring_dedup.dedup(make(docs), lanes=2), "n_words", "n_removed", "kept_sha256")
    assert wide == brute.substrings(docs, 20)


def test_substring_query_uses_wide_hashes(make, monkeypatch):
    used = []
    removals = substring_dedup.removals

    def watched(docs, id_col, text_col, window, lanes):
        used.append(lanes)
        return removals(docs, id_col, text_col, window, lanes)

    monkeypatch.setattr(substring_dedup, "removals", watched)
    monkeypatch.setattr(queries, "table", lambda *_: make([(1, "a b", None)]))
    assert queries.op3_substring_dedup(None, "").count() == 1
    assert used == [2]


def test_substring_buckets_follow_the_bytes(make, copies, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 500)
    got = by_id(substring_dedup.dedup(make(copies), lanes=2), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substrings(copies, 20)


def test_substring_rows(make):
    text = " ".join(map(str, range(30)))
    rows = substring_dedup.dedup(make([(1, text, None), (1, text, None), (2, "x " + text, None), (None, text, None), (3, None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["intervals"], r["kept_text"]) for r in rows) == sorted([
        ("1", 0, [], text), ("1", 0, [], text), ("2", 30, [[1, 31]], "x"), ("None", 0, [], text), ("3", 0, [], "")])
    assert substring_dedup.dedup(make([])).count() == 0


def test_near(make, copies, odd_texts):
    docs = plus(copies, odd_texts)
    got = by_id(near_dedup.classes(make(docs)), "n_shingles", "component_id", "kept")
    assert got == brute.near(docs)
    kept = {r["doc_id"] for r in near_dedup.survivors(make(docs)).collect()}
    assert kept == {d for d, v in got.items() if v[2]}


def test_near_rows(make):
    text = " ".join(map(str, range(50)))
    rows = near_dedup.classes(make([(4, text, None), (4, text, None), (2, text + " x", None), (None, text, None), (9, "", None)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"], r["n_shingles"]) for r in rows) == [
        ("2", 2, True, 47), ("4", 2, False, 46), ("4", 2, False, 46), ("9", 9, True, 0), ("None", None, True, 46)]
    assert near_dedup.classes(make([])).count() == 0


def test_near_one_id_with_several_texts(make):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a, None), (5, b, None), (6, a + " x", None), (7, b + " y", None), (8, "c " + b[5:].replace("b9 ", ""), None), (9, "other words", None)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.classes(make(rows)).collect()}
    assert got == {(5, 5, True), (6, 5, False), (7, 5, False), (8, 5, False), (9, 9, True)}
    assert sorted(r["doc_id"] for r in near_dedup.survivors(make(rows)).collect()) == [5, 5, 9]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 50, 50))
    x, y = (near_dedup.signature(np.concatenate([both, own]), 256) for own in (a, b))
    assert abs((x == y).mean() - 0.75) < 0.1
    rows, size = near_dedup.second_permutation(8), 1 << near_dedup.SLOT_BITS
    assert rows.shape == (size, 8) and sorted(rows[:, 7].tolist()) == list(range(size))
    assert (rows[:-1, 6] == rows[1:, 5]).all()


def test_components(spark):
    rng, g = random.Random(5), brute.Groups()
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500 + k) for k in range(1, 90)]
    for a, b in edges:
        g.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: g.find(x) for e in edges if e[0] != e[1] for x in e}


MIXED = ("size", "source_size", "target", "taken")


def test_mixing(make, copies, odd_texts):
    docs = plus(copies, odd_texts)
    got, want = by_id(mixing.mix(make(docs)), *MIXED), brute.mix(docs)
    for d, row in want.items():
        assert (got[d][0], got[d][1], got[d][3]) == (row[0], row[1], row[3]) and got[d][2] == pytest.approx(row[2])
    often = Counter(r["doc_id"] for r in mixing.mixed(make(docs)).collect())
    assert all(often[d] * row[0] == row[3] for d, row in want.items())


def test_mixing_odd(make):
    rows = mixing.mix(make([(None, None, None), (None, "a b", "s"), (1, "", "t")])).collect()
    assert len(rows) == 3 and sum(r["taken"] for r in rows) <= 6
    assert mixing.mix(make([])).count() == 0
    one = mixing.mix(make([(k, "w " * (k + 1), "s") for k in range(9)])).collect()
    assert all(r["taken"] == r["size"] and r["target"] == 45.0 for r in one)


def test_bpe(make, copies, odd_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(1)
    letters = "abAB'SsTtllrevm 12\n\t.,!?́é£Σσ<|> 日\U0001f642 \x1c\x85"
    texts = [x for _, x, _ in copies] + list(odd_texts)
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["<|endoftext|>x<|startoftext|> a<|endoftext|><", "a" * 3001, "ab" * 500, "İÏ", "don't we'll I'M", "ẛ̣ Å"]
    v = bpe.vocabulary(vocabulary_path())
    ids = bpe.encode(pa.array(texts, pa.string()), v)
    told = bpe.decode(ids, v).to_pylist()
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert ids.to_pylist() == [w.ids for w in want]
    assert told == [t.decode(w.ids, skip_special_tokens=False) for w in want]
    docs = make([(k, x, None) for k, x in enumerate(texts)])
    rows = bpe.tokenized(docs, vocabulary_path()).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == dict(enumerate(w.ids for w in want))
    import hashlib

    got = by_id(bpe.digests(docs, vocabulary_path()), "n_tokens", "ids_sha256", "decoded_sha256")
    for k, (w, d) in enumerate(zip(want, told, strict=True)):
        assert got[k] == (len(w.ids), hashlib.sha256(np.array(w.ids, dtype="<u4").tobytes()).hexdigest(), brute.sha(d))
    assert bpe.digests(make([]), vocabulary_path()).count() == 0


def test_bpe_memory(spark):
    """What a task holds beside its texts is a small multiple of them, for common words and for words of their own."""
    import tracemalloc

    rng = random.Random(3)
    common = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 4))) for _ in range(500)]
    texts = [" ".join(rng.choices(common, k=3000)) for _ in range(1800)]
    texts += [" ".join(f"{rng.getrandbits(64):x}" for _ in range(100)) for _ in range(1000)] + [None, "", "a " * 300_000]
    batch = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array([t or "" for t in texts])})
    rows, arrow, peak = [], [], []

    class Docs:
        """Runs the task of a mapInArrow here, where its memory can be seen."""

        schema = {"id": spark.range(0).schema["id"]}

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            before = pa.total_allocated_bytes()
            tracemalloc.start()
            try:
                for part in run(iter([batch])):
                    rows.append(part.num_rows)
                    arrow.append(pa.total_allocated_bytes() - before)
                peak.append(tracemalloc.get_traced_memory()[1] + max(arrow))
            finally:
                tracemalloc.stop()
            return spark.range(0)

    bpe.vocabulary(vocabulary_path())
    bpe.digests(Docs(), vocabulary_path())
    assert sum(rows) == len(texts)
    assert peak[0] < 6 * batch.nbytes


def test_language(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    model = language_id.fit(docs)
    assert set(model) == {"en", "de", "fr", "es"} and max(map(len, model.values())) <= language_id.DICT_BYTES
    rows = language_id.predict(docs, model).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r["held"]]
    assert held and sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) / len(held) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    # Labels and sources play no part in a prediction.
    blind = language_id.predict(docs.select("doc_id", "text"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in blind} == {r["doc_id"]: r["lang_pred"] for r in rows}


def test_language_odd(make):
    docs = make([(1, None, None), (2, " 12 !? ", None), (3, "the and of the", None), (None, "the and of the", None), (4, "x" * 100_000, None)], lang=None)
    assert language_id.fit(docs) == {}
    got = by_id(language_id.predict(docs, {"en": b"the and of to in", "de": b"der die das und"}), "lang_pred", "rejected")
    assert got[1][0] == got[2][0] == "und" and got[3] == ("en", False) and got[None][0] == "en"
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.predict(make([]), {"en": b"the"}).count() == 0


def test_language_against_plain_sizes(make, copies):
    import re as plain

    import zstandard

    rng = random.Random(4)
    stock = {"aa": ["ba", "be", "bi", "bo", "bu"], "bb": ["ka", "ke", "ki", "ko", "ku"], "cc": ["ba", "ke", "mi", "no", "tu"]}
    say = lambda lang, n: " ".join("".join(rng.choice(stock[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    model = {lang: say(lang, 2000).encode() for lang in stock}
    texts = [say(lang, n).title() + " 12, " for lang in stock for n in (1, 3, 40, 900)] + ["", None, "12 !", "\u0301", "12 \u20dd", "q", "ba ka 7"]
    got = by_id(language_id.predict(make([(k, t, None) for k, t in enumerate(texts * 2)]), model), "lang_pred", "margin")
    for k, text in enumerate(texts * 2):
        lettered = "".join(c for c in plain.sub(r"[^a-zA-Z\u0300-\u0303]+", " ", text or "").lower()).strip() if plain.search("[a-zA-Z]", text or "") else ""
        raw, sizes = lettered.encode(), {}
        for lang, content in sorted(model.items()):
            size = 0
            for a in range(0, len(raw), language_id.BLOCK_BYTES):
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=language_id.SEARCH)
                size += len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=language_id.SEARCH).compress(raw[a : a + language_id.BLOCK_BYTES]))
            sizes[lang] = size
        want = min(sorted(sizes), key=sizes.get) if raw else "und"
        assert got[k][0] == want, (text, sizes)
        if raw:
            first, second = sorted(sizes.values())[:2]
            assert got[k][1] == pytest.approx((second - first) / second)


def test_language_pieces_are_spread(spark, make):
    text = "".join(chr(ord("a") + k // 100) * 99 + " " for k in range(0, 2600, 100))
    frame = spark.createDataFrame([(text,), ("short",), ("",)], "t string").select(language_id.spread(F.col("t"), F.lit(200)).alias("s"))
    cut, short, empty = [r["s"] for r in frame.collect()]
    assert len(cut) == 203 and cut.startswith("aaa") and cut.endswith("zzz ") and {"i", "r"} <= set(cut) and (short, empty) == ("short", "")
    ids = [d for d in range(40) if zlib.crc32(str(d).encode()) % 5]
    docs = make([(d, text, None) for d in ids] + [(ids[0], "wwww " * 400, None)] * 9, lang="xx")
    model = language_id.fit(docs, per_language=10, dict_bytes=4000)
    assert set(model) == {"xx"} and len(model["xx"]) <= 4000 and b"zzz" in model["xx"] and b"aaa" in model["xx"]


PROSE = "The cat is on the mat and it is a very good cat that sits with the dog in the garden of the house."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("a < b <p>x", "a < b\nx"), ("<p>un<b>closed<p>two <!-- c", "unclosed\ntwo"),
    (f"<div class='sidebar'>{PROSE}</div><p>{PROSE}</p><form><p>{PROSE}</form>", PROSE),
    ("<nav><a>1<article><p>In it</article>", "In it"), ('<p title="a>b">t</p><p>&amp &lt;x&gt; &#233;&nbsp;y', "t\n& <x> é y"),
    (f"<article><h1>Head</h1><p>One.</p><div class='ad'>{PROSE}</div><p>Two\n  lines</p></article><footer>{PROSE}</footer>", "Head\nOne.\nTwo lines"),
    (f"<script>var a='<p>{PROSE}</p>'</script><style>p{{}}</style><p>{PROSE}", PROSE),
    (f"<main><p>{PROSE}</p></main><section id='comments'><article><p>{PROSE}</p></article></section>", PROSE),
    (f"<p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p><a href=x>More links here</a></p><p>Tail</p>", f"{PROSE}\nShort.\n{PROSE}"),
    (f"<header><p>{PROSE}</p></header><body><p>{PROSE}</p><div hidden>{PROSE}</div>", PROSE),
])
def test_pages(page, text):
    assert html_text.main_text(page) == text


CHINESE = "\u8fd9\u662f\u4e00\u7bc7\u5173\u4e8e\u57ce\u5e02\u6cb3\u6d41\u7684\u6587\u7ae0\uff0c" * 7
GREEK = "\u03b7 \u03b3\u03ac\u03c4\u03b1 \u03ba\u03ac\u03b8\u03b5\u03c4\u03b1\u03b9 \u03c3\u03c4\u03bf \u03c7\u03b1\u03bb\u03af " * 6


@pytest.mark.parametrize(("page", "text"), [
    (f"<div>{CHINESE}</div>", CHINESE), (f"<div>{CHINESE}</div><ul><li><a href=x>\u5317\u4eac</a><li><a href=y>\u4e0a\u6d77</a></ul>", CHINESE),
    (f"<p>{GREEK}</p><div class='reader-feedback'><p>{GREEK}</p></div>", GREEK.strip()),
    (f"<p>{PROSE}</p><p>{'keyword shop price ' * 20}</p><p>{PROSE}</p>", f"{PROSE}\n{PROSE}"),
])
def test_pages_in_other_scripts(page, text):
    assert html_text.main_text(page) == text


def test_pages_rows(spark):
    long = f"<p>{PROSE}</p>" * 20_000
    rows = [(1, "u", long), (1, "u", long), (1, None, None), (None, "v", f"<p>{PROSE}</p>")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, id int")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in html_text.extract(frame).collect()), key=repr)
    n = 20_000 * (len(PROSE) + 1) - 1
    assert got == sorted([(1, "u", n), (1, "u", n), (1, None, 0), (None, "v", len(PROSE))], key=repr)
    assert html_text.extract(frame.where("page_id = 7")).count() == 0


def test_second_pass_against_plain_search():
    """Short blocks against a search to both sides of each for the nearest decided one."""
    rng, P = random.Random(8), PROSE
    kinds = {"good": f"<p>{P * 3}</p>", "bad": f"<p><a href=x>{'link text ' * 9}</a></p>", "short": "<p>Tail</p>", "head": "<h2>Head</h2>"}
    for _ in range(300):
        row = [rng.choice(list(kinds)) for _ in range(rng.randint(1, 12))]
        want = []
        for i, k in enumerate(row):
            left = next((j for j in range(i - 1, -1, -1) if row[j] in ("good", "bad")), None)
            right = next((j for j in range(i + 1, len(row)) if row[j] in ("good", "bad")), None)
            if k in ("good", "bad"):
                want.append(k)
            elif left is None and right is None:
                want.append("good")
            elif left is None or right is None:
                want.append(row[right if left is None else left])
            elif k == "head":
                want.append(row[right])
            else:
                near = [row[j] for j in (left, right) if abs(j - i) == min(i - left, right - i)]
                want.append("good" if "good" in near else "bad")
        page = "".join(kinds[k] for k in row)
        found = html_text.blocks(page)
        html_text.classify(found)
        assert [b.label for b in found] == want, row


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='layout has-sidebar'><article><p>{PROSE}</p></article><div class='sidebar'>{PROSE}</div></div>", PROSE),
    (f"<div class='layout has-sidebar'><p>{PROSE}</p></div>", PROSE),
    (f"<div id='page-with-nav'><main><p>{PROSE}</p></main></div>", PROSE),
    (f"<div class='left sidebar'><p>Menu</p><main><p>{PROSE}</p></main></div>", PROSE),
    (f"<div class='sidebar-layout'><p>{PROSE}</p></div><div class='site-footer'>{PROSE}</div>", PROSE),
    (f"<main><p>{PROSE}</p></main><div class='widget'><div class='post-comments'><article><p>{PROSE}</p></article></div></div>", PROSE),
    (f"<main><p>{PROSE}</p></main><div hidden class='widget'><article><p>{PROSE}</p></article></div>", PROSE),
])
def test_pages_with_named_wrappers(page, text):
    assert html_text.main_text(page) == text


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>aé&nbsp;b</p></article>", "z"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got == {1: ("u", "aé b", 4), None: (None, "", 0)}
    assert html_text.extract(pages.where("false")).count() == 0
    whole = spark.read.parquet(f"{TABLES}/pages.parquet")
    assert html_text.extract(whole).where("n_chars > 0").count() == whole.count()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(make, copies):
    rng = random.Random(2)
    base = [" ".join(t.split()[:25]) for _, t, _ in copies[:25] if len(t.split()) > 24]
    docs = []
    for d in range(60):
        lines = []
        for x in rng.sample(base, 4):
            w = x.split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] += rng.choice("xyz")
            lines.append(rng.choice([" ".join(w), "  ".join(w).upper(), "", " "]))
        docs.append((d, "\n".join(lines), "s"))
    got = by_id(line_dedup.dedup(make(docs)), "n_lines", "removed")
    rows = [(d, k, " ".join(brute.words(x.lower()))) for d, t, _ in docs for k, x in enumerate(t.split("\n")) if brute.words(x)]
    norm = sorted({x for *_, x in rows})
    g = brute.Groups()
    links = 0
    for i, a in enumerate(norm):
        for j in range(i):
            if edits(a, norm[j]) <= 0.1 * max(len(a), len(norm[j])) + 1e-9:
                g.join(i, j)
                links += 1
    assert links > 5
    seen, want = set(), {d: [0, []] for d, *_ in docs}
    for d, k, x in sorted(rows):
        want[d][0] += 1
        if g.find(norm.index(x)) in seen:
            want[d][1].append(k)
        seen.add(g.find(norm.index(x)))
    assert {d: (n, list(r)) for d, (n, r) in got.items()} == {d: (n, r) for d, (n, r) in want.items()}


def test_lines_fit_by_counts(spark, make, monkeypatch):
    """The counts let every pair within the edit distance pass, and lines of other characters are not verified."""
    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choices("abcdefgé \U0001f642", k=rng.randint(1, 60))) * rng.choice((1, 1, 9))
        c = list(a)
        for k in sorted(rng.sample(range(len(c)), min(len(c), rng.randint(0, len(c) // 10 + 1))), reverse=True):
            c[k : k + 1] = rng.choice([[], ["x"], [c[k], "é"]])
        pairs.append((a, "".join(c)))
    facts = []
    for a, b in pairs:
        counts = line_dedup.class_counts(pa.array([a, b])).tolist()
        facts.append((*[(len(x), *y) for x, y in zip((a, b), counts, strict=True)], edits(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9)))
    one = "struct<size:int,low:bigint,high:bigint>"
    rows = spark.createDataFrame(facts, f"a {one}, b {one}, near boolean").select("near", line_dedup.fitting(F.col("a"), F.col("b"), 0.9).alias("fits")).collect()
    assert all(r["fits"] for r in rows if r["near"]) and sum(r["near"] for r in rows) > 100

    verified = []
    links = line_dedup.bucket_links

    def counted(members, facts, confirm, fits, **more):
        return links(members, facts, lambda pairs: verified.append(pairs.count()) or confirm(pairs), fits, **more)

    monkeypatch.setattr(line_dedup, "bucket_links", counted)
    head = "the quick brown fox jumps over lazy"
    docs = [(k, head + " " + x * 4 + y * 4, None) for k, (x, y) in enumerate(("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st"))]
    got = by_id(line_dedup.dedup(make([*docs, (99, docs[0][1] + "!", None)])), "removed")
    assert got == {d: ([0] if d == 99 else [],) for d in got} and sum(verified) <= 10


def test_lines_alike_by_runs():
    """No pair within the edit distance fails the counts of runs, at any length; other lines of the same letters do."""
    rng = random.Random(8)
    near = []
    for n in (*range(12), 19, 20, 63, 64, 65, 200, 1000, 40_000):
        for letters in ("ab ", "abcdefghijklmnopqrstuvwxyz \U0001f642é"):
            a = "".join(rng.choices(letters, k=n))
            for kinds in ("r", "i", "d", "rid"):
                c = list(a)
                # An insertion lengthens the line, so as many edits as the shorter one allows are within the distance.
                for k in rng.sample(range(n), n // 10):
                    c[k] = {"r": "#", "i": c[k] + "#", "d": ""}[rng.choice(kinds)]
                near += [(a, "".join(c)), ("".join(c), a)]
    check = lambda pairs: line_dedup.alike(pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), 0.9)
    kept = [p for p in near if len(p[0]) < 400 and edits(*p) > int(0.1 * max(map(len, p)) + 1e-9)]
    assert not kept and check(near).all()
    syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2)) for _ in range(60)]
    line = lambda: " ".join("".join(rng.choices(syllables, k=2)) for _ in range(100))
    assert check([(line(), line()) for _ in range(200)]).sum() == 0
    assert check([]).tolist() == []


def test_lines_verified_in_rounds(make, monkeypatch):
    """Pairs verified in several rounds give what one round gives, and few pairs of other lines get to the edit distance."""
    rng = random.Random(9)
    letters = "abcdefghijklmnop "
    base = ["".join(rng.choices(letters, k=70)).strip() for _ in range(12)]
    docs = [(d, x, None) for d, x in enumerate(y for x in base for y in (x, x[:30] + "q" + x[31:], x[:50] + x[53:]))]
    one = by_id(line_dedup.dedup(make(docs)), "removed")
    rounds = []
    cut = line_dedup.cut_lineage
    monkeypatch.setattr(line_dedup, "cut_lineage", lambda df: rounds.append(df.columns) or cut(df))
    monkeypatch.setattr(line_dedup, "PAIRS", 3)
    assert by_id(line_dedup.dedup(make(docs)), "removed") == one
    assert {d: list(r) for d, (r,) in one.items()} == {d: [0] if d % 3 else [] for d, *_ in docs}
    assert rounds.count(["a", "b"]) > line_dedup.ROUNDS


def test_line_buckets_in_packed_turns(make):
    """A turn holds half the buckets, twelve bytes each; both together give each pair of lines that shares a bucket."""
    rng = random.Random(10)
    base = ["".join(rng.choices("abcdefghijklmnop ", k=n)).strip() for n in (12, 18, 30, 41, 60, 125, 200, 300, 420, 700, 1000) for _ in range(3)]
    base = [y for x in base for y in (x, x[:5] + "q" + x[6:], x[:7] + x[8:])]
    rows = make([(d, x, None) for d, x in enumerate([*base, base[0].upper()])]).selectExpr("doc_id AS id", "text")
    norm = line_dedup.normalised(pa.array(base))[2].unique()
    short = line_dedup._short_keys(line_dedup._keys(norm)).tolist()
    at, buckets = (np.concatenate(c) for c in zip(*line_dedup.line_buckets(norm), strict=True))
    lines = {}
    for k, b in zip(at.tolist(), buckets.tolist(), strict=True):
        lines.setdefault(b, set()).add(k)
    size = [len(x) for x in norm.to_pylist()]
    want = {tuple(sorted((short[a], short[b]))) for x in lines.values() for a in x for b in x if a < b and 10 * min(size[a], size[b]) >= 9 * max(size[a], size[b])}
    packed = [line_dedup.bucket_blocks(rows, turn, 5).selectExpr("sum(length(block))").first()[0] for turn in range(2)]
    assert line_dedup.TURNS == 2 and max(packed) < 0.6 * sum(packed) and sum(packed) <= 12 * len(buckets) * 2
    got = [r for turn in range(2) for r in line_dedup.shared_buckets(rows, turn, 5).collect()]
    pairs = {(r["a"], r["b"]) for r in got if r["bucket"] is None}
    assert len(want) >= 80 and want <= pairs and all(r["a"] < r["b"] for r in got if r["bucket"] is None)
    assert line_dedup.shared_buckets(rows.where("false"), 0, 5).count() == 0


def test_lines_that_share_a_bucket_by_chance(make):
    """Lines of the same syllables share buckets, but few such pairs leave a part; all pairs of near lines do."""
    rng = random.Random(13)
    syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2)) for _ in range(25)]
    base = [" ".join("".join(rng.choices(syllables, k=2)) for _ in range(n)) for n in (18, 30, 60) for _ in range(150)]
    near = [x[:9] + "#" + x[10:] for x in base[::30]]
    rows = make([(d, x, None) for d, x in enumerate([*base, *near])]).selectExpr("doc_id AS id", "text")
    short = lambda lines: line_dedup._short_keys(line_dedup._keys(pa.array(lines))).tolist()
    want = {tuple(sorted(p)) for p in zip(short(base[::30]), short(near), strict=True)}
    got = [(r["a"], r["b"]) for turn in range(2) for r in line_dedup.shared_buckets(rows, turn, 5).collect()]
    assert want <= set(got) and len(got) <= 10 * len(want)


def test_lines_in_ranges_and_turns(make, monkeypatch):
    """Shares cut into ranges of values, made in several turns, give the same groups; a turn holds a part of the bytes."""
    rng = random.Random(14)
    base = ["".join(rng.choices("abcdefghijklmnop ", k=n)).strip() for n in (12, 16, 30, 90, 150, 300, 500) for _ in range(4)]
    docs = [(d, y, None) for d, y in enumerate(y for x in base for y in (x, x[:5] + "q" + x[6:], x[:7] + x[8:]))]
    one = by_id(line_dedup.dedup(make(docs)), "removed")
    plans = []
    planned = line_dedup.planned
    monkeypatch.setattr(line_dedup, "planned", lambda nodes: plans.append(planned(nodes)) or plans[-1])
    monkeypatch.setattr(line_dedup, "PART_ROWS", 8)
    monkeypatch.setattr(line_dedup, "TURN_BYTES", 1 << 13)
    assert by_id(line_dedup.dedup(make(docs)), "removed") == one
    assert {d: list(r) for d, (r,) in one.items()} == {d: [0] if d % 3 else [] for d, *_ in docs}
    (turns, ranges), = plans
    assert turns > 2 and ranges > 1
    rows = make(docs).selectExpr("doc_id AS id", "text")
    packed = [line_dedup.bucket_blocks(rows, t, 5, turns, ranges).selectExpr("coalesce(sum(length(block)), 0)").first()[0] for t in range(turns)]
    assert max(packed) < 2 * sum(packed) / turns


def test_lines_aligned():
    """An alignment never has fewer edits than the distance, and one of edits that lie apart has as many."""
    rng = random.Random(15)
    for _ in range(300):
        a = "".join(rng.choices(rng.choice(["ab ", "abcdefghij \U0001f642é"]), k=rng.randint(0, 60)))
        b = "".join(rng.choice(["", c + "x", "#"]) if rng.random() < 0.1 else c for c in a)
        far = edits(a, b)
        assert not any(line_dedup.aligned(a, b, k) for k in range(far)), (a, b)
    line = "".join(chr(97 + k * k % 23) + chr(500 + k) for k in range(100))
    for other, far in ((line, 0), (line[:50] + "##" + line[52:], 2), (line[:20] + line[25:90] + "###" + line[90:], 8), (line[3:] + "!", 4)):
        assert line_dedup.aligned(line, other, far) and edits(line, other) == far


def test_lines_of_large_buckets(make, monkeypatch):
    """Small and larger buckets, few and many parts give the same groups."""
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefghijklmnop ", k=n)).strip() for n in (30, 90, 150, 300)]
    docs = []
    for x in base:
        for _ in range(12):
            c = list(x)
            for k in rng.sample(range(len(c)), len(c) // 25):
                c[k] = rng.choice("rstuv")
            docs.append((len(docs), "".join(c), None))
    one = by_id(line_dedup.dedup(make(docs)), "removed")
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    monkeypatch.setattr(line_dedup, "PART_ROWS", 64)
    assert by_id(line_dedup.dedup(make(docs)), "removed") == one
    assert {d: list(r) for d, (r,) in one.items()} == {d: [0] if d % 12 else [] for d, *_ in docs}


def test_lines_within_distance(monkeypatch):
    rng = random.Random(12)
    for long in (line_dedup.LONG, 1):
        monkeypatch.setattr(line_dedup, "LONG", long)
        for _ in range(400):
            letters = rng.choice(["ab", "abcdef \U0001f642é"])
            a, b = ("".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(2))
            if rng.random() < 0.7:
                b = "".join(rng.choice(["", c, c, c, c, c + "x"]) for c in a)
            far = edits(a, b)
            assert [line_dedup.within(a, b, far + k) for k in (-1, 0, 1, 9)] == [False, True, True, True], (a, b)


def test_lines_normalised():
    texts = ["", None, " ", "a\t b\n\n  c d\r\nE  F\x0b\n\x0c\n\x1ca\u2028b \n \u0130  x\n\tq", "x", "\n", " a", "a ", "a b\n \n b", "É  é"]
    want = [(i, k, " ".join(brute.words(x.lower().replace("i\u0307", "i")))) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if brute.words(x)]
    row, number, norm = line_dedup.normalised(pa.array(texts))
    assert [*zip(row.tolist(), number.tolist(), norm.to_pylist(), strict=True)] == want
    assert len(line_dedup.normalised(pa.array(texts).slice(3, 1))[2]) == 6


def test_line_very_long_and_odd(make, odd_texts):
    long = "word " * 40_000 + "end"
    docs = [(1, long, None), (2, long + "s", None), (3, "\n".join(t or "" for t in odd_texts), None), (4, "\n".join(t or "" for t in odd_texts), None), (5, "a\u2028b\n\x1c\nA\u2028B", None)]
    got = by_id(line_dedup.dedup(make(docs)), "n_lines", "removed")
    assert got[1] == (1, []) and got[2] == (1, [0]) and got[3][0] == got[4][0] and len(got[4][1]) == got[4][0]
    assert got[5][1] == [2]


def test_line_rows(make):
    rows = line_dedup.dedup(make([(1, "A b\n\nc", None), (2, "a  B\nd\n ", None), (2, "a  B\nd\n ", None), (None, "a b", None), (3, None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], list(r["removed"]), r["kept_text"]) for r in rows) == sorted([
        ("1", 2, [], "A b\n\nc"), ("2", 2, [0], "d\n "), ("2", 2, [0], "d\n "), ("None", 1, [], "a b"), ("3", 0, [], "")])
    assert line_dedup.dedup(make([])).count() == 0


def test_lines_with_typos(make):
    """Edit similarity alone decides, at every length: short lines, bounds between kinds, lines of few different characters."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60))[:n].strip()
            for n in (9, 10, 12, 18, 19, 20, 22, 36, 40, 44, 70, 108, 120, 133, 250) for _ in range(3)] + ["-" * 90, "ab " * 50 + "c"]
    lines = []
    for x in base:
        lines.append(x)
        for most in (1, len(x) // 20, len(x) // 10):
            c = list(x)
            for k in sorted(rng.sample(range(len(c)), most), reverse=True):
                c[k : k + 1] = rng.choice([[], [rng.choice(letters)], [c[k], rng.choice(letters)]])
            lines.append("".join(c))
    docs = [(d, x, "s") for d, x in enumerate(lines)]
    norm = [" ".join(brute.words(x.lower())) for x in lines]
    g = brute.Groups()
    for i, a in enumerate(norm):
        for j in range(i):
            most = int(0.1 * max(len(a), len(norm[j])) + 1e-9)
            if a == norm[j] or (abs(len(a) - len(norm[j])) <= most and edits(a, norm[j]) <= most):
                g.join(i, j)
    want = {d for d in range(len(lines)) if g.find(d) != d}
    assert len(want) > 80
    assert {r["doc_id"] for r in line_dedup.dedup(make(docs)).where("n_removed > 0").collect()} == want
