"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. What lies in navigation, footers, sidebars, forms,
scripts, styles, and in containers whose class, id or role names an advert, a notice, a menu or
reader comments, is no block at all. A name is a whole word of the attribute or its last part, and where an
article or main element begins inside, it was a name of the page's layout, unless it names comments. First pass: link density, length and stop-word density make a
block good, bad or, if it is short, ambiguous. Inside an article or main element the page itself
vouches for text, so there only link density can make a block bad; in a page without any known stop word,
or mostly in other letters than Latin, length and links decide. Second pass: ambiguous blocks
inherit the label of the nearest decided neighbours, headings that of the next one.

Pages are independent: one Arrow pass, no shuffle, and a page is handled alone, whatever its length.

Defined results: a null or empty page has no text; broken markup never fails (unclosed elements end
with their container or the page; a "<" that starts no tag is text; an unclosed comment ends the page).
A page whose decided blocks are all bad has no text; one with only ambiguous blocks keeps them. Rows that
share an id are pages of their own; other columns than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES. Frequent function words of English, German, French, Spanish.
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were
which will with you
aber als am auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach
nicht noch oder sein sich sie sind so über und um von vor war was wie wir wird zu zum zur
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses
son sur un une vous
al como con del el ella ellos entre era esta este fue ha hay las lo los más me mi muy no para pero por porque se sin sobre su sus te
también todo una y yo
""".split())
# FIXED VALUES. Elements whose content is no text of the article.
DROPPED = frozenset("script style noscript template svg math canvas iframe object video audio select button form nav footer aside menu dialog head".split())
# FIXED VALUES. Elements that end a block where they begin and where they end.
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# FIXED VALUES. Words of class, id or role that name something other than the article.
ASIDE_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb
breadcrumbs footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay share
sharing social related recommended recommendations widget toolbar pagination pager search complementary contentinfo masthead copyright
comment comments commentlist disqus reply replies respond feedback discussion tagline author-bio reader-comments comment-list comment-body comment-content comments-area comments-section
""".split())
#: Those that hold even for elements that hold an article.
COMMENT_NAMES = frozenset("""
comment comments commentlist disqus reply replies respond feedback discussion comment-list comment-body comment-content comments-area comments-section
""".split())
# FIXED VALUES. Words before a name that say what an element has beside or within it, not what it is.
HAVING = frozenset("has have with without no show hide".split())

# FIXED VALUES. Those of elements that hold the article.
ARTICLE_NAMES = frozenset("article-body article-content post-content entry-content".split())

SHORT, LONG = 70, 200
MAX_LINK_DENSITY = 0.33
STOP_LOW, STOP_HIGH = 0.15, 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "linked", "heading", "inside", "label")

    def __init__(self, text: str, linked: int, heading: bool, inside: bool):
        self.text, self.linked, self.heading, self.inside, self.label = text, linked, heading, inside, ""


def _names(attrs: str) -> set[str]:
    """Words of class, id and role, and the last part of each: "site-footer" is a footer, "footer-page" and "has-footer" are not."""
    found: set[str] = set()
    for m in _NAMED.finditer(attrs):
        for value in (m[1] or m[2] or m[3] or "").lower().split():
            found.add(value)
            parts = [x for x in re.split(r"[^a-z]+", value) if x]
            if parts and not HAVING.intersection(parts[:-1]):
                found.add(parts[-1])
    return found


def blocks(page: str) -> list[Block]:
    """Blocks outside of dropped elements, in page order."""
    out: list[Block] = []
    words: list[str] = []
    linked = 0
    heading = False
    #: Open elements that matter: (name, kind) with kind drop, named (dropped for its name), article or link.
    stack: list[tuple[str, str]] = []
    counts = {"drop": 0, "named": 0, "article": 0, "link": 0}

    def flush() -> None:
        nonlocal words, linked, heading
        text = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
        if text:
            out.append(Block(text, linked, heading, counts["article"] > 0))
        words, linked, heading = [], 0, False

    def text(part: str) -> None:
        nonlocal linked
        if part and not counts["drop"] and not counts["named"]:
            words.append(part)
            if counts["link"]:
                linked += len(_SPACE.sub("", entities.unescape(part)))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            text(" ")
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    # What it holds ends with it; dropped elements are not closed by inner leftovers.
                    for _, kind in stack[k:]:
                        counts[kind] -= 1
                    del stack[k:]
                    break
            continue
        attrs = m["attrs"]
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or attrs.rstrip().endswith("/"):
            continue
        names = _names(attrs) if attrs else set()
        kind = ""
        if name == "body":
            stack, counts = [], dict.fromkeys(counts, 0)
        elif name in ("article", "main") or names & ARTICLE_NAMES:
            kind = "drop" if names & COMMENT_NAMES else "article"
        elif name in DROPPED or (name == "header" and not counts["article"]):
            kind = "drop"
        elif name != "html" and (names & COMMENT_NAMES or (attrs and _HIDDEN.search(attrs))):
            kind = "drop"
        elif name != "html" and names & ASIDE_NAMES:
            kind = "named"
        elif name == "a":
            kind = "link"
        if kind == "article" and (counts["drop"] or counts["named"]) and not any(
                k == "drop" and nm not in ("nav", "header", "head", "menu") for nm, k in stack):
            # An unclosed menu or header ends where the article begins; what was named after a part of the page holds all of it.
            stack, counts = [s for s in stack if s[1] == "article"], {"drop": 0, "named": 0, "article": counts["article"], "link": 0}
        if kind:
            stack.append((name, kind))
            counts[kind] += 1
        if name in HEADINGS:
            heading = True
    flush()
    return out


def _length(text: str) -> int:
    """Characters; an ideograph or syllable sign counts as two."""
    return len(text) + (0 if text.isascii() else sum(c >= "\u2e80" for c in text))


def _stop_words_tell(found: list[Block]) -> bool:
    """Whether the page is in a language whose stop words are known: some occur outside of links, and most of its letters
    are Latin. Elsewhere length and links decide."""
    words = [w for b in found if b.linked * 2 <= len(b.text) for w in _LETTERS.findall(b.text.lower())]
    foreign = sum(len(w) for w in words if w[0] > "\u024f")
    return any(w in STOP_WORDS for w in words) and 2 * foreign <= sum(map(len, words))


def classify(found: list[Block]) -> None:
    """Labels blocks good or bad."""
    known = _stop_words_tell(found)
    for b in found:
        size = max(len(b.text.replace(" ", "")), 1)
        density = b.linked / size
        words = _LETTERS.findall(b.text.lower())
        stop = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        if density > MAX_LINK_DENSITY:
            b.label = "bad"
        elif b.inside:
            b.label = "good" if not b.heading else "short"
        elif _length(b.text) < SHORT or b.heading:
            b.label = "bad" if b.linked else "short"
        elif not known:
            b.label = "good"
        elif stop >= STOP_HIGH or (stop >= STOP_LOW and len(b.text) >= LONG):
            b.label = "good"
        elif stop >= STOP_LOW:
            b.label = "short"
        else:
            b.label = "bad"
    decided = [i for i, b in enumerate(found) if b.label != "short"]
    if not decided:
        for b in found:
            b.label = "good"
        return
    labels = [b.label for b in found]
    last = -1
    after = iter([*decided, -1])
    coming = next(after)
    for i, b in enumerate(found):
        if i == coming:
            last, coming = i, next(after)
            continue
        left, right = last, coming
        if left < 0 or right < 0:
            b.label = labels[right if left < 0 else left]
        elif b.heading:
            b.label = labels[right]
        elif labels[left] == labels[right]:
            b.label = labels[left]
        else:
            # The nearer one; at equal distance the good one.
            b.label = labels[left] if i - left < right - i else labels[right] if right - i < i - left else "good"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rows of `pages` (id, url) with text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.record_batch({"id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()),
                                       "n_chars": pa.array(map(len, texts), pa.int64(), size=len(texts))})

    rows = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
