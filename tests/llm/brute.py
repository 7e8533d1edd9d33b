"""Plain Python versions of the operators, for small inputs. Documents are (doc_id, text, source) tuples."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def exact(docs):
    """doc_id -> (keep_id, size, kept, sha256)."""
    groups = defaultdict(list)
    for d, t, *_ in docs:
        groups[t or ""].append(d)
    return {d: (max(own), len(own), d == max(own), sha(t)) for t, own in groups.items() for d in own}


def substrings(docs, window):
    """doc_id -> (n_words, n_removed, sha256 of the kept words)."""
    seen, out = set(), {}
    for d, t, *_ in sorted(docs, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), sha(" ".join(kept)))
    return out


def shingles(text, width=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near(docs):
    """doc_id -> (n_shingles, component_id, kept)."""
    sets, g = {d: shingles(t) for d, t, *_ in docs}, Groups()
    having = defaultdict(list)
    for d in sorted(sets):
        both = Counter(e for s in sets[d] for e in having[s])
        for e, n in both.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                g.join(d, e)
        for s in sets[d]:
            having[s].append(d)
    return {d: (len(s), g.find(d), g.find(d) == d) for d, s in sets.items()}


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    hit = {i + k for own in places.values() if len(own) > 1 for i in own for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def grams(text, buckets):
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words(text)]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42)) for a, b in zip(h, h[1:], strict=False)]
    return [((x - (1 << 64) if x >> 63 else x) % buckets) for x in h + pairs]


def quality(docs, trusted, buckets, pseudo, threshold):
    """doc_id -> (base metrics..., score, kept)."""
    raw, target = Counter(), Counter()
    for d, t, *_ in docs:
        g = grams(t, buckets)
        raw.update(g)
        if d in trusted:
            target.update(g)
    total = sum(raw.values())
    share = sum(target.values()) / total if total else 0
    out = {}
    for d, t, *_ in docs:
        g, b = grams(t, buckets), base(t)
        score = sum(math.log((target[x] + pseudo) / (raw[x] * share + pseudo)) for x in g) / len(g) if g else 0.0
        out[d] = (*b, score, not b[-1] and score >= threshold)
    return out


def mix(docs, weights=(1, 2, 3)):
    """doc_id -> (size, source_size, target, taken)."""
    size = {d: len(words(t)) for d, t, _ in docs}
    sums = Counter()
    for d, _, s in docs:
        sums[s] += size[d]
    names = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + ([None] if None in sums else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sums.values()), {}, list(names)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sums[s]]
        for s in over or free:
            target[s] = 3 * sums[s] if over else weight[s] * level
        free = [s for s in free if s not in target]
    place = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:12], 16) for d in size}
    out = {}
    for s in names:
        own = sorted((d for d, _, x in docs if x == s), key=place.get)
        epochs = int(target[s] // sums[s]) if sums[s] else 0
        rest, taken = target[s] - epochs * sums[s], 0
        open_ = True
        for d in own:
            more = open_ and (taken + size[d] <= rest or taken + size[d] - rest < rest - taken)
            open_ = open_ and taken + size[d] <= rest
            taken += size[d] * more
            out[d] = (size[d], sums[s], float(target[s]), size[d] * (epochs + more))
    return out
