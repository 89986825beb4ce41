"""Plain Python versions of the operators' contracts, for small inputs.

``docs`` are (doc_id, text) pairs; results are in the order of ``docs``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=False):
    return SPACE_WORD.findall((text or "").translate(FOLD) if fold else text or "")


def shingles(text):
    w = words(text, fold=True)
    if not w:
        return frozenset()
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def repeats(docs, length=400):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(hash(d[i:i + length]) for d in data for i in range(len(d) - length + 1))
    exact = Counter()
    for d in data:
        for i in range(len(d) - length + 1):
            if seen[hash(d[i:i + length])] > 1:
                exact[hashlib.md5(d[i:i + length]).digest()] += 1
    out = []
    for (doc_id, _), d in zip(docs, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hash(d[i:i + length])] > 1 and exact[hashlib.md5(d[i:i + length]).digest()] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs, items):
    found = {}
    for item, text in items:
        w = ALNUM_WORD.findall((text or "").translate(FOLD))
        for i in range(max(1, len(w) - 12) if w else 0):
            found.setdefault(tuple(w[i:i + 13]), set()).add("" if item is None else str(item))
    sizes = sorted({len(x) for x in found})
    out = []
    for doc_id, text in docs:
        w = ALNUM_WORD.findall((text or "").translate(FOLD))
        hit, ids = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                owners = found.get(tuple(w[i:i + k]))
                if owners:
                    ids |= owners
                    hit.update(range(i, i + k))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def base_scores(docs):
    tokens = [[*words(t, fold=True), ""] for _, t in docs]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + (v + 1))) for w in t))
            for (d, _), t, h in zip(docs, tokens, held, strict=True)]


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
