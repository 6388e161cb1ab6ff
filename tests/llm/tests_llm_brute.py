"""Brute-force versions shared by the tests."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def brute_dedup(rows, window=50):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def brute_print(text):
    words = re.findall(rb"[^ \t-\r]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "").encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def brute_copies(texts):
    """Least id of each group of texts with five-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = re.sub(r"[A-Z]", lambda m: m.group().lower(), t or "")
        w = WORDS.findall(w)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def brute_targets(sizes, weights, most=3):
    """Shares of all words in proportion to the weights, none above ``most`` times its size: the level at
    which the shares add up is found by halving."""
    low, high = 0.0, 4.0 * most * (sum(sizes) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(most * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < sum(sizes):
            low = mid
        else:
            high = mid
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def brute_masked(text, spans, signs):
    out, end = "", 0
    for kind, start, stop in spans:
        if start >= end:
            out += text[end:start] + signs[kind]
        end = max(end, stop)
    return out + text[end:]


def brute_profile(text, letter_vector):
    """Sum over the letter trigrams of a text (framed by blanks, anything but letters alike, the middle a letter)
    of the product of the letters' vectors, each turned by its place."""
    marks = [0, *[ord(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else 0 for c in text or ""], 0]
    grams = Counter(g for g in zip(marks, marks[1:], marks[2:], strict=False) if g[1])
    total = np.zeros(len(letter_vector(0)))
    for (a, b, c), n in grams.items():
        total += n * letter_vector(a) * np.roll(letter_vector(b), 1) * np.roll(letter_vector(c), 2)
    return total


def brute_languages(train, texts, letter_vector):
    """``(language, cosine, lead over the next)`` of each text, learned from all ``(text, language)`` of ``train``."""
    def unit(v):
        return v / (np.linalg.norm(v) or 1.0)
    sums = {}
    for text, lang in train:
        if text is not None and lang is not None:
            sums[lang] = sums.get(lang, 0) + unit(brute_profile(text, letter_vector))
    protos = {k: unit(v) for k, v in sums.items() if v.any()}
    out = []
    for text in texts:
        v = brute_profile(text, letter_vector)
        ranked = sorted(((float(unit(v) @ p), k) for k, p in protos.items()), reverse=True)
        out.append((ranked[0][1], max(ranked[0][0], 0.0), ranked[0][0] - ranked[1][0]) if v.any() else ("und", 0.0, 1.0))
    return out
