"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def base_counts(text):
    w = words(text)
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def quality(docs, max_documents=10, max_lost_pct=50):
    """docs: (doc_id, text, source). Verdict of each."""
    norm = lambda line: tuple(words(line, lower=True))
    key = lambda d: d if d is not None else 2**63 - 1
    holders = defaultdict(set)
    for d, text, source in docs:
        for line in (text or "").split("\n"):
            holders[source, norm(line)].add(key(d))
    out = []
    for d, text, source in docs:
        n, *_, failed = base_counts(text)
        lost = 0
        for line in (text or "").split("\n"):
            have = holders[source, norm(line)]
            if len(have) > max_documents and key(d) != min(have):
                lost += len(norm(line))
        out.append((d, lost, failed, not failed and 100 * lost <= max_lost_pct * n))
    return out


def without_boilerplate(docs, min_sites=10):
    """docs: (doc_id, text, source). The texts that stay."""
    norm = lambda line: re.sub(r"[\t\x0b\f\r ]+", " ", line).strip(" ").lower()
    sites, first = defaultdict(set), {}
    for d, text, source in docs:
        for line in (text or "").split("\n"):
            if source is not None:
                sites[norm(line)].add(source)
            if d is not None:
                first[norm(line)] = min(d, first.get(norm(line), d))
    out = []
    for d, text, _ in docs:
        if text is not None:
            stay = lambda x: not x or len(sites[x]) < min_sites or first.get(x) == d
            text = "\n".join(x for x in text.split("\n") if stay(norm(x)))
        out.append(text)
    return out


def shingles(text, size):
    w = words(text, lower=True)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near(docs, size, pct):
    """docs: (doc_id, text) with distinct ids. The smallest id that links reach, for each id."""
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def best_edits(item, text):
    """Fewest edits that make the item a run of the text (rows of the edit table with numpy)."""
    t = np.array([ord(c) for c in text], np.int64)
    row = np.zeros(len(t) + 1, np.int64)
    at = np.arange(len(t) + 1)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def contaminated(docs, items, pct=8, min_chars=20):
    norm = lambda x: " ".join((x or "").lower().split())
    out = set()
    for d, text in docs:
        text = norm(text)
        for i, item in items:
            item = norm(item)
            if len(item) >= min_chars:
                found = best_edits(item, text) <= len(item) * pct // 100
            else:
                found = item and f" {item} " in f" {text} "
            if found:
                out.add((d, i))
    return out


def segment(text, vocabulary):
    """Best total score and ids of a text, over a full table."""
    n = len(text)
    best, back = [0.0] + [None] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - vocabulary.longest), end):  # the longest last piece wins a tie
            piece = vocabulary.pieces.get(text[start:end])
            if piece is None and end - start == 1:
                piece = vocabulary.fallback(text[start]), vocabulary.unknown
            if piece is not None and (best[end] is None or best[start] + piece[1] > best[end]):
                best[end], back[end] = best[start] + piece[1], (start, piece[0])
    ids, end = [], n
    while end:
        end, found = back[end]
        ids += reversed(found) if isinstance(found, tuple) else [found]
    return best[n], ids[::-1]


def covered_words(texts, size):
    """texts: {id: text}. Of each, the words in runs of ``size`` words that occur twice."""
    w = {d: words(t, lower=True) for d, t in texts.items()}
    seen = defaultdict(int)
    for x in w.values():
        for i in range(len(x) - size + 1):
            seen[tuple(x[i : i + size])] += 1
    return {
        d: {j for i in range(len(x) - size + 1) if seen[tuple(x[i : i + size])] > 1 for j in range(i, i + size)}
        for d, x in w.items()
    }
