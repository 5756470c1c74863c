"""Plain versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, length):
    parts = words(lower(text))
    if len(parts) < length:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[at : at + length]) for at in range(len(parts) - length + 1)}


def near_duplicates(rows, length=4, percent=80):
    """``{doc_id: (n_shingles, component_id)}`` from all pairs."""
    sets = {doc: shingles(text, length) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def top(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    docs = sorted(sets)
    for at, a in enumerate(docs):
        for b in docs[at + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {doc: (len(sets[doc]), top(doc)) for doc in docs}


def contamination(docs, items, window=10):
    """``{doc_id: (n_words, hit word places, item ids)}``."""
    found = {}
    for doc, text in docs:
        parts = NORMAL_WORD.findall(lower(text))
        hit, ids = set(), set()
        for item, question in items:
            own = NORMAL_WORD.findall(lower(question))
            size = min(window, len(own))
            for at in range(len(own) - size + 1) if size else ():
                for place in range(len(parts) - size + 1):
                    if parts[place : place + size] == own[at : at + size]:
                        hit.update(range(place, place + size))
                        if item is not None:
                            ids.add(str(item))
        found[doc] = (len(parts), hit, sorted(ids))
    return found


def without_repeats(rows, length=20):
    """``{doc_id: (n_words, n_removed, kept text)}`` in the order of the ids."""
    seen, found = set(), {}
    for doc, text in sorted(rows):
        parts = words(text)
        gone = [False] * len(parts)
        for at in range(len(parts) - length + 1):
            window = tuple(parts[at : at + length])
            if window in seen:
                gone[at : at + length] = [True] * length
            seen.add(window)
        kept = [word for word, out in zip(parts, gone, strict=True) if not out]
        found[doc] = (len(parts), len(parts) - len(kept), " ".join(kept))
    return found


def components(edges):
    """``{node: smallest node of its component}``."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            node = stack.pop()
            if node not in found:
                found[node] = start
                stack.extend(near[node])
    return found


def base_quality(text):
    """The counts of the quality rules."""
    parts = words(text)
    places = defaultdict(list)
    for at in range(len(parts) - 4):
        places[tuple(parts[at : at + 5])].append(at)
    repeated = {at + k for own in places.values() if len(own) > 1 for at in own for k in range(5)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return (len(parts), sum(map(len, parts)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(repeated))


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {source: weights[at % len(weights)] for at, source in enumerate(order)}
    goal, capped, left = {}, set(), float(sum(sizes.values()))
    goal = dict.fromkeys(order, 0.0)
    while left > 1e-9:
        open_ = [source for source in order if source not in capped]
        total = sum(weight[source] for source in open_)
        if not total:
            break
        share, left = left, 0.0
        for source in open_:
            goal[source] += share * weight[source] / total
        for source in open_:
            if goal[source] > most * sizes[source]:
                left += goal[source] - most * sizes[source]
                goal[source] = float(most * sizes[source])
                capped.add(source)
    return goal
