"""Plain Python versions of the operators, for small inputs."""

import collections
import math
import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall(text or "")


def deduped(docs, width=13):
    """(words, kept words) by id; docs are (id, text)."""
    first = {}
    for i, text in docs:
        own = words(text)
        for j in range(len(own) - width + 1):
            key = tuple(own[j : j + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        own = words(text)
        stays = [True] * len(own)
        for j in range(len(own) - width + 1):
            if first[tuple(own[j : j + width])] < i:
                stays[j : j + width] = [False] * width
        out.append((i, len(own), [w for w, s in zip(own, stays) if s]))
    return out


def shingles(text, n):
    own = words((text or "").translate(LOWER))
    if not own:
        return set()
    return {tuple(own[j : j + n]) for j in range(len(own) - n + 1)} if len(own) >= n else {tuple(own)}


def jaccard_components(docs, n, num, den):
    sets = {i: shingles(text, n) for i, text in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if j < i and both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}
