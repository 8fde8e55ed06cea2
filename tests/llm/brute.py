"""Slow and plain versions of what the operators compute, for comparison."""

import re
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=4):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(rows, k=4, percent=85):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


class PlainEncoder:
    """Segments each unit by a table over its characters."""

    def __init__(self, v, unit):
        self.v, self.unit, self.known, self.by = v, unit, {}, {}
        special = set(v.byte_id.tolist())
        for i, b in enumerate(v.bytes_of):
            if b and i not in special:
                self.by.setdefault(b.replace(b" ", b"\xff"), i)

    def tokens(self, unit):
        v, by, text = self.v, self.by, unit.decode("utf-8", "surrogateescape")
        raw = [c.encode("utf-8", "surrogateescape") for c in text]
        best, way = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + 24) + 1):
                number = by.get(b"".join(raw[i:j]))
                if number is not None and best[i] + v.scores[number] > best[j]:
                    best[j], way[j] = best[i] + v.scores[number], (i, [number])
            if raw[i] not in by and best[i] + v.unknown_score > best[i + 1]:
                best[i + 1], way[i + 1] = best[i] + v.unknown_score, (i, [int(v.byte_id[c]) for c in raw[i]])
        out, at = [], len(text)
        while at:
            at, some = way[at]
            out[:0] = some
        return out

    def encode(self, text):
        out = []
        for n, part in enumerate((" " * bool(self.v.prefix and text) + text).split("\u2581")):
            out += [int(self.v.byte_id[c]) for c in "\u2581".encode()] * (n > 0)
            for m in self.unit.finditer(part.encode().replace(b" ", b"\xff")):
                if m[0] not in self.known:
                    self.known[m[0]] = self.tokens(m[0])
                out += self.known[m[0]]
        return out
