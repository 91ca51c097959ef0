"""Plain restatements of what the operators promise, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict


def suffix_dedup(rows, width=100):
    data = [(-(2**63) if k is None else k, zlib.crc32((t or "").encode()), (t or "").encode()) for k, t in rows]
    first = {}
    for k, tag, b in sorted(data):
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], (k, tag, i))
    out = []
    for k, tag, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (k, tag, i):
                gone[i : i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def lz_dedup(rows, width=35):
    data = [(-(2**63) if k is None else k, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for k, t in rows]
    count = defaultdict(int)
    for _, w in data:
        for i in range(len(w) - width + 1):
            count[tuple(w[i : i + width])] += 1
    out = []
    for k, w in data:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def near_duplicates(rows, threshold=0.8, size=5):
    """{row: (copy_of, class_id, n_links)} for rows (key, text)."""

    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else None)

    keys = [-(2**63) if k is None else k for k, _ in rows]
    sets = [shingles(t) for _, t in rows]
    nodes = {}
    for k, s in zip(keys, sets):
        if s:
            nodes[s] = min(k, nodes.get(s, k))
    names, links, parent = list(nodes), defaultdict(int), {s: s for s in nodes}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, s in enumerate(names):
        for t in names[:i]:
            if len(s & t) >= threshold * len(s | t) - 1e-9:
                links[s] += 1
                links[t] += 1
                parent[root(s)] = root(t)
    least = {}
    for s in names:
        least[root(s)] = min(nodes[s], least.get(root(s), nodes[s]))
    return sorted((k, nodes[s], least[root(s)], links[s]) if s else (k, k, k, 0) for k, s in zip(keys, sets))
