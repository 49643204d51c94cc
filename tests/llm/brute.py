"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import numpy as np


def copies(rows):
    """Rows (doc_id, text) -> (doc_id, keep, copies)."""
    groups = {}
    for doc, text in rows:
        if doc is not None and text is not None:
            groups.setdefault(text, []).append(doc)
    return sorted((d, min(g), len(g)) for g in groups.values() for d in g if d != min(g))


def passages(rows, k):
    """Rows (doc_id, text) -> (doc_id, start, end, removed)."""
    seen = {}
    texts = {d: t.split() for d, t in rows if d is not None and t is not None}
    for d, ws in texts.items():
        for s in range(len(ws) - k + 1):
            seen.setdefault(tuple(ws[s : s + k]), []).append((d, s))
    marks = {}
    for places in seen.values():
        if len(places) > 1:
            first = min(places)
            for p in places:
                marks.setdefault((p[0], p != first), []).append(p[1])
    out = []
    for (d, later), starts in marks.items():
        begin = last = None
        for s in sorted(starts):
            if last is not None and s > last + k:
                out.append((d, begin, last + k, later))
                begin = None
            begin, last = s if begin is None else begin, s
        out.append((d, begin, last + k, later))
    return sorted(out)


def grams(text, n):
    ws = text.lower().split()
    k = min(n, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def near(rows, n, t):
    """Rows (doc_id, text) -> {(a, b): jaccard}, a < b."""
    sets = {d: grams(x, n) for d, x in rows if d is not None and x is not None}
    sets = {d: s for d, s in sets.items() if s}
    ids = sorted(sets)
    out = {}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            j = o / (len(sets[a]) + len(sets[b]) - o)
            if j >= t - 1e-12:
                out[a, b] = j
    return out


def roots(pairs):
    """Pairs -> {node: smallest node of its group}."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def packed(sizes, capacity):
    """Sum-of-squares packing with every open bin tried each time."""
    gaps, since, out = [], [], []

    def squares(values):
        return sum(values.count(g) ** 2 for g in set(values) if g)

    for now, size in enumerate(sizes):
        tries = [(squares([*gaps[:i], g - size, *gaps[i + 1 :]]), 0, g, since[i], i) for i, g in enumerate(gaps) if g >= size]
        i = min([*tries, (squares([*gaps, capacity - size]), 1, 0, 0, len(gaps))])[-1]
        if i == len(gaps):
            gaps.append(capacity)
            since.append(0)
        gaps[i] -= size
        since[i] = now
        out.append(i)
    return out


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def merges(piece, ranks):
    """Byte pairs merged lowest rank first, leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not options:
            break
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def cosines(x, t):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.triu(x @ x.T, 1)
    return set(zip(*(c.tolist() for c in np.nonzero(s >= t))))
