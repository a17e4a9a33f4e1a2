"""Plain versions of the operators, for small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict


def words(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def shingles(text, k):
    w = words(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k, percent):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in ids}


def word_dedup(docs):
    """(doc_id, n_words, n_removed, kept hash) of each row."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone[i : i + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def byte_dedup(docs):
    """(doc_id, n_bytes, n_removed, n_spans, kept hash) of each row."""
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def strength(contexts, kinds):
    """a with sum over contexts of sum of a / (i + a), i below its count, equal to `kinds`; by bisection."""
    lo, hi = 1e-3, 1e7
    many = Counter(contexts)
    for _ in range(200):
        a = math.sqrt(lo * hi)
        if sum(n * sum(a / (i + a) for i in range(c)) for c, n in many.items()) < kinds:
            lo = a
        else:
            hi = a
    return lo


def lm(docs, a2=None, a3=None, fit=strength):
    """({doc_id: (held out, tokens, known, N, base, score)}, a2, a3), the automaton walked token by token."""
    start, end = "<s>", "</s>"
    one, two, three = Counter(), Counter(), Counter()
    toks = [(d, [start, *words(t, True), end]) for d, t in docs]
    for d, w in toks:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    three = Counter({k: c for k, c in three.items() if two[k[:2]] >= 2})
    n, v = sum(one.values()), len(one)
    a2 = a2 or fit(list(one.values()), len(two))
    a3 = a3 or fit([c for c in two.values() if c >= 2], len(three))
    count = {(): None, (start,): one[end], **{(w,): c for w, c in one.items()}, **{k: c for k, c in two.items() if c >= 2}}
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    arcs = {h: {} for h in count}
    for (h, w), c in two.items():
        arcs[h,][w] = (c + a2 * p1(w)) / (count[h,] + a2)
    for (g, h, w), c in three.items():
        arcs[g, h][w] = (c + a3 * arcs[h,][w]) / (count[g, h] + a3)
    fail = {h: (a2 if len(h) == 1 else a3) / (count[h] + (a2 if len(h) == 1 else a3)) for h in count if h}
    out = {}
    for d, w in toks:
        state, score = (start,) if one[end] else (), 0.0
        for x in w[1:]:
            while state and x not in arcs[state]:
                score += math.log10(fail[state])
                state = state[1:]
            score += math.log10(arcs[state][x] if state else p1(x))
            state = (*state, x)[-2:]
            while state not in count or (state and not count[state]):
                state = state[1:]
        out[d] = (zlib.crc32(str(d).encode()) % 7 == 2, len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, sum(math.log10(p1(x)) for x in w[1:]), score)
    return out, a2, a3, arcs, fail, p1, one
