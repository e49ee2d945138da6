"""Plain Python versions of the matching operators, written from their definitions, for differential tests."""

import itertools
import math
import re
import zlib

TITLE = re.compile(r"([a-zA-Z0-9]*((\d*\.)?\d+[^0-9, ]+)[a-zA-Z0-9]*)")
VALUE = re.compile(r"^\d+\.\d+|\b\d+:\d+\b|(?<!\S)\d{3,}\s*[x]\s*\d{3,}(?!\S)")
RES = re.compile(r"(?i)(?<!\S)\d{3,}\s*[x]\s*\d{3,}(?!\S)")


def grams(s, k=3):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nlev(a, b):
    n = max(len(a), len(b))
    return lev(a, b) / n if n else 0.0


def split(w):
    return re.sub("[0-9]", "", w), re.sub("[^0-9]", "", w)


def words(t):
    return list(dict.fromkeys(m[0] for m in TITLE.findall(t)))


def weighted(a, b, strict):
    s = w = 0.0
    for x, y in itertools.product(a, b):
        (xa, xn), (ya, yn) = split(x), split(y)
        if not strict or nlev(xa, ya) > 0.5 and xn == yn:
            s += (1 - nlev(x, y)) * (len(x) + len(y))
            w += len(x) + len(y)
    return s / w if w else 0.0


def cosine(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / (math.sqrt(len(a)) * math.sqrt(len(b))) if a and b else 0.0


def title(t1, t2, p):
    c = cosine(t1, t2)
    if c > p.alpha:
        return 1.0
    w1, w2 = words(t1), words(t2)
    far = [(split(x), split(y)) for x, y in itertools.product(w1, w2) if nlev(split(x)[0], split(y)[0]) > p.threshold]
    if any(x[1] != y[1] for x, y in far):
        return -1.0
    s = p.beta * c + (1 - p.beta) * weighted(w1, w2, False)
    return p.delta * weighted(w1, w2, True) + (1 - p.delta) * s if far else s


def brand(fs):
    return next((v.lower() for k, v in fs if k == "Brand"), "na")


def resolution(fs):
    return next((m[0] for k, v in fs if "resolution" in k.lower() and (m := RES.search(v))), "NA")


def similarity(x, y, p):
    """x, y: (title, shop, [(key, value), ...])."""
    (t1, s1, f1), (t2, s2, f2) = x, y
    if s1 == s2 and s1:
        return 0.0
    for get, none in ((brand, "na"), (resolution, "NA")):
        a, b = get(f1), get(f2)
        if a != b and a != none and b != none:
            return 0.0
    rest, sim, w, m, matched = [k for k, _ in f2], 0.0, 0.0, 0, set()
    d1, d2 = dict(f1), dict(f2)
    for k1, v1 in f1:
        for k2 in rest:
            ks = jaccard(grams(k1), grams(k2))
            if ks > p.gamma:
                sim += ks * jaccard(grams(v1), grams(d2[k2]))
                w += ks
                m += 1
                matched.add(k1)
                rest.remove(k2)
                break
    mean = sim / w if w else 0.0
    mw1 = {z for k in d1 if k not in matched for z in VALUE.findall(d1[k])}
    mw2 = {z for k in rest for z in VALUE.findall(d2[k])}
    mw, ts, least = jaccard(mw1, mw2), title(t1, t2, p), max(1, min(len(f1), len(f2)))
    if ts == -1:
        return m / least * mean + (1 - m / least) * mw
    a = (1 - p.mu) * m / least
    return a * mean + (1 - p.mu - a) * mw + p.mu * ts


def signature(features, pairs):
    if not features:
        return [-1] * len(pairs)
    xs = [zlib.crc32(f.encode()) for f in features]
    return [min((a * x + b) % 4294967295 for x in xs) for a, b in pairs]


def upgma(ids, dist, epsilon):
    """Average linkage by definition: mean of all pairwise distances, ties by (distance, smallest members)."""
    groups = [frozenset([i]) for i in ids]
    d = lambda i, j: dist.get((min(i, j), max(i, j)), 1.0)
    while True:
        best = min(((sum(d(i, j) for i in a for j in b) / (len(a) * len(b)), min(a), min(b), a, b) for a, b in itertools.combinations(sorted(groups, key=min), 2)), key=lambda t: t[:3], default=None)
        if best is None or best[0] >= epsilon - 1e-12:
            return {frozenset(g) for g in groups}
        groups = [g for g in groups if g not in best[3:]] + [best[3] | best[4]]
