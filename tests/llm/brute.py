"""Plain versions of the operators, over lists."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD))


def shingles(text: str) -> list[tuple]:
    w = words(text)
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def near(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int, bool]]:
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    post = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            post[g].add(i)
    for i, s in sets.items():
        for j in {j for g in s for j in post[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def repeats(rows: list[tuple[int, str]], size: int = 50) -> dict[int, tuple]:
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        m = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen.get(b[s : s + size], i) < i:
                m[s : s + size] = b"\1" * size
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out[i] = (len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest())
        for s in range(len(b) - size + 1):
            seen.setdefault(b[s : s + size], i)
    return out


def weighted(a: list, b: list) -> float:
    x, y = Counter(a), Counter(b)
    least = sum(min(n, y[g]) for g, n in x.items())
    return least / (len(a) + len(b) - least)


def leaks(rows: list[tuple[int, str]], items: list[tuple[int, str]]) -> dict[tuple[int, int], float]:
    """The best similarity of an item with a window of as many words, 0.75 or more."""
    out = {}
    for i, t in rows:
        w = words(t)
        sh = shingles(t)
        for k, x in items:
            want, n = shingles(x), len(words(x))
            if not n or not w:
                continue
            if n < 5:
                hit = any(tuple(w[s : s + n]) == want[0] for s in range(len(w) - n + 1))
                best = 1.0 if hit else 0.0
            elif len(w) < 5:
                best = 0.0
            else:
                width = min(n - 4, len(sh))
                own = set(want)
                best = max((weighted(sh[s : s + width], want) for s in range(len(sh) - width + 1) if own & set(sh[s : s + width])), default=0.0)
            if best >= 0.75:
                out[i, k] = best
    return out


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each piece: of all bins that fit and hold neither its source nor its cluster, the fullest; the oldest of equals."""
    bins: list[list] = []
    out = []
    for n, source, cluster in pieces:
        fit = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and not (source is not None and source in b[1]) and not (cluster is not None and cluster in b[2])]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= n
        bins[k][1].add(source)
        bins[k][2].add(cluster)
        out.append(k)
    return out


def licenses(text: str, phrases: dict[str, str]) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(FOLD))
    at, labels = [], set()
    for p, label in phrases.items():
        q = p.split()
        hits = [k for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def scan(text: str, phrases: dict[str, str], templates: dict[str, str], cover: float, gap: int) -> tuple:
    """labels and score: templates whose four-word grams stand in the text, by diagonals no more than `gap` apart."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(FOLD))
    w = split(text)
    base = licenses(text, phrases)
    labels, score = {x for x in base[4].split(",") if x}, 1.0 if base[1] else 0.0
    for label, template in templates.items():
        t = split(template)
        grams = [tuple(t[q : q + 4]) for q in range(len(t) - 3)]
        votes = sorted((p - q, q) for p in range(len(w) - 3) for q, g in enumerate(grams) if tuple(w[p : p + 4]) == g)
        at = 0
        for k in range(1, len(votes) + 1):
            if k == len(votes) or votes[k][0] - votes[k - 1][0] > gap:
                share = len({q for _, q in votes[at:k]}) / len(grams)
                score = max(score, share)
                labels |= {label} if share >= cover else set()
                at = k
    return ",".join(sorted(labels)), score


def importance(rows: list[tuple[int, str]], good: set[int], bucket, smoothing: float, z: float) -> dict[int, float]:
    """Log weights by words and pairs, each document's own counts left out."""
    own = {i: Counter(bucket(g) for n in (1, 2) for g in zip(*(words(t)[k:] for k in range(n)), strict=False)) for i, t in rows}
    raw, target = Counter(), Counter()
    for i, c in own.items():
        raw.update(c)
        target.update(c if i in good else {})
    share = sum(target.values()) / sum(raw.values())
    out = {}
    for i, c in own.items():
        out[i] = 0.0
        for g, n in c.items():
            t, e = target[g] - n * (i in good), share * (raw[g] - n)
            if abs(t - e) > z * math.sqrt(e + 1):
                out[i] += n * math.log((t + smoothing) / (e + smoothing))
    return out
