"""Plain-Python versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def words(text, low=False):
    return WORD.findall(lower(text) if low else (text or "").encode())


def components(nodes, links):
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def fingerprint(text, k=3):
    import xxhash
    w = words(text, True)
    shingles = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, k=3, bits=2):
    fp = [(i, fingerprint(t, k)) for i, t in rows]
    links = [(a, b) for a, x in fp for b, y in fp if a is not None and b is not None and bin(x ^ y).count("1") <= bits]
    comp = components({i for i, _ in fp if i is not None}, links)
    return sorted(((i, f"{x:016x}", comp.get(i)) for i, x in fp), key=str)


def substring(rows, window):
    starts = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                starts[tuple(w[k:k + window])].add(i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and min(starts[tuple(w[k:k + window])]) < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def line_dedup(rows, t=0.8):
    """Rows with distinct ids: per row its text without lines similar to an earlier line."""
    before, out = [], {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        keep = []
        for line in [] if text is None else text.split("\n"):
            s = frozenset(words(line, True))
            if s and any(len(s & o) >= t * len(s | o) - 1e-9 for o in before):
                before.append(s)
                continue
            keep.append(line)
            if s:
                before.append(s)
        out[i] = None if text is None else "\n".join(keep)
    return out


def bare_words(text):
    return [w for w in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", lower(text).decode()) if w]


def smith_waterman(item, text):
    row, best = [0] * (len(text) + 1), 0
    for a in item:
        new = [0] * (len(text) + 1)
        for j, b in enumerate(text):
            new[j + 1] = max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1)
        best, row = max(best, max(new)), new
    return best / (2 * len(item)) if item else 0.0


def ppm(train, order):
    """``f(text)``: log10 probability under PPM with escape D and exclusion, computed recursively."""
    import math
    counts = defaultdict(Counter)
    for t in train:
        s = bytes([255] * order) + lower(t) + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k:i]][s[i]] += 1

    def share(ctx):
        while ctx not in counts and ctx:
            ctx = ctx[1:]
        if ctx not in counts:
            return {a: 1 / 256 for a in range(256)}
        short = share(ctx[1:]) if ctx else {a: 1 / 256 for a in range(256)}
        c = counts[ctx]
        total, rest = sum(c.values()), sum(p for a, p in short.items() if a not in c)
        return {a: (2 * c[a] - 1) / (2 * total) if a in c else len(c) / (2 * total) * short[a] / rest for a in range(256)}

    def score(text):
        s = bytes([255] * order) + lower(text) + b"\xff"
        return sum(math.log10(share(s[i - order:i])[s[i]]) for i in range(order, len(s)))
    return score


def held(i, fold):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == fold
