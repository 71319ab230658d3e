"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, every, shortest, least, ratio):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += len(w) >= shortest
    words = {w: m for w, m in n.items() if len(w) >= shortest and m >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = [], {}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w, m in words.items():
        met = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if near(w, v)]
        best = min(met, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * m else None
        out.append((w, form[w], m, len(met), words[form[w]] if form[w] else None))
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, f, root(w), m, k, fn) for w, f, m, k, fn in out)


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcéÿ×xy") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["z" * 400, "q" * 300 + "r" * 200, "aaaaaa", "AAAAAAA"]
    rows = [(None, "Letter lettér LETTER letters"), (1, None), (2, ""), (3, " 12 .."), (4, "tie" * 20000), (4, "letter letter lettor lettor letter's")]
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 50)):
            w = rng.choice(stems[:rng.randint(1, len(stems))])
            if rng.random() < .4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abéþ") + w[k:], w[:k] + rng.choice("xyÀ") + w[k + 1:]])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return rows + rows[-10:]


@pytest.mark.parametrize("seed, every, shortest, least, ratio, size", [(1, 97, 5, 3, 2, 64 << 20), (2, 3, 2, 1, 2, 64), (3, 1, 4, 2, 3, 1 << 12)])
def test_against_plain_python(spark, seed, every, shortest, least, ratio, size):
    """Also with filters that are far too small: they let more edits through, the result stays."""
    from spanlake.llm.op13_spelling import spelling_groups
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling_groups(docs, every, shortest, least, ratio, size)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(by_hand(rows, every, shortest, least, ratio), key=str)


def test_empty(spark):
    from spanlake.llm.op13_spelling import spelling_groups
    assert spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling_groups(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []


def test_crc_of_runs():
    from spanlake.llm.op13_spelling import crc_after
    rng = random.Random(5)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 7, 255, 256, 257, 900]))) for _ in range(200)]
    size = np.array([len(p) for p in parts])
    first = [zlib.crc32(b"%d:" % i) for i in range(200)]
    got = crc_after(np.array(first, np.uint32), np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [zlib.crc32(p, c) for p, c in zip(parts, first)]


def test_every_edit_is_probed():
    """With a filter that lets all through, each pair's larger side yields the smaller side once."""
    from spanlake.llm.op13_spelling import BLOCK, LONGEST, Letters, edits, layout, spelled
    base, blocks = layout({k: 1 for k in range(LONGEST + 1)}, 1 << 20)
    told = (np.full(int(blocks.sum()) * BLOCK // 8 + 4096, 255, np.uint8), base, blocks)
    for word in ("aabbé", "ÿàzzz", "x"):
        got = [w for _, m in Letters(pa.array([word])).groups() for _, new, size in edits(m, told, 1) for w in spelled(new, size).to_pylist()]
        smaller = {word[:i] + word[i + 1:] for i in range(len(word)) if len(word) > 1}
        alphabet = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
        smaller |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in alphabet if c < word[i]}
        assert sorted(got) == sorted(smaller)
