"""Phrase collocations against a recount in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, most, cover, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    good = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = {(lang, p[i:j]) for (lang, p), wide in good.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and 100 * wide >= cover * f[lang, p[i:j]]}
    out = defaultdict(list)
    for (lang, p), a in good.items():
        if (lang, p) not in gone:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, got in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1))


def texts(seed):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "gamma", "délta", "New", "york", "city", "of", "the", "été", " x", "z\u0085"]
    rows = [(None, "en"), ("", "en"), (" \t\n.;", None), ("one", None), ("a" * 5000, "de"), ("the city of new york. " * 400, "en"),
            ("beta " * 700, None), ("same row again, same row again", "fr"), ("same row again, same row again", "fr")]
    for _ in range(200):
        words = [rng.choice(vocab[:rng.randint(2, len(vocab))]) for _ in range(rng.randint(0, 40))]
        rows.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words), rng.choice(["en", "fr", None, "und", ""])))
    return rows


@pytest.mark.parametrize("least, most, top, shard", [(5, 4, 2000, 8 << 20), (2, 4, 7, 900), (30, 2, 50, 300), (1, 3, 10 ** 6, 4000)])
def test_against_recount(spark, least, most, top, shard):
    from spanlake.llm.op11_collocations import collocations
    rows = texts(least)
    docs = spark.createDataFrame([(i % 50, *r, "clash", 1) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase string, shard int").repartition(3)
    got = collocations(docs, least, most, 80, top, shard)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, least, most, 80, top)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5


def test_empty(spark):
    from spanlake.llm.op11_collocations import collocations
    assert collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None), (2, " . ", "en")], "doc_id long, text string, lang string")).collect() == []


def test_intervals_are_the_phrases():
    """Every pair of intervals holds exactly the rotations that start with the phrase, in both orders."""
    from spanlake.llm.op11_collocations import extensions, sequence, transform
    rng = random.Random(4)
    text = "".join(rng.choice(["a ", "b ", "c ", "c. "]) for _ in range(300))
    ids, _, words, _ = sequence(pa.array([text], pa.large_string()), pa.array(["x"], pa.large_string()))
    size = np.bincount(ids)
    bwt, rbwt = transform(ids, 4), transform(ids[::-1], 4)
    start = (np.cumsum(size) - size)[1:]
    own, ahead, n, to = extensions(bwt, start, size[1:])
    t = ids.tolist()
    pairs = Counter((t[i], t[(i + 1) % len(t)]) for i in range(len(t)) if t[i] and t[(i + 1) % len(t)])
    assert sorted(n.tolist()) == sorted(pairs.values())
    r_own, r_ahead, r_n, r_to = extensions(rbwt, start, size[1:])
    forward = {int(x): (int(a), int(b)) for x, a, b in zip(to, n, start[own] + ahead)}
    assert forward == {int(start[o] + a): (int(m), int(x)) for o, a, m, x in zip(r_own, r_ahead, r_n, r_to)}


def test_long_text_is_cut_between_pieces():
    from spanlake.llm.op11_collocations import shards
    batch = pa.RecordBatch.from_pydict({"text": ["ab. " * 50, None, "x", "y" * 100, "z"], "lang": ["en", "en", None, "de", "fr"]})
    got = [(t.to_pylist(), g.to_pylist()) for t, g in shards(iter([batch]), 40)]
    assert "".join(t for ts, _ in got for t in ts if t) == "ab. " * 50 + "x" + "y" * 100 + "z"
    assert all(len(t) <= 48 or set(t) == {"y"} for ts, _ in got for t in ts if t)
    assert [g for _, gs in got for g in gs].count("de") == 1


def test_only_buckets_that_may_be_frequent_stay():
    """Counts of several tasks, packed per part, add up: every frequent bucket is found and no rare one."""
    from spanlake.llm.op11_collocations import BELOW, frequent_buckets, packed_buckets
    rng = np.random.default_rng(5)
    names = rng.integers(-2 ** 63, 2 ** 63 - 1, 20000)
    tasks = [(rng.choice(names, 6000), rng.integers(1, 6, 6000)) for _ in range(4)] + [(names[:3], np.array([10 ** 9, 2, 1]))]
    total, rows = Counter(), defaultdict(list)
    for name, n in tasks:
        for b, k in zip((name.view(np.uint64) >> BELOW).tolist(), n.tolist()):
            total[b] += k
        for part, counts in packed_buckets(name, n, 12):
            rows[part].append(counts)
    got = [b for part, own in rows.items() for b in frequent_buckets(part, own, 12).tolist()]
    assert sorted(got) == sorted(b for b, n in total.items() if n >= 12) and 0 < len(got) < len(total)
    size = sum(len(c) for part, own in rows.items() for c in own)
    assert list(packed_buckets(names[:0], np.zeros(0, np.int64), 12)) == [] and size < 40 * 24003
