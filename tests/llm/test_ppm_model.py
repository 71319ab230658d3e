"""PPM scores at order 5 against the recursive model, where the model is deep or large."""

import math
import random

import brute
import pytest
from test_text_ops import docs

TRAIN, HELD = ([i for i in range(100) if brute.held(i, 1) == out] for out in (False, True))


def check(spark, train, held, order=5):
    from spanlake.llm.op9_ppm import scores
    rows = [*zip(TRAIN, train), *zip(HELD, held)]
    model = brute.ppm(train, order)
    got = {r.doc_id: r.score for r in scores(docs(spark, rows).repartition(3), order=order, fold=1).collect()}
    assert len(got) == len(rows)
    want = {i: model(t) for i, t in zip(HELD, held)}
    for i, w in want.items():
        assert math.isclose(got[i], w, rel_tol=1e-4), (got[i], w)
    return want


def test_rare_bytes_after_frequent_contexts(spark):
    # each shorter context is three times as frequent and goes on in another way, so all escapes add up
    train = ["abcde1" * 400, "xbcde2" * 800, "xcde3" * 2400, "xde4" * 7200, "xe5" * 21600]
    want = check(spark, train, ["abcde\x07", "abcde", "\x07\x08", ""])
    assert want[HELD[1]] < -20  # nearly all of it is the end after "abcde"


@pytest.mark.parametrize("order", [1, 2, 5])
def test_no_string_is_dropped(spark, order):
    # 30,000 letters of four scripts: nearly every string of six bytes occurs once, in far more than 24 M trie cells
    rng = random.Random(5)
    letters = [chr(c) for lo, hi in ((33, 127), (0xC0, 0x250), (0x400, 0x500), (0x4E00, 0x9FA0)) for c in range(lo, hi)]
    train = ["".join(rng.choices(letters, k=1500)) for _ in range(20)]
    check(spark, train, [train[3][100:160], train[9][:40] + train[11][-40:], "".join(rng.choices(letters, k=60)), "\x01"], order)
