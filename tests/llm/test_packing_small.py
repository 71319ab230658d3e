"""Small pieces are packed about as tightly as by best fit, largest first."""

import random

import pytest


@pytest.mark.parametrize("kind", ["equal", "mixed", "lognormal"])
def test_small_pieces_are_best_fit(spark, kind):
    from spanlake.llm.op6_packing import place
    rng = random.Random(3)
    draw = {"equal": lambda: 69, "mixed": lambda: rng.randint(20, 128), "lognormal": lambda: min(2047, max(1, int(rng.lognormvariate(4.2, 0.5))))}[kind]
    sizes = [draw() for _ in range(4000)]
    seats = place(spark.createDataFrame(list(enumerate(sizes)), "item long, size long").repartition(3), 2048).collect()
    assert sorted(r.item for r in seats) == list(range(len(sizes)))
    full = {}
    for r in sorted(seats, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + sizes[r.item]
    assert max(full.values()) <= 2048
    gaps = []  # best fit, largest first
    for s in sorted(sizes, reverse=True):
        k = min(((g, i) for i, g in enumerate(gaps) if g >= s), default=(0, len(gaps)))[1]
        if k == len(gaps):
            gaps.append(2048)
        gaps[k] -= s
    print(kind, -(-sum(sizes) // 2048), len(gaps), len(full))
    assert len(full) <= 1.01 * len(gaps) + 1
