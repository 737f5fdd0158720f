"""Intervals and chains against plain loops."""

from __future__ import annotations

import random

import pytest

from oreweave.operators import islands as isl


@pytest.mark.parametrize("share", [0.3, 1.0])
def test_interval_anti(spark, share):
    r = random.Random(6)
    span = lambda: (r.randrange(3), *sorted((r.randrange(30), r.randrange(30))))
    rows, others = [(i, *span()) for i in range(80)], [span() for _ in range(9)]
    got = isl.interval_anti(spark.createDataFrame(rows, "i int, f int, s int, e int"), spark.createDataFrame(others, "f int, s int, e int"), ["f"], "s", "e", share)
    over = lambda s, e, a, b: min(e, b) - max(s, a)
    want = [x for x in rows if not any(g == x[1] and over(x[2], x[3], a, b) > 0 and over(x[2], x[3], a, b) >= share * (x[3] - x[2]) for g, a, b in others)]
    assert sorted(tuple(x[c] for c in ("i", "f", "s", "e")) for x in got.collect()) == want and 3 < len(want) < 78


@pytest.mark.parametrize("batch", [1, 4])
def test_chain_lengths(spark, batch):
    r = random.Random(7)
    long = [("a", i, i + 1) for i in range(40)]
    rows = long + [("b", 0, 5), ("b", 0, 7), ("b", 5, 9), ("b", 9, 9), ("c", 3, 1)] + [("d", s, s + r.randrange(1, 4)) for s in range(30)]
    got = {(x.p, x.s): x.length for x in isl.chain_lengths(spark.createDataFrame(rows, "p string, s int, e int"), ["p"], "s", "e", batch=batch).collect()}
    steps = {}
    for p, s, e in rows:
        if e > s:
            steps[p, s] = min(e, steps.get((p, s), e))
    for (p, s), e in steps.items():
        n = 1
        while (p, e) in steps:
            n, e = n + 1, steps[p, e]
        assert got[p, s] == n
    assert set(got) == set(steps)
