"""Greedy packing in parallel against a plain loop."""

import random

import pytest

from lexloom.operators import packing
from lexloom.operators.packing import packs


def brute(rows, size, over):
    out, state = {}, {}
    for g, o, u in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        no, fill = state.get(g, (0, None))
        if fill is not None and (fill >= size if over else fill + u >= size):
            no, fill = no + 1, None
        state[g] = no, (fill or 0) + u
        out[g, o] = no
    return out


@pytest.mark.parametrize("over", [False, True])
@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
@pytest.mark.parametrize("block", [16, 1 << 16])
def test_against_a_loop(spark, monkeypatch, over, size, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = random.Random(size)
    rows = [(g, o, rng.choice([1, 2, 3, 5, 9, 60])) for g, n in (("hot", 700), ("b", 40), ("c", 1), (None, 30)) for o in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, u int").repartition(3)
    got = {(r.g, r.o): r.pack for r in packs(df, "g", "o", "u", size, over).collect()}
    assert got == brute(rows, size, over)


def test_empty_and_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 0)], "g string, o int, u int")
    assert {(r.o, r.pack) for r in packs(df, "g", "o", "u", 5).collect()} == {(1, 0), (2, 0)}
    assert packs(df.limit(0), "g", "o", "u", 5).count() == 0
