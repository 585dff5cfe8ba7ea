"""Monotone matching of whole labels: the registered query and the blocks of rows against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest

from lexloom.operators import alignment
from lexloom.plans import registry


def whole_table(sim):
    """The matching by the full table, cell by cell; as many rows as columns at least."""
    n, m = sim.shape
    best = np.full((n, m), -np.inf)
    best[0, 0] = sim[0, 0]
    for i in range(1, n):
        for j in range(m):
            best[i, j] = sim[i, j] + max(best[i - 1, j], best[i - 1, j - 1] if j else -np.inf)
    out, j = {}, m - 1
    for i in range(n - 1, -1, -1):
        out[i] = j
        if i and j and best[i - 1, j - 1] >= best[i - 1, j]:
            j -= 1
    return out


def all_paths(sim):
    """The greatest sum over every path that steps on at most one column a row and ends in the last."""
    n, m = sim.shape
    return max(sum(sim[i, sum(c[:i])] for i in range(n)) for c in itertools.product((0, 1), repeat=n - 1) if sum(c) == m - 1)


@pytest.mark.parametrize("block,cells", [(1, 1), (2, 5), (3, 1 << 22), (256, 1 << 22)])
def test_blocks_of_rows(monkeypatch, block, cells):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "CELLS", cells)
    rng = np.random.default_rng(block)
    for n, m in [(1, 1), (4, 1), (5, 5), (9, 4), (10, 7), (11, 2)]:
        sim = rng.normal(size=(n, m))
        got = alignment.monotone(sim)
        assert got == whole_table(sim)
        assert sum(sim[i, j] for i, j in got.items()) == pytest.approx(all_paths(sim))
    sim = rng.normal(size=(150, 90))
    assert alignment.monotone(sim) == whole_table(sim)
    assert alignment.monotone(np.ones((40, 13))) == whole_table(np.ones((40, 13)))
    assert alignment.monotone(np.array([[1.0, 0, 0], [0, 2, 1]])) == {0: 0, 1: 1}


def test_query_matches_whole_labels(spark, tmp_path):
    """Labels of more than 200 vectors, the longer on either side."""
    rng = np.random.default_rng(7)
    sizes = {0: 450, 1: 330, 2: 210, 3: 290, 4: 3, 5: 0}
    rows = [(label, v.tolist()) for label, n in sizes.items() for v in rng.normal(size=(n, 6))]
    pd.DataFrame({"vec_id": range(len(rows)), "embedding": [v for _, v in rows], "label": [x for x, _ in rows]}).to_parquet(tmp_path / "embeddings.parquet")
    got = registry.QUERIES["monotone_matching"](spark, str(tmp_path)).toPandas()
    want = set()
    for pair in (0, 1):
        a, b = (np.array([v for x, v in rows if x == 2 * pair + k]) for k in (0, 1))
        cos = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        want |= {(pair, i, j) for i, j in whole_table(cos).items()} if len(a) >= len(b) else {(pair, i, j) for j, i in whole_table(cos.T).items()}
    assert len(got) == len(want) == 450 + 290
    assert set(got.itertuples(index=False, name=None)) == want
