"""Near windows: everything that brute force finds, by both ways."""

import random

import numpy as np
import pytest

from lexloom.llm import leaks
from lexloom.llm.leaks import words_of

VOC = [f"слово{i}" for i in range(300)]


def edited(rng, window, kind):
    b = list(window)
    if kind == "replaced":
        b[rng.randrange(10)] = "иначе"
    elif kind == "first":
        b[0] = "иначе"
    elif kind == "two":
        for k in rng.sample(range(10), 2):
            b[k] = f"иначе{k}"
    elif kind == "moved":
        del b[rng.randrange(10)]
        b.insert(rng.randrange(10), "иначе")
    return b


def near(docs, items):
    """(document, item) -> (distinct windows of the document, fewest edits), window by window."""
    cut = lambda t: {tuple(w[k : k + 10]) for w in [words_of(t)] for k in range(len(w) - 9)}
    out = {}
    for i, t in items:
        for other in cut(t):
            for d, u in docs:
                for window in cut(u):
                    if len(set(window) & set(other)) > 4 and (e := leaks._edits(list(window), list(other))) <= 2:
                        windows, least = out.get((d, i), (set(), 9))
                        out[d, i] = (windows | {window}, min(e, least))
    return {k: (len(w), e) for k, (w, e) in out.items()}


def texts(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(VOC, k=14))) for i in range(12)]
    docs = []
    for d in range(120):
        w = rng.choices(VOC, k=16)
        k = rng.randrange(5)
        w[8:8] = edited(rng, items[d % 12][1].split()[k : k + 10], ("replaced", "first", "two", "moved", "none")[d % 5])
        docs.append((d, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_windows_share_a_covering_key(edits):
    """Windows over few words, so that words repeat; every pair within the distance must share a key."""
    rng, pairs = random.Random(edits), 0
    for _ in range(1500):
        a = rng.choices(VOC[: rng.choice([3, 300])], k=10)
        b = list(a)
        for _ in range(edits):
            b = edited(rng, b, rng.choice(["replaced", "moved", "two"]))
        if leaks._edits(a, b) <= edits:
            pairs += 1
            keys = [leaks.covering_keys(leaks._symbols(x), np.array([0]), edits) for x in (a, b)]
            assert {int(k[0]) for k in keys[0]} & {int(k[0]) for k in keys[1]}
    assert pairs > 200


@pytest.mark.parametrize("limit", [10**6, 0])
def test_near_windows_are_all_found(spark, monkeypatch, limit):
    monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", limit)
    docs, items = texts(3)
    want = near(docs, items)
    assert {e for _, e in want.values()} == {0, 1, 2} and len(want) >= 120
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {k: e for k, (_, e) in want.items()}


@pytest.mark.parametrize("piece", [1 << 20, 300])
@pytest.mark.parametrize("limit", [10**6, 0])
def test_both_ways_count_distinct_windows(spark, monkeypatch, limit, piece):
    """All columns, with passages that come twice in a document, repeated rows and two texts of one id."""
    monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", limit)
    monkeypatch.setattr(leaks, "PIECE", piece)
    docs, items = texts(4)
    twice = [(d, f"{t} {t}") for d, t in docs[:10]]
    want = near([*twice, *docs[10:]], items)
    d = spark.createDataFrame([*twice, *docs, *docs[10:30]], "doc_id long, text string").repartition(3)
    i = spark.createDataFrame([*items, *items[:3]], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.windows, r.edits) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == want
