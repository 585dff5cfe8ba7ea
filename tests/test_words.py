"""Stems, edit alignment, spelling and targets against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import alignment, checks, features


def test_stems_of_the_published_list(spark):
    """Samples of the published vocabulary and its stems."""
    words = dict(p.split(">") for p in "в>в вавиловка>вавиловк вагнера>вагнер вагон>вагон вагонов>вагон важная>важн важнее>важн важнейшие>важн важничал>важнича валентина>валентин валериановых>валерианов валерию>валер валетами>валет "
                 "п>п па>па пава>пав павел>павел падаль>падал падать>пада падающую>пада палкой>палк пальбой>пальб".split())  # fmt: skip
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r.word: r.stem for r in df.select("word", features.snowball(F.col("word")).alias("stem")).collect()} == words
    odd = spark.createDataFrame([(None,), ("",), ("123",), ("Ёлки",)], "word string")
    assert [r[0] for r in odd.select(features.snowball(F.col("word"))).collect()] == [None, "", "123", "елк"]


def plain_path(a, b, sim, threshold, drop_a, drop_b, change):
    n, m = len(a), len(b)

    def c(i, j):
        if a[i] == b[j]:
            return 0.0
        return min(change, max(0.0, 10 * (1 - sim[i, j]) - 1)) if sim is not None and sim[i, j] > threshold else change

    d = np.zeros((n + 1, m + 1))
    d[:, 0], d[0, :] = np.arange(n + 1) * drop_a, np.arange(m + 1) * drop_b
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j - 1] + c(i - 1, j - 1), d[i - 1, j] + drop_a, d[i, j - 1] + drop_b)
    return d[n, m]


@pytest.mark.parametrize("seed", range(60))
def test_edit_path_is_cheapest(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 25))] for _ in range(2))
    sim = np.random.default_rng(seed).random((len(a), len(b))) if seed % 2 else None
    path = alignment.edit_path(a, b, sim)
    assert [i for i, _, _ in path if i >= 0] == list(range(len(a))) and [j for _, j, _ in path if j >= 0] == list(range(len(b)))
    cost = 0.0
    for i, j, said in path:
        assert said == ("Deleted" if i < 0 or j < 0 else "Matched" if a[i] == b[j] else "Transited")
        near = sim is not None and i >= 0 and j >= 0 and sim[i, j] > 0.5
        cost += 3 if i < 0 else 1 if j < 0 else 0 if a[i] == b[j] else min(2, max(0.0, 10 * (1 - sim[i, j]) - 1)) if near else 2
    assert abs(cost - plain_path(a, b, sim, 0.5, 1, 3, 2)) < 1e-9


def test_spelling_at_two_edits(spark):
    src = spark.createDataFrame([("f", 1, "карова", "ru"), ("f", 2, "крова", "ru"), ("f", 3, "дом", "ru"), ("f", 4, "квр", "ru")], "file_id string, word_id long, word string, word_type string")
    words = spark.createDataFrame([("корова",), ("дом",), ("кров",)], "word string")
    got = {r.word_id: r.suggest for r in checks.spelling(src, words, distance=2).collect()}

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for no, bad in ((1, "карова"), (2, "крова"), (4, "квр")):
        near = sorted((far(bad, w), w) for w in ("корова", "дом", "кров") if far(bad, w) <= 2)
        assert got[no] == [w for _, w in near]
    with pytest.raises(ValueError):
        checks.spelling(src, words, distance=3)


def test_missing_model_and_relation(spark):
    src = spark.createDataFrame([("f", 1, "a")], "file_id string, word_id long, word string")
    with pytest.raises(ValueError):
        checks.alternative(src, "a", None)
    with pytest.raises(ValueError):
        checks.target_index(src, "other")
