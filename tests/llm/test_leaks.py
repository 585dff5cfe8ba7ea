import random

from lexloom.llm import leaks
from lexloom.llm.leaks import words_of

VOC = [f"слово{i}" for i in range(400)]


def texts(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(VOC, k=30))) for i in range(20)]
    docs = []
    for d in range(300):
        w = rng.choices(VOC, k=80)
        if d % 3 == 0:
            it = items[rng.randrange(20)][1].split()
            k, n = rng.randrange(15), rng.choice([9, 10, 12, 15])
            part = it[k : k + n]
            if d % 2:
                part[len(part) // 2] = "иначе"
            w[20:20] = part
        docs.append((d, " ".join(w)))
    return docs, items


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t)
        for k in range(len(w) - 9):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 10]), ())}
    return out


def test_both_ways_find_what_brute_force_finds(spark, monkeypatch):
    docs, items = texts(5)
    rows = [*docs, docs[0], (900, None), (901, ""), (902, "коротко"), (None, items[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", leaks.F.lit(1))
    i = spark.createDataFrame([*items, items[0], (77, None)], "item_id long, text string")
    for limit in (10**6, 0):
        monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", limit)
        found = leaks.leaks(d, "doc_id", "text", i, "item_id", "text")
        rows_ = found.collect()
        assert {(r.doc_id, r.item_id) for r in rows_ if r.edits == 0} == brute(docs, items)
    assert any(r.edits > 0 for r in rows_)
    assert leaks.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leaks.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_words():
    assert words_of("**Сло-\nво**, _ЁЛКА_ — «тe­кст» №5") == words_of("слово елка текст 5")
    assert words_of(None) == []


def test_near_windows_mostly_collide():
    """One changed word of ten: the share that some walk still finds."""
    import numpy as np

    rng, hit = random.Random(2), 0
    for _ in range(300):
        a = rng.choices(VOC, k=10)
        b = list(a)
        b[rng.randrange(10)] = "другое"
        keys = [leaks.window_keys(leaks._symbols(x), np.array([0])) for x in (a, b)]
        hit += any(x[0] == y[0] for x, y in zip(*keys))
    assert hit / 300 > 0.3


def test_long_texts_in_pieces(spark, monkeypatch):
    docs, items = texts(9)
    long = [(d, " ".join(t for _, t in docs[3 * d : 3 * d + 40])) for d in range(30)]
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(long, "doc_id long, text string")
    whole = {(r.doc_id, r.item_id): (r.windows, r.edits) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert {k for k, v in whole.items() if v[1] == 0} == brute(long, items)
    for t in (long[0][1], "слово " * 300, "", None):
        for size in (150, 700):
            monkeypatch.setattr(leaks, "PIECE", size)
            got = [tuple(w[k : k + 10]) for w, skip in leaks._pieces(t) for k in range(skip, len(w) - 9)]
            w = words_of(t)
            assert got == [tuple(w[k : k + 10]) for k in range(len(w) - 9)]
