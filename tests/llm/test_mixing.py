import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import mixing


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        i = np.arange(n)
        for key in (0, 9):
            assert sorted(mixing.permuted(i, np.full(n, n), np.full(n, key))) == list(range(n))


def test_plan():
    total, q = mixing.plan({"a": 10, "b": 100}, {"a": (0.5, 2), "b": (0.4, 1), "c": (0.1, 3)})
    assert total == 36 and q == {"a": 20, "b": 16}
    total, q = mixing.plan({"a": 10, "b": 100}, {"a": (0.5, 2), "b": (0.5, 1)}, 90)
    assert q == {"a": 20, "b": 70}
    assert mixing.plan({}, {"a": (1.0, 1)}) == (0, {})


def sizes(spark):
    rows = [(i, "big" if i % 3 else "small", (i * 37) % 90 + 1) for i in range(600)] + [(1000, None, 50), (1001, "big", 0), (1002, "other", 10)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_blocks_hold_every_token_once(spark):
    b = mixing.blocks(sizes(spark), 64)
    per = {r.doc_id: r.n for r in b.groupBy("doc_id").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n")).collect()}
    want = {r.doc_id: r.tokens for r in sizes(spark).where("tokens > 0 and source is not null").collect()}
    assert per == want
    assert b.groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n")).where("n > 64").count() == 0


def test_shares_and_repeats(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("gone", 0.2, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    s = sizes(spark)
    m = mixing.mixture(mixing.blocks(s, 16).cache(), t)
    got = {r.source: r for r in mixing.shares(m, s, t).collect()}
    assert abs(got["big"].reached_share - 0.5) < 0.02 and abs(got["small"].reached_share - 0.5) < 0.02
    assert got["gone"].mixed_tokens == 0 and got["other"].mixed_tokens == 0 and got["small"].most_uses <= 2 and got["big"].most_uses == 1
    uses = m.groupBy("source", "block").agg(F.count_distinct("slot").alias("n")).groupBy("source").agg(F.max("n").alias("n")).collect()
    assert {r.source: r.n for r in uses}["small"] <= 2
    assert mixing.mixture(mixing.blocks(s.limit(0), 16), t).count() == 0


def test_token_sizes(spark):
    pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([(1, "Hello world", " A ", 3), (1, "Hello world", " A ", 3), (2, None, "B", 3), (3, "", None, 3), (4, "слово " * 5000, "a-XX", 3)], "doc_id long, text string, source string, tokens int")
    got = {r.doc_id: (r.source, r.tokens) for r in mixing.token_sizes(d, "doc_id", "text", "source").collect()}
    assert got[1][0] == "a" and got[1][1] >= 2 and got[2] == ("b", 0) and got[3] == (None, 0) and got[4][0] == "a" and got[4][1] >= 5000


def test_pieces_give_the_same_tokens():
    pytest.importorskip("public_tokenizers")
    own = mixing.encoding(mixing.TOKENIZER)
    for t in ("Мама  мыла раму, don't 12 345 и\n\n пошла   домой. " * 40, "", None, "без" * 200, "红色的地图 " * 50):
        for size in (7, 64):
            assert sum(len(own.encode_ordinary(p)) for p in mixing.pieces(t, size)) == (len(own.encode_ordinary(t)) if t else 0)
            assert "".join(mixing.pieces(t, size)) == (t or "")


def test_slots_are_full_and_repeats_even(spark):
    """All slots but perhaps a source's last hold equally many tokens; no token is used more often than allowed, and none twice more than another."""
    t = spark.createDataFrame([("big", 0.2, 1), ("small", 0.8, 5)], "source string, target_share double, max_repeats int")
    s = sizes(spark)
    m = mixing.mixture(mixing.blocks(s, 64).cache(), t)
    filled = [r.n for r in m.groupBy("slot").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n")).collect()]
    assert max(filled) == 64 and sum(n != 64 for n in filled) <= 2  # a source's last slot
    each = m.select("source", "doc_id", F.explode(F.expr("sequence(from_token, to_token - 1)")).alias("t")).groupBy("source", "doc_id", "t").count()
    uses = {r.source: (r.lo, r.hi) for r in each.groupBy("source").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).collect()}
    assert uses["big"] == (1, 1) and uses["small"][1] <= 5 and uses["small"][1] - uses["small"][0] <= 1
    got = {r.source: r.reached_share for r in mixing.shares(m, s, t).collect()}
    assert abs(got["small"] - 0.8) < 0.005


def test_sources_at_their_limit(spark):
    """A mix larger than the repeats allow: the scarce source stays at its limit, the rest goes to the others."""
    t = spark.createDataFrame([("big", 0.5, 9), ("small", 0.5, 1)], "source string, target_share double, max_repeats int")
    s = sizes(spark)
    own = {r.source: r.n for r in s.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    m = mixing.mixture(mixing.blocks(s, 64).cache(), t, 600)
    got = {r.source: r.n for r in m.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n")).collect()}
    assert got["small"] == own["small"] and got["big"] == (600 - -(-own["small"] // 64)) * 64


def test_draws():
    """Counts add up, keep to what is left and spread like a multinomial."""
    rng = np.random.default_rng(1)
    left = np.array([500, 300, 200, 0])
    counts = np.array([mixing.draw(rng, left, 100) for _ in range(400)])
    assert (counts.sum(1) == 100).all() and (counts <= left).all() and (counts[:, 3] == 0).all()
    assert abs(counts[:, 0].mean() - 50) < 1.5 and 3 < counts[:, 0].std() < 7
    assert mixing.draw(rng, np.array([3, 2]), 5).tolist() == [3, 2]


def test_a_source_smaller_than_a_block(spark):
    d = spark.createDataFrame([(1, "a", 3), (2, "b", 100)], "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("a", 0.1, 4), ("b", 0.9, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(mixing.blocks(d, 10), t)
    got = {r.source: r.n for r in m.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n")).collect()}
    assert got["a"] in (10, 12) and got["b"] >= 80
