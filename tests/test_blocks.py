"""Ranks, sums and looks back in two levels against plain windows, with ranges so small that groups have many."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.operators import relational as R


@pytest.fixture
def rows(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    rng = random.Random(4)
    at, out = -20, []
    for i in range(500):
        at += rng.choice([1, 1, 2, 5, 60])
        out.append((rng.choice(["hot", "hot", "hot", "b", None]), at, rng.choice([None, *range(0, 90, 3)]), rng.randint(0, 5)))
    return spark.createDataFrame(out, "g string, o long, v long, n int").cache()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_dense_rank(rows):
    got = R.dense_rank_in(rows, ["g"], "v", "r").select("g", "o", "r")
    same(got, rows.withColumn("r", F.dense_rank().over(Window.partitionBy("g").orderBy("v")).cast("long")).select("g", "o", "r"))


def test_running_sum(rows):
    got = R.running_sum_in(rows, ["g"], "o", F.col("n"), "s").select("g", "o", "s")
    same(got, rows.withColumn("s", F.sum("n").over(Window.partitionBy("g").orderBy("o"))).select("g", "o", "s"))


@pytest.mark.parametrize("before", [1, 3, 11])
def test_margin(rows, before):
    last = R.with_margin(rows, ["g"], "o", before).withColumn("p", F.lag("n", before).over(Window.partitionBy("g", "_block").orderBy("o"))).where("_own").select("g", "o", "p")
    same(last, rows.withColumn("p", F.lag("n", before).over(Window.partitionBy("g").orderBy("o"))).select("g", "o", "p"))


def test_empty(spark):
    df = spark.createDataFrame([], "g string, o long, v long, n int")
    assert R.dense_rank_in(df, ["g"], "v", "r").count() == 0 and R.with_margin(df, ["g"], "o", 2).count() == 0
