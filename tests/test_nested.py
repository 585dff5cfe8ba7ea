from pyspark.sql import functions as F

from lexloom.operators import context, nested, relational, sampling


def test_paths_and_lists(spark):
    df = spark.createDataFrame([(1, ((2, "x"), [1, None, 5])), (2, None), (3, ((None, None), []))], "id int, o struct<a:struct<n:int,s:string>,l:array<int>>")
    assert [r.s for r in nested.by_path(df, {"s": "o.a.s"}, ["id"]).orderBy("id").collect()] == ["x", None, None]
    assert nested.flattened(df).columns == ["id", "o_a_n", "o_a_s", "o_l"]
    assert nested.prefixed(df, "p_", ["id"]).columns == ["id", "p_o"]
    r = df.select("id", *nested.list_stats(F.col("o.l"), "l")).orderBy("id").collect()
    assert (r[0].l_count, r[0].l_min, r[0].l_max, r[0].l_mean) == (2, 1, 5, 3.0) and r[2].l_count == 0 and r[2].l_mean is None


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"))
    got = relational.numbered(df.repartition(7), ["k"]).collect()
    assert all(r.k == r.number for r in got) and len(got) == 500
    assert relational.numbered(df.limit(0), ["k"]).count() == 0


def test_folds_and_times(spark):
    df = spark.createDataFrame([(i % 9, f"2020-01-{i + 1:02}") for i in range(27)], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    f = sampling.folds(df, "k", 3)
    assert f.groupBy("k").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    s = sampling.split_by_time(df, "t", ("2020-01-11", "train"), ("2020-01-21", "display"))
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 10, "display": 10, "test": 7}


def test_threshold(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True), (None, True)], "s double, p boolean")
    assert context.best_threshold(df, "s", "p").first().threshold == 0.8
