import random

from pyspark.sql import functions as F

from lexloom.llm import groups


def union_find(nodes, edges):
    p = {n: n for n in nodes}

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        if a in p and b in p:
            p[root(a)] = root(b)
    out = {}
    for n in nodes:
        out.setdefault(root(n), set()).add(n)
    return {frozenset(s) for s in out.values()}


def found(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(edges, "a string, b string")
    out = {}
    for r in groups.components(n, e).collect():
        out.setdefault(r.component, set()).add(r.node)
    return {frozenset(s) for s in out.values()}


def test_components(spark):
    rng = random.Random(7)
    nodes = [f"n{i:03}" for i in range(150)]
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    star = [("n100", f"n{i:03}") for i in range(101, 125)]
    more = [(rng.choice(nodes[125:]), rng.choice(nodes[125:])) for _ in range(15)] + [("n001", "n001"), ("n001", "gone"), *chain[:3]]
    edges = chain + star + more
    assert found(spark, nodes, edges) == union_find(nodes, edges)
    assert found(spark, ["a"], []) == {frozenset({"a"})} and found(spark, [], []) == set()


def test_keys(spark):
    links = ["/avtor/hot/", "avtor/HOT", "https://proza.example/avtor/hot", "http://www.proza.example/avtor/Hot/", "/avtor/hot?ref=top2", " /avtor/hot#books ", "proza.example/avtor/hot"]
    empty = ["/avtor/", "", "-", "unknown", None, "/avtor/anonymous", "нет"]
    df = spark.createDataFrame([(x,) for x in links + empty], "x string")
    got = [r[0] for r in df.select(groups.link_key(F.col("x"))).collect()]
    assert set(got[:7]) == {"avtor/hot"} and set(got[7:]) == {None}
    names = spark.createDataFrame([("«Мир  Ру»",), ('"МИР РУ"',), (" мир ру ",), ("ориджинал",)], "x string")
    assert [r[0] for r in names.select(groups.name_key(F.col("x"))).collect()] == ["мир ру"] * 3 + [None]


def tables(spark):
    tags = "map<string,string>"
    toc = spark.createDataFrame(
        [("a", {"author_url": "/avtor/x"}), ("a", {"author_url": "/avtor/x"}), ("b", {"author_url": "avtor/X/", "fandom": "Мир"}), ("c", {"fandom": "«МИР»"}), ("d", None), ("e", {"fandom": "unknown"}), ("f", {})], f"file_id string, tags {tags}"
    )
    relation = spark.createDataFrame([("d", "d", "x"), ("e", "f", "y"), ("f", "zz", "y"), (None, "a", "y")], "file_1 string, file_2 string, relation_name string")
    rows = [(f, s) for k, f in enumerate("abcdefq") for s in range(k * 10, k * 10 + 5)]
    src = spark.createDataFrame([*rows, *rows[:3], ("a", None)], "file_id string, sentence_id long")
    return src, toc, relation


def test_grouped_sentences(spark):
    src, toc, relation = tables(spark)
    got = {(r.sentence_id, r.group_id) for r in groups.grouped_sentences(src, toc, relation).collect()}
    assert got == {(s, 0) for k in (0, 10, 20) for s in range(k, k + 5)} | {(s, 40) for k in (40, 50) for s in range(k, k + 5)}


def test_splits(spark):
    src, toc, relation = tables(spark)
    t = spark.createDataFrame([("train", 0.8), ("test", 0.2), ("test", 0.2)], "split string, target_share double")
    got = {r.sentence_id: r.split for r in groups.sentence_splits(src, toc, relation, t).collect()}
    assert len(got) == 35 and len({got[s] for s in (0, 10, 20)}) == 1 and got[40] == got[50]
    assert groups.sentence_splits(src.limit(0), toc.limit(0), relation.limit(0), t).count() == 0


def test_split_shares(spark):
    g = spark.range(3000).select(F.col("id").cast("string").alias("component"), (F.col("id") % 7 + 1).alias("weight"))
    big = spark.createDataFrame([("huge", 4000), ("large", 900)], "component string, weight long")
    all_ = g.unionByName(big)
    s = groups.split_groups(all_, [("train", 0.8), ("display", 0.1), ("test", 0.1)]).join(all_, "component").groupBy("split").agg(F.sum("weight").alias("w")).collect()
    total = sum(r.w for r in s)
    share = {r.split: r.w / total for r in s}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01 and abs(share["display"] - 0.1) < 0.01


def test_hubs(spark, monkeypatch):
    """Nodes whose neighbours are split off as hot give the same components, in the search and in the merging of labels."""
    monkeypatch.setattr(groups, "HOT", 10)
    monkeypatch.setattr(groups, "SHARES", 8)
    rng = random.Random(11)
    nodes = [f"n{i:03}" for i in range(300)]
    edges = [("n007", f"n{i:03}") for i in range(0, 200, 2)] + [("n250", f"n{i:03}") for i in range(201, 260)] + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(20)]
    assert found(spark, nodes, edges) == union_find(nodes, edges)


def test_hot_file(spark, monkeypatch):
    """A file that holds most sentences, split off as hot, gives the same groups and splits."""
    toc, relation = tables(spark)[1:]
    tokens = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 200 + i) for i in range(5)] + [("d", 300), ("e", 400), ("f", 500), (None, 600)], "file_id string, sentence_id long")
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, target_share double")
    plain = [sorted(map(tuple, x.collect())) for x in (groups.grouped_sentences(tokens, toc, relation), groups.sentence_splits(tokens, toc, relation, targets))]
    monkeypatch.setattr(groups, "HOT", 10)
    assert plain == [sorted(map(tuple, x.collect())) for x in (groups.grouped_sentences(tokens, toc, relation), groups.sentence_splits(tokens, toc, relation, targets))]
