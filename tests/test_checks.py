"""Checkers and samplers against the golden inputs."""

from pyspark.sql import functions as F

from lexloom.operators import checks, context, sampling
from lexloom.operators import tokens as TK


def src(spark, text):
    return TK.tokenize(spark.createDataFrame([("f", text)], "file_id string, t string"), "t", ["file_id"])


def ids(df):
    return sorted(r.word_id for r in df.collect())


def test_repetitions(spark):
    t = src(spark, "Она была она красива. Он любил красивые вещи. Вещи, нитрокраситель и нитроэмаль!")
    assert ids(checks.repetitions(t)) == [2, 10]
    forms = t.select("word_id", F.when(F.col("word").isin("красива", "красивые"), "красивый").otherwise(F.lower("word")).alias("normal_form"))
    assert ids(checks.repetitions(t, forms=forms)) == [2, 7, 10]
    roots = forms.where("normal_form like '%красивый%' or word_id in (12, 14, 5)").select("word_id", F.when(F.col("word_id").isin(12, 14), "нитр").otherwise("крас").alias("morpheme"))
    assert 14 in ids(checks.repetitions(t, forms=forms, roots=roots))
    assert ids(checks.repetitions(t, index=t.where("word_id = 10"))) == [10]
    assert ids(checks.repetitions(t, within=1)) == []


def test_injected_forms(spark):
    t = src(spark, "окно открыто")
    forms = t.select("word_id", F.lit("окно").alias("normal_form"))
    r = checks.result(t, checks.repetitions(t, forms=forms), "repetitions")
    assert r.where("error").count() == 1 and r.where("not error").first().hint is None


def test_nothing_found(spark):
    t = src(spark, "Здесь нет ошибок")
    r = checks.result(t, checks.repetitions(t, index=t.limit(0)), "repetitions")
    assert r.count() == 3 and r.where("error").count() == 0
    assert checks.result(t, None, "x").where("error").count() == 0


def test_combined(spark):
    t = TK.from_words(spark.createDataFrame([("f", list("abcdefg"))], "file_id string, w array<string>"), "w", ["file_id"])
    check = lambda n: t.select("file_id", "word_id", (F.col("word_id") % n == 0).alias("error"))
    for order, winners in (((2, 3), ["2", None, "2", "3", "2", None, "2"]), ((3, 2), ["3", None, "2", "3", "2", None, "3"])):
        r = checks.combined(t, [(str(n), check(n)) for n in order]).orderBy("word_id").collect()
        assert [x.algorithm for x in r] == winners and [x.error for x in r] == [w is not None for w in winners]
    assert checks.all_errors([("2", check(2)), ("3", check(3))]).count() == 7


def test_spelling(spark):
    t = src(spark, "В этом придложении есть ашипки")
    d = spark.createDataFrame([(w,) for w in "в этом предложении есть ошибки ашипка".split()], "word string")
    r = {x.word_id: x.suggest for x in checks.spelling(t, d).collect()}
    assert set(r) == {2, 4} and r[2] == ["предложении"] and r[4] == ["ашипка"]


def test_quality(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (True, True)], "t boolean, p boolean")
    r = checks.quality(df, "t", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1) and round(r.f1, 3) == 0.667
    assert checks.quality(df.limit(0), "t", "p").first().precision is None


TEXT = "Чтобы приготовить суп. Нужно купить продукты. Что бы мне сделать. С Новым Годом!. Для того, чтобы. Во что бы мне поиграть."


def test_sequences(spark):
    kept = sampling.with_target(src(spark, TEXT), sampling.starts_sequence([["чтобы"], ["что", "бы"]])).orderBy("word_id")
    want = "Чтобы приготовить суп . Что бы мне сделать . Для того , чтобы . Во что бы мне поиграть .".split()
    assert [r.word for r in kept.collect()] == want


def test_rewritten(spark):
    s = spark.createDataFrame([(0, "Чтобы приготовить суп."), (1, "Для того, чтобы."), (2, "Во что бы мне поиграть, чтобы развлечься."), (3, "Нет.")], "n int, t string")
    got = [r.t for r in sampling.rewritten(s, "t", [("чтобы", "что бы"), ("Чтобы", "Что бы")]).orderBy("n", "variant_no").collect()]
    assert got == ["Что бы приготовить суп.", "Для того, что бы.", "Во чтобы мне поиграть, чтобы развлечься.", "Во что бы мне поиграть, что бы развлечься."]


def test_combinations(spark):
    s = spark.createDataFrame([(0, "Не был и не будет.")], "n int, t string")
    got = [r.t for r in sampling.combinations(s, "t", [["не", "ни"]]).collect()]
    assert sorted(got) == sorted(["Ни был и не будет.", "Не был и ни будет.", "Ни был и ни будет."])


def test_buckets(spark):
    rows = [(c, k * 100 + s, w) for c in "йцу" for k in range(3) for s, n in enumerate([3, 5, 7] * 10) for w in range(n)]
    df = spark.createDataFrame(rows, "corpus_id string, sentence_id long, w int")
    b = sampling.buckets(df, 2.0)
    assert {(r.len, r.log_len) for r in b.collect()} == {(3, 1), (5, 2), (7, 2)}
    assert sampling.capped(b, ["corpus_id", "log_len"], "sentence_id", 2).count() == 3 * 2 * 2


def test_variants_and_endings(spark):
    t = src(spark, "Он учится и хочет учиться.").withColumn("is_target", F.col("word").endswith("тся") | F.col("word").endswith("ться"))
    v = sampling.swap_endings(sampling.variants(t), "тся", "ться")
    assert {(r.variant_no, r.word) for r in v.where("is_target").collect()} == {(0, "учиться"), (1, "учитcя".replace("c", "с"))}


def test_contexts(spark):
    t = src(spark, "Это предложение заканчивается запятой,")
    i = t.select(F.col("word_id").alias("sample_id"), "word_id", "sentence_id", "file_id", (F.col("word_id") == 3).alias("is_target"))
    c = context.sign_contexts(i, t, 5, 0.5, True).orderBy("sample_id", "offset")
    per = {}
    for r in c.collect():
        per.setdefault(r.sample_id, []).append(r.offset)
    assert per[0] == [0, 1] and 1 not in per[3] and per[4][-1] == 0
    assert all(o != 2 for k, v in per.items() if k != 3 for o in v)


def test_auc_and_ranks(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (2.0, True), (3.0, True), (None, True)], "s double, p boolean").withColumn("g", F.lit(1))
    assert abs(context.auc(df, ["g"], "s", "p").first().auc - 0.5) < 1e-9
    w = spark.createDataFrame([("a", 0.1, 0.9), ("b", 0.5, 0.5), (None, 0.1, 0.2)], "t string, a double, b double")
    assert [r[0] for r in context.true_class_rank(w.withColumn("i", F.lit(1)), "i", "t", ["a", "b"]).select("rank").collect()] == [1, 1, None]


def test_class_tables(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    r = {x.label: x for x in context.class_report(df, "t", "p").collect()}
    assert r["a"].recall == 0.5 and r["b"].precision == 0.5 and r["c"].precision is None
    assert context.class_weights(df, "t").agg(F.sum("weight")).first()[0] == 3
    assert context.confusion(df, "t", "p", ["a", "b"]).where("t = 'a'").first().asDict() == {"t": "a", "a": 1, "b": 1}
