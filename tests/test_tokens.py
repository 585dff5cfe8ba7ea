"""Token tables: golden tails, lengths, ids and types; re-indexing; packing; text and HTML."""

import pytest

from lexloom.operators import tokens as TK


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("word_id").select(*cols).collect()]


def one(spark, text, language="ru"):
    return TK.tokenize(spark.createDataFrame([(1, text)], "k int, t string"), "t", ["k"], language)


def test_russian_golden(spark):
    t = one(spark, "«Какой-нибудь»   текст —  с знаками… И еще словами!.. Вот так.")
    assert [r[0] for r in rows(t, "word_tail")] == [0, 0, 3, 1, 2, 1, 0, 1, 1, 1, 0, 1, 1, 0, 0]
    assert [r[0] for r in rows(t, "word_length")] == [1, 12, 1, 5, 1, 1, 7, 1, 1, 3, 7, 3, 3, 3, 1]


def test_english_golden(spark):
    t = one(spark, "“cream-covered“   cake —  with signs, And words!. Like that.", "en")
    assert [r[0] for r in rows(t, "word_length")] == [1, 13, 1, 4, 1, 4, 5, 1, 3, 5, 1, 1, 4, 4, 1]
    assert [r[0] for r in rows(t, "word_tail")] == [0, 0, 3, 1, 2, 1, 0, 1, 1, 0, 0, 1, 1, 0, 0]


def test_paragraphs_and_sentences(spark):
    t = one(spark, "первое предожение. Второе.\nВторой параграф")
    assert rows(t, "sentence_id", "word_id", "paragraph_id") == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 3, 0), (1, 4, 0), (2, 5, 1), (2, 6, 1)]
    assert [r[0] for r in rows(one(spark, "Строка\n\nВторая строка"), "paragraph_id")] == [0, 2, 2]


def test_types(spark):
    t = one(spark, "Слово сло′во! Qwe - йцу it's")
    assert [r[0] for r in rows(t, "word_type")] == ["ru", "ru", "punct", "unk", "punct", "ru", "unk", "punct", "unk"]


def test_nothing(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n ")], "k int, t string")
    t = TK.tokenize(df, "t", ["k"])
    assert t.count() == 0 and t.columns[1:] == TK.TOKENS.names


def test_reset_ids(spark):
    t = TK.tokenize(spark.createDataFrame([(1, "Первый. Абзац\nВторой абзац")], "k int, t string"), "t", ["k"])
    moved = t.withColumn("word_id", TK.F.col("word_id") * 10).withColumn("sentence_id", TK.F.col("sentence_id") * 100).withColumn("paragraph_id", TK.F.col("paragraph_id") * 1000)
    r = TK.reset_ids(moved, "k", 50)
    assert rows(r, "word_id", "sentence_id", "paragraph_id") == [(50, 50, 50), (51, 50, 50), (52, 51, 50), (53, 52, 51), (54, 52, 51)]
    assert TK.record_stats(r, "k").first().max_id == 56
    assert r.where("updated").count() == 0 and [x[0] for x in rows(r, "original_word_id")] == [0, 10, 20, 30, 40]


def test_global_ids_keep_files_apart(spark):
    df = spark.createDataFrame([(f"f{i}", "Раз два. Три.") for i in range(40)], "file_id string, t string")
    g = TK.global_ids(TK.tokenize(df, "t", ["file_id"]), "file_id", 10)
    assert g.select("word_id").distinct().count() == g.count() == 40 * 5
    assert TK.invalid_ids(g).count() == 0


def test_invalid(spark):
    t = one(spark, "Раз два")
    assert {r.problem for r in TK.invalid_ids(t.unionByName(t)).collect()} == {"word_id comes twice"}


@pytest.mark.parametrize("limit,want", [(8, [0, 0, 1, 1, 2, 3]), (100, [0] * 6), (1, [0, 1, 2, 3, 4, 5])])
def test_packing(spark, limit, want):
    lengths = [3, 4, 5, 2, 9, 1]
    data = [("f", s, w) for s, n in enumerate(lengths) for w in range(n)]
    df = spark.createDataFrame(data, "file_id string, sentence_id long, w int")
    got = [r.frame for r in TK.packed(df, "file_id", limit).orderBy("sentence_id").collect()]
    assert got == want


def test_text_and_html(spark):
    text = "Казнить нельзя, помиловать.\nМама мыла раму."
    t = one(spark, text)
    assert TK.to_text(t, "k").first().text == text
    html = TK.to_html(t.withColumn("v", TK.F.when(TK.F.col("word") == ".", "dot")), "k", "v", {"dot": "#ff0000"}).first().html
    assert html.count("<p>") == 2 and html.count('<span style="background-color:#ff0000;">.</span>') == 2
    assert "&lt;" in TK.to_html(one(spark, "a < b"), "k").first().html
