"""Feature frames: dialogue, capitals, morphemes, vectors, incremental updates, trees."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import features, syntax
from lexloom.operators import tokens as TK


def src(spark, *texts):
    return TK.tokenize(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_id string, t string"), "t", ["file_id"])


def steps(spark, text):
    t = src(spark, text)
    r = t.join(features.dialog(t), ["file_id", "word_id"]).orderBy("word_id").collect()
    kinds = [x.dialog_type for x in r]
    return [k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k]


@pytest.mark.parametrize("text", ["Он вышел.", "Те, которые отказались, — нет."])
def test_no_dialog(spark, text):
    assert steps(spark, text) == ["no"]


def test_dialog(spark):
    a = ["dialog-dash", "speech", "dialog-symbol", "dialog-dash", "action"]
    assert steps(spark, "— О, всему понемножку, — беззаботно ответил Дамблдор.") == a
    b = ["dialog-symbol", "dialog-dash", "speech"]
    long = "— В целом, это решение, — сказал он. — Впрочем, я думаю. Да, — подтвердил он, — я считаю. Ты права."
    assert steps(spark, long) == [*a, *b, "dialog-symbol", "dialog-dash", "action", *b]
    assert steps(spark, "— При чем тут «ненавидит»? — возразила она. — Просто я считаю, вот и все!") == [*a, *b]
    assert steps(spark, "— А насчет него? — спросил он (третий из братьев). — Он так и не общается?") == [*a, *b]


def test_capitalization(spark):
    t = src(spark, "Мама Анна пришла. Потом мама ушла.")
    forms = t.select("word_id", F.lower("word").alias("normal_form"))
    r = {x.word_id: x for x in features.capitalization(t, forms).collect()}
    assert r[0].is_capitalized and not r[0].is_unexpectedly_capitalized and r[0].uc_proportion == 0.5
    assert r[1].is_unexpectedly_capitalized and r[3].ru_order == -1 and r[5].uc_somewhere


def test_morphemes(spark):
    lines = spark.createDataFrame([(2, "дом\tдом:ROOT"), (1, "дом\tдо:PREF/м:ROOT"), (3, "плохо")], "no int, line string")
    d = features.morpheme_dictionary(lines)
    forms = spark.createDataFrame([(1, "дом"), (2, None), (3, "нет")], "word_id long, normal_form string")
    got = [tuple(r) for r in features.morphemes(forms, d).orderBy("morpheme_index").collect()]
    assert got == [(1, 0, "PREF", "до"), (1, 1, "ROOT", "м")]
    assert features.morphemes(forms, d, ["ROOT"]).count() == 1


def test_frequencies(spark):
    d = spark.createDataFrame([("Дом", 2.0, 1, 50, 3), ("дом", 3.0, 4, 40, 2)], "lemma string, freq double, range int, juilland int, text_count int")
    r = {x.word_id: x for x in features.frequencies(spark.createDataFrame([(1, "дом"), (2, "кот")], "word_id long, normal_form string"), d).collect()}
    assert (r[1].freq, r[1].corpus_range, r[1].freq_found) == (5.0, 4, 1) and r[2].freq == 0 and r[2].freq_found == 0


def test_stems(spark):
    t = src(spark, "красная красный красного Ёлка")
    r = [x.stem for x in features.stems(t).orderBy("word_id").collect()]
    assert r[0] == r[1] == r[2] == "красн" and r[3].startswith("елк")
    with pytest.raises(ValueError):
        features.per_distinct_word(t, None, "pos string")


def test_incremental(spark):
    old = spark.createDataFrame([("f0", w, w * 100) for w in range(6)], "file_id string, word_id long, v long")
    new = spark.createDataFrame([("f0", 10 + w, p, u, w) for w, p, u in [(0, 0, False), (1, 0, False), (2, 1, True), (3, 1, False), (4, 2, None), (5, 2, False)]], "file_id string, word_id long, paragraph_id long, updated boolean, original_word_id long")
    out = features.incremental(new, old, lambda s: s.select("file_id", "word_id", F.lit(-1).cast("long").alias("v")))
    assert {(r.word_id, r.v) for r in out.collect()} == {(10, 0), (11, 100), (12, -1), (13, -1), (14, 400), (15, 500)}


GOLDEN = [(0, 3, "case"), (1, 0, "fixed"), (2, 3, "amod"), (3, 6, "obl"), (4, 3, "punct"), (5, 6, "nsubj"), (6, -1, "root"), (7, 6, "advmod")]


def edges(spark, rows, sentence=0):
    return spark.createDataFrame([("f", sentence, w, p, r) for w, p, r in rows], "file_id string, sentence_id long, word_id long, syntax_parent_id long, relation string")


def test_closure_golden(spark):
    c = syntax.closure(edges(spark, GOLDEN)).collect()
    d = [r.distance for r in c]
    assert (len(c), d.count(1), d.count(2), d.count(3)) == (12, 7, 4, 1)
    assert {(r.word_id, r.ancestor_id, r.relation) for r in c if r.distance == 3} == {(1, 6, "obl")}


def test_tree_stats(spark):
    e = edges(spark, GOLDEN)
    r = {x.word_id: x for x in syntax.tree_stats(e, syntax.closure(e)).collect()}
    assert (r[6].children, r[6].descendants, r[6].down_depth, r[6].up_depth, r[6].sentence_length) == (3, 7, 3, 0, 8)
    assert r[7].children == 0 and r[7].up_depth == 1


@pytest.mark.parametrize(
    "rows",
    [
        [(0, 1, "a"), (1, 0, "b"), (2, 1, "c")],
        [(0, -1, "a"), (1, -1, "b"), (2, 1, "c"), (3, 1, "d")],
        [(0, -1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 1, "d")],
        GOLDEN,
    ],
)
def test_repair(spark, rows):
    r = syntax.repaired(edges(spark, rows))
    assert syntax.problems(r).count() == 0
    parent = {x.word_id: x.syntax_parent_id for x in r.collect()}
    for w in parent:
        for _ in range(len(parent) + 1):
            w = parent.get(w, -1)
        assert w == -1


def test_heads_and_context(spark):
    w = spark.createDataFrame([("f", 0, 100, 1, 2), ("f", 0, 101, 2, 0), ("f", 0, 102, 3, 2)], "file_id string, sentence_id long, word_id long, syntax_id int, syntax_head_id int")
    assert {(r.word_id, r.syntax_parent_id) for r in syntax.heads(w).collect()} == {(100, 101), (101, -1), (102, 101)}
    c = syntax.context(edges(spark, GOLDEN))
    assert c.where("kind = 'sibling' and word_id = 5").count() == 2 and c.where("kind = 'child' and word_id = 6").count() == 3


def test_vectors(spark):
    t = src(spark, "Ёж пришёл, кот")
    forms = t.select("word_id", F.lit("идти").alias("normal_form")).where("word_id = 1")
    v = spark.createDataFrame([("еж", 7), ("идти", 8)], "term string, vector_id long")
    r = {x.word_id: x for x in features.vector_keys(t, forms, v).collect()}
    assert r[0].selected_word_column == "lower_e" and r[1].vector_id == 8 and r[3].selected_word == "<unk>"
