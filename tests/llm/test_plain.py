import pytest

from lexloom.llm import glyphs, plain

WORDS = [
    ("ｔｈｅ", "the"), ("１８８５", "1885"), ("нοмерοм", "номером"), ("brіght", "bright"), ("зa", "за"), ("Sее", "See"), ("забытый", "забытый"), ("посёлке", "посёлке"),
    ("гря́зный", None), ("кафе́", None), ("café", "café"), ("и ", "и"), (" не", "не"), ("1 975", "1 975"), ("придум‌ал", "придумал"), ("﻿билет", "билет"),
    ("USB-кабель", None), ("USB‑кaбель", "USB-кабель"), ("№", None), ("½", None), ("м²", None), ("«", None), ("—", None), ("…", None), ("，", ","), ("XIX", None), ("", None), ("​", ""), ("12 500", None),
]


@pytest.mark.parametrize("word,want", WORDS)
def test_plain_word(word, want):
    assert glyphs.plain_word(word) == (word if want is None else want)


def test_operator_agrees_with_the_slow_way(spark):
    rows = [(i, w, "x") for i, (w, _) in enumerate(WORDS)] + [(0, WORDS[0][0], "x"), (900, None, "x"), (901, "a" * 3000 + "ｂ", "x"), (902, "q̣̇", "x"), (903, "q̣̇", "x")]
    df = spark.createDataFrame(rows, "word_id long, word string, plain_word string")
    got = {(r.word_id, r.plain_word) for r in plain.plain_words(df, "word_id", "word").collect()}
    want = {(i, glyphs.plain_word(w)) for i, w, _ in rows if w is not None and glyphs.plain_word(w) != w}
    assert got == want and (903, "q̣̇") in got
    assert plain.plain_words(df.limit(0), "word_id", "word").count() == 0


def test_skeleton_ignores_case_marks_and_look():
    assert glyphs.skeleton("МРАЧНУЮ Ёлку") == glyphs.skeleton("мра́чную ёлкy") == glyphs.skeleton("мрaчную елку")
