from itertools import combinations

from lexloom.llm import align


def test_chapters_whose_names_stand_in_many_chapters(spark):
    """Each name stands in ten of fifteen chapters of either edition; only all of them together tell a chapter."""
    cast = list(combinations("Vevin Gofen Murpin Lisdor Kelmur Tanbir".split(), 4))
    rows = []
    for k, names in enumerate(cast):
        words = [{"start": 0, "size": 9, "words": ["@" + n.lower()]} for n in names]
        rows += [(100 + k, f"r{k}", "r", "ru", words), (200 + 7 * k % 15, f"e{k}", "e", "en", words)]
    own = spark.createDataFrame(rows, "book_id long, file_id string, edition string, lang string, sentences array<struct<start:long,size:int,words:array<string>>>")
    named = spark.createDataFrame([("r", "e", 100, 200)], "ru string, en string, book_ru long, book_en long")
    titles = spark.createDataFrame([], "book_id long, title string")
    words = spark.createDataFrame([], "r string, e string")
    got = {tuple(x) for x in align.chapter_pairs(own, named, titles, words).collect()}
    assert got == {(100 + k, 200 + 7 * k % 15) for k in range(15)}


def test_equal_chapters_pair_in_order_and_strange_ones_do_not():
    same = [(b, w, True) for b in range(5) for w in ("@a", "@b")]
    assert align._met(same, [(b + 10, w, s) for b, w, s in same], set()) == [(b, b + 10) for b in range(5)]
    assert align._met([(1, "@a", True), (1, "@b", True)], [(2, "@c", True)], set()) == []
    # The last chapters have no counterpart; they share the name that stands everywhere, no more.
    ru = [(b, w, True) for b in range(4) for w in ("@a", f"@{b}")]
    en = [(b + 10, w, s) for b, w, s in ru if b < 3] + [(20, "@a", True), (20, "@x", True)]
    assert set(align._met(ru, en, set())) == {(b, b + 10) for b in range(3)}
