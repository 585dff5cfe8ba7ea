"""Suffix-array counts against brute force."""

import random
from collections import Counter, defaultdict

from lexloom.llm import terms


def brute(rows, length):
    occ, rec, by = Counter(), defaultdict(set), defaultdict(list)
    for at, r, w in sorted(rows):
        if w is not None:
            by[r].append(w)
    for r, ws in by.items():
        for n in range(1, length + 1):
            for i in range(len(ws) - n + 1):
                t = (n, " ".join(ws[i : i + n]))
                occ[t] += 1
                rec[t].add(r)
    return {(n, t, c, len(rec[n, t])) for (n, t), c in occ.items()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"f{i // 37}", rng.choice("aabбc") * rng.choice([1, 1, 2]) if rng.random() > 0.02 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "at long, file string, w string")
    for length in (1, 3):
        got = {tuple(r) for r in terms.term_counts(df, "at", "w", "file", length).select("size", "term", "occurrences", "records").collect()}
        assert got == brute(rows, length)


def test_one_hot_term_and_small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, f"f{i % 50}", "hot" if i % 3 else f"w{i}") for i in range(600)]
        df = spark.createDataFrame(rows, "at long, file string, w string")
        got = {tuple(r) for r in terms.term_counts(df.sort("file", "at"), "at", "w", "file", 1).select("size", "term", "occurrences", "records").collect()}
        assert got == brute(rows, 1)
        dense = [(i, f"f{i // 12}", "hot" if i % 3 else f"w{i % 5}") for i in range(600)]
        got = {tuple(r) for r in terms.term_counts(spark.createDataFrame(dense, df.schema), "at", "w", "file", 2).select("size", "term", "occurrences", "records").collect()}
        assert got == brute(dense, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_corpus_terms(spark):
    src = spark.createDataFrame([(1, "f", "a"), (1, "f", "a"), (2, "f", "a"), (3, "g", None), (4, "g", "a"), (None, "g", "z")], "word_id long, file_id string, word string")
    forms = spark.createDataFrame([(1, "A"), (1, "A"), (4, None), (9, "B")], "word_id long, normal_form string")
    got = {tuple(r) for r in terms.corpus_terms(src, forms).collect()}
    assert got == {("word", "a", 3, 2), ("normal_form", "A", 1, 1), ("normal_form", "B", 1, 0)}
    marks = {(r.field, r.term, r.mark) for r in terms.marked(terms.corpus_terms(src, forms), 2).collect()}
    assert ("word", "a", "common") in marks and ("normal_form", "A", "rare") in marks
    assert terms.corpus_terms(src.limit(0), forms.limit(0)).count() == 0


def test_gaps_and_ranges(spark, monkeypatch):
    """N-grams go on over gaps in the keys and over any number of ranges; a record that comes back later goes on too."""
    monkeypatch.setattr(terms, "BLOCK", 4)
    rng = random.Random(9)
    at, rows = 0, []
    for i in range(400):
        at += rng.choice([1, 1, 1, 2, 9, 40])
        rows.append((at, f"f{(i // 23) % 5}", rng.choice("abc") if rng.random() > 0.1 else None))
    got = {tuple(r) for r in terms.term_counts(spark.createDataFrame(rows, "at long, file string, w string"), "at", "w", "file", 4).select("size", "term", "occurrences", "records").collect()}
    assert got == brute(rows, 4)


def test_records_by_duplicate_adjacencies():
    """Common prefixes and links of sorted suffixes as one finds them by hand."""
    import numpy as np

    assert terms.common_prefixes([np.array([1, 1, 1, 2]), np.array([5, 5, 6, 6])]).tolist() == [0, 2, 1, 0]
    assert terms.duplicate_links(np.array([3, 1, 3, 3, 1])).tolist() == [-1, -1, 0, 2, 1]


def test_no_record(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "f", "a"), (4, "f", "")], "at long, file string, w string")
    got = {tuple(r) for r in terms.term_counts(df, "at", "w", "file", 1).select("size", "term", "occurrences", "records").collect()}
    assert got == {(1, "a", 3, 1), (1, "", 1, 1)}
    assert terms.corpus_ngrams(df.limit(0).toDF("word_id", "file_id", "word"), 3).count() == 0
