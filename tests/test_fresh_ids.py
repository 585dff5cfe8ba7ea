from lexloom.operators import tokens as TK
from lexloom.sources import corpus


def test_fresh_ids_are_those_of_reset_and_global_ids(spark, tmp_path):
    rows = [(f"f{i % 5}", 9 * i * i + 70_000 * (i % 7) if i % 11 else None, (i // 6) * 3 if i % 13 else None, (i // 20) * 7 if i % 17 else None, f"w{i}") for i in range(300)]
    df = spark.createDataFrame([*rows, *rows[:5], (None, 1, 1, 1, "lost")], "file_id string, word_id long, sentence_id long, paragraph_id long, word string")
    want = TK.global_ids(TK.reset_ids(df.where("file_id is not null"), "file_id"), "file_id", 50)
    got = TK.fresh_ids(df, "file_id", 50, 0)
    assert sorted(want.columns) == sorted(got.columns)
    key = lambda r: str(r)
    assert sorted(want.collect(), key=key) == sorted(got.select(*want.columns).collect(), key=key)
    moved = TK.fresh_ids(df, "file_id", 50, 1000).agg({"word_id": "min"}).first()[0]
    assert moved == got.agg({"word_id": "min"}).first()[0] + 1000


def test_a_source_is_read_once_and_nothing_is_left_beside_the_corpus(spark, tmp_path):
    n = spark.sparkContext.accumulator(0)

    def seen(parts):
        for p in parts:
            n.add(len(p))
            yield p

    text = spark.createDataFrame([("a", "x.md", "Раз. Два"), ("b", "y.md", "Три")], "file_id string, filename string, text string")
    src = TK.tokenize(text, "text", ["file_id", "filename"]).mapInPandas(seen, TK.tokenize(text, "text", ["file_id", "filename"]).schema)
    c = corpus.Corpus(spark, str(tmp_path / "c"))
    c.write(src)
    assert n.value == 4 and c._parts() == ["src", "toc"] and c.toc().count() == 2


def test_rows_move_once_for_ranks_and_offsets(spark):
    """Words without an id stand in a block of their own, so that the window and the join after it are laid out alike."""
    rows = [("a", w, s, 0) for w, s in ((None, 1), (5, 1), (TK.WORD_BLOCK + 1, 2), (TK.WORD_BLOCK + 1, 2))] + [("b", 3, None, 4)]
    df = spark.createDataFrame(rows, "file_id string, word_id long, sentence_id long, paragraph_id long")
    kept = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def keep(x):
        kept.append(x)
        return spark.createDataFrame(x.collect(), x.schema)

    try:
        got = {(r.file_id, r.original_word_id, r.word_id, r.sentence_id) for r in TK.fresh_ids(df, "file_id", 10, 0, keep).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    a, b = ({x for x in got if x[0] == f} for f in "ab")
    base = min(x[3] for x in a)
    assert {(o, w is not None and w - base, s - base) for _, o, w, s in a} == {(None, False, 0), (5, 1, 0), (TK.WORD_BLOCK + 1, 2, 1)}
    assert len(b) == 1 and {x[3] for x in b} == {None}
    plan = kept[-1]._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "isnull(_block" in line]
