"""Headers, markdown, FB2, HTML, fragments, corpora, alignment, streams."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import alignment, research
from lexloom.operators import tokens as TK
from lexloom.sources import corpus, formats
from lexloom.streaming import ingest


def test_cleaning():
    assert formats.clean_line("Те­ст") == "Тест" and formats.clean_line("It's not й'цц'у") == "It's not й′цц′у"


def test_header_machine():
    h = formats.Headers()
    assert [h.observe(x) for x in ["x", "x", "# a", "   ", "# b", "xx", "yy"]] == ["New", "Continue", "Ignore", "Ignore", "Ignore", "New", "Continue"]
    assert h.header_tags() == {"header_0": "a / b"}


def test_skipped_levels_and_tags():
    h = formats.Headers()
    for x in ("#a", "### b", "x"):
        h.observe(x)
    assert [t for _, t in h.stack] == ["a", "b"]
    h.observe("## c")
    assert [t for _, t in h.stack] == ["a", "c"]
    got = [(t, " ".join(x)) for x, t in formats.blocks('# a\n$ {"x": 56} \ntest\n## b\n$ {"y":100}\nmore')]
    assert got[0] == ({"header_0": "a", "tag_x": "56"}, "test") and got[1][0] == {"header_0": "a", "header_1": "b", "tag_y": "100"}


MD = "# h1\n# h1.1\n## h2\nПервый параграф. \n\nВторой.\n\n## h22\n\nТретий."


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/b.md").write_text(MD)
    p = formats.read_markdown(spark, str(tmp_path), ["folder", "name"]).orderBy("part_index").collect()
    assert [(r.tags["header_0"], r.tags["header_1"], r.tags["name"]) for r in p] == [("h1 / h1.1", "h2", "b"), ("h1 / h1.1", "h22", "b")]
    with pytest.raises(ValueError):
        formats.name_tags("a/b-c.md", ["x"])


FB2 = """<?xml version="1.0"?><FictionBook><description><title-info/></description><body><title><p>T</p></title><section><title><p>One</p></title>
<p>Some <emphasis>nice</emphasis> text</p><subtitle>Sub</subtitle><p>More<a>1</a></p></section></body><body><p>notes</p></body></FictionBook>"""


def test_fb2(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("x.fb2", FB2)
    files = spark.createDataFrame([("x.zip", bytearray(b.getvalue())), ("y.fb2", bytearray(FB2.encode()))], "path string, content binary")
    r = formats.read_fb2(files)
    assert r.where("filename = 'x.zip'").count() == r.where("filename = 'y.fb2'").count()
    assert formats.fb2_uncovered(r).count() == 0
    md = formats.fb2_markdown(r).where("filename = 'x.zip'").first().markdown.split("\n\n")
    assert [x.strip() for x in md] == ["## T", "### One", "Some nice text", "#### Sub", "More"]
    bodies = formats.fb2_bodies(r).where("filename = 'x.zip'").orderBy("body").collect()
    assert [x.body for x in bodies] == [1, 2] and bodies[0].title == "T" and not bodies[0].suspicious


def test_html(spark):
    page = "<h1>Head</h1><p>One <b>two</b></p><script>x</script><blockquote>Q</blockquote><p>End</p><h2>gone</h2>"
    assert formats.html_markdown(page) == "## Head\n\nOne two\n\nQ\n\nEnd" and formats.html_markdown(None) == ""
    df = spark.createDataFrame([(1, "<a href='/book/1'>a</a><a href=\"/x\">b</a><a href='/book/1'>c</a>")], "k int, h string")
    assert df.select(formats.links(F.col("h"), "/book/").alias("l")).first().l == ["/book/1"]


def test_mini_parts():
    text = "\n\n".join("абзац " * 20 for _ in range(20))
    parts = formats.mini_parts(text, 300)
    assert all(len(p) <= 600 for p in parts) and sum(len("".join(p.split())) for p in parts) == len("".join(text.split()))
    assert formats.mini_parts("коротко", 300) == []


def test_spans(spark):
    t = spark.createDataFrame([(1, "Анна пришла.\nОна устала.")], "k int, text string")
    s = spark.createDataFrame([(1, 0, 4), (1, 13, 16), (1, 0, 11)], "k int, start long, end long")
    r = {x.word: (x.starts, x.ends) for x in formats.entity_spans(t, s, "k").collect()}
    assert r["Анна"] == (2, 1) and r["Она"] == (1, 1) and r["пришла"] == (0, 1)


def test_corpus(spark, tmp_path):
    c = corpus.Corpus(spark, str(tmp_path / "c"))
    files = spark.createDataFrame([(f"f{i}", f"name{i // 2}", "Первый. Абзац\nВторой абзац") for i in range(4)], "file_id string, filename string, text string")
    src = TK.tokenize(files, "text", ["file_id", "filename"])
    c.write(src.where("file_id != 'f3'"), span=100)
    with pytest.raises(Exception):
        c.write(src)
    c.write(src.where("file_id = 'f3'"), mode="append", span=100, subcorpus="late")
    assert c.toc().count() == 4 and c.src().select("word_id").distinct().count() == 20
    assert sorted(r.ordinal for r in c.toc().collect()) == [0, 1, 2, 3]
    assert c.requested(["f1", "zz", "f1"]) == ["f1", "f1"] and c.src(["f1"]).count() == 5
    with pytest.raises(ValueError):
        c.requested(["zz"])
    assert c.relations().count() == 0
    c.add_relation(spark.createDataFrame([("f0", "f1", "next"), ("f0", "f2", "next")], "file_1 string, file_2 string, relation_name string"))
    assert {r.file_id for r in c.mapped(["f0"], ["next"]).collect()} == {"f1"}
    with pytest.raises(IndexError):
        c.mapped(["f1"], ["next"])
    assert c.subcorpus("late").count() == 5
    with pytest.raises(AttributeError, match="late"):
        c.subcorpus("none")
    assert c.grouped_src([["f0", "zz"], ["f0", "f1"]]).count() == 15
    with pytest.raises(TypeError):
        c.grouped_src(["f0"])
    d = corpus.Corpus(spark, str(tmp_path / "d"))
    from lexloom.operators import features

    step = features.simple("stems", lambda b: features.stems(b["src"]))
    keep = lambda b: b.src.groupBy("file_id").agg(F.lit(True).alias("keep")).where("file_id != 'f0'")
    corpus.featurized(c, d, [keep, step])
    assert d.frame("stems").count() == 15 and d.frame_names() == ["stems"] and d.bundle(["f1"]).stems.count() == 5
    corpus.featurized(c, d, [step])
    assert d.src().count() == 20
    assert corpus.assembled(c, 2).src.count() == 10
    assert corpus.transfused([c, d], lambda df: df, 4, 20).count() == 20
    corpus.write_zip(c, str(tmp_path / "c.zip"))
    assert corpus.read_zip(spark, str(tmp_path / "c.zip")).where("file_id = 'f1'").count() == 5


def test_edit_path():
    assert [s for *_, s in alignment.edit_path("abc", "abc")] == ["Matched"] * 3
    assert alignment.edit_path(list("ab"), []) == [(0, -1, "Deleted"), (1, -1, "Deleted")]
    assert [s for *_, s in alignment.edit_path(list("axc"), list("abc"))] == ["Matched", "Transited", "Matched"]


SIM = np.array([[1, 0, 0, 0, 0], [0.5, 0.9, 0, 0, 0], [0.1, 0.8, 0.4, 0, 0], [0.3, 0.1, 1.0, 0.4, 0], [0.3, 0.4, 0.7, 0.4, 0.3], [0.3, 0.4, 0.9, 0.2, 0.3], [0.3, 0.4, 0.5, 0.8, 0.3], [0.3, 0.4, 0.5, 0.6, 0.6]])


def test_monotone():
    assert alignment.monotone(np.array([[1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1]])) == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    assert alignment.monotone(SIM) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 3, 7: 4}
    assert alignment.monotone(np.zeros((0, 3))) == {}


def test_fragments(spark):
    s = spark.createDataFrame([("f", i, 200, i == 2, i * 10, i * 10 + 9, f"s{i}") for i in range(6)], "file_id string, sentence_id long, tokens long, is_dialog boolean, start_id long, end_id long, text string")
    got = sorted((r.text_type, r.fragment, r.text, r.start_id, r.end_id) for r in alignment.fragments(s, "file_id", 500).collect())
    assert got == [("dialog", 0, "s2", 20, 29), ("narrative", 0, "s0 s1", 0, 19), ("narrative", 1, "s3 s4", 30, 49), ("narrative", 2, "s5", 50, 59)]


def test_bootstrap(spark):
    df = spark.range(200).select("id", F.lit(2.0).alias("v"))
    r = alignment.bootstrap(df, "id", "v", 50).first()
    assert (r.low, r.middle, r.high) == (2.0, 2.0, 2.0)


def test_antecedents(spark):
    n = spark.createDataFrame([("f", "m", i) for i in (1, 3, 5, 9)], "file_id string, gender string, word_id long")
    p = spark.createDataFrame([("f", "m", 6), ("f", "m", 0), ("f", "x", 7)], "file_id string, gender string, word_id long")
    assert sorted((r.word_id, r.candidate_id, r.place) for r in research.antecedents(n, p, 2).collect()) == [(6, 3, 2), (6, 5, 1)]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Раз два."), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    s = ingest.token_stream(ingest.documents(spark, str(tmp_path / "in"), docs.schema), "text", "doc_id")
    q = s.writeStream.format("memory").queryName("words").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from words").first()[0] == 3
