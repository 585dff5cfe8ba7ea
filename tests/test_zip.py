"""Zip exchange: archives are made and read by many tasks, rows are what they were."""

import zipfile

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.operators import tokens as TK
from lexloom.sources import corpus


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """Thirty files of a few words and a large one, with a frame."""
    c = corpus.Corpus(spark, str(tmp_path_factory.mktemp("zip") / "c"))
    rows = [(f"f{k}", "Раз, два. " * (k + 1)) for k in range(30)] + [("a/b.c", "слово " * 150_000)]
    texts = spark.createDataFrame(rows, "file_id string, text string")
    c.write(TK.tokenize(texts, "text", ["file_id"]).withColumn("filename", F.col("file_id")))
    c.write_frame("lengths", c.src().where("file_id <> 'f3'").select("file_id", "word_id", F.when(F.col("word_length") > 2, F.col("word_length")).alias("long")))
    return c


def _rows(df):
    return sorted(df.collect(), key=str)


def test_rows_are_the_same(spark, own, tmp_path):
    path = str(tmp_path / "c.zip")
    corpus.write_zip(own, path)
    for part, df in (("src", own.src()), ("lengths", own.frame("lengths"))):
        df = df.drop("bucket", "corpus_id")
        got = corpus.read_zip(spark, path, part, df.schema)
        assert {r[0] for r in got.select("corpus_id").distinct().collect()} == {"c.zip"}
        got = got.select(*df.columns)
        assert got.schema.simpleString() == df.schema.simpleString() and _rows(got) == _rows(df)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist())) == 1 + 31 + 30
        large = pq.ParquetFile(z.open("src/a/b.c.parquet"))
        assert large.metadata.num_row_groups > 1
        words = large.read().to_pandas()
        assert words.word_id.is_monotonic_increasing and set(words.corpus_id) == {"c"}
    assert not [n for n in own._parts() if n.startswith("_zip")]


def test_one_archive_is_read_by_many_tasks(spark, own, tmp_path, monkeypatch):
    path = str(tmp_path / "c.zip")
    corpus.write_zip(own, path)
    monkeypatch.setattr(corpus, "ZIP_SHARE", 1 << 12)
    got = corpus.read_zip(spark, path).withColumn("task", F.spark_partition_id())
    assert got.select("task").distinct().count() > 3
    assert got.count() == own.src().count()
    # Whole numbers stay whole where some are missing.
    one = corpus.read_zip(spark, path, "lengths").where("file_id = 'f1'")
    assert {r[0] for r in one.select(F.get_json_object("row", "$.long")).collect()} == {"3", None}


def test_archives_made_elsewhere(spark, tmp_path):
    """Stored, deflated and otherwise packed members; the index of a pandas frame; a damaged one is an error."""
    df = pd.DataFrame({"word": ["а", "б"]}, index=pd.Index([7, 8], name="word_id"))
    for k, how in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_LZMA)):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", how) as z:
            z.writestr("src/u.parquet", df.to_parquet())
            z.writestr("toc.parquet", df.reset_index(drop=True).to_parquet())
    got = corpus.read_zip(spark, str(tmp_path / "*.zip"))
    assert {tuple(r) for r in got.collect()} == {(f"{k}.zip", "u", row) for k in range(3) for row in ('{"word_id":7,"word":"а"}', '{"word_id":8,"word":"б"}')}
    assert {r.row for r in corpus.read_zip(spark, str(tmp_path / "0.zip"), "toc").collect()} == {'{"index":0,"word":"а"}', '{"index":1,"word":"б"}'}
    made = bytearray((tmp_path / "0.zip").read_bytes())
    made[made.index(b"PAR1") + 9] ^= 255
    (tmp_path / "bad.zip").write_bytes(made)
    with pytest.raises(Exception, match="damaged"):
        corpus.read_zip(spark, str(tmp_path / "bad.zip")).collect()


def test_where_arrow_reaches_nothing(spark, own, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "_reachable", lambda path: False)
    path = str(tmp_path / "c.zip")
    corpus.write_zip(own, path)
    df = own.src().drop("bucket", "corpus_id")
    assert corpus.read_zip(spark, path, "src", df.schema).select(*df.columns).exceptAll(df).isEmpty()
    assert corpus.read_zip(spark, path).count() == df.count()
