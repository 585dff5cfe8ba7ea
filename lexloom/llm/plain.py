"""Words that look the same, brought to one form (see glyphs.py for the tables)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut
from . import glyphs
from .sentences import dealt

#: A word without any of these is plain already: a character beyond the usual plain ones, a blank at an end, letters of two alphabets.
SUSPECT = "[^ -~а-яёА-ЯЁ«»—–…№“”’„°²½§]|^ | $|[A-Za-z].*[а-яёА-ЯЁ]|[а-яёА-ЯЁ].*[A-Za-z]"


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decompositions, look-alikes, classes of marks. Bounded by Unicode: some 15,000, 120 and 900 rows."""
    one = spark.createDataFrame(pd.DataFrame(list(glyphs.single().items()), columns=["c", "parts"]))
    look = spark.createDataFrame(pd.DataFrame([(k, *v) for k, v in glyphs.scripts().items()], columns=["c", "shows", "latin", "russian"]))
    marks = spark.createDataFrame(pd.DataFrame(list(glyphs.marks().items()), columns=["c", "ccc"]))
    return F.broadcast(one), F.broadcast(look), F.broadcast(marks)


@F.pandas_udf(StringType())
def _recompose(words: pd.Series) -> pd.Series:
    return words.map(lambda w: unicodedata.normalize("NFC", w))


def _characters(column: str) -> str:
    return f"regexp_extract_all({column}, '(?s).', 0)"


def plain_forms(words: DataFrame, column: str) -> DataFrame:
    """(word, plain_word) of each distinct word that differs from its plain form.

    Words are exploded to positioned code points, which are joined with the broadcast tables: decomposed, their
    combining marks put in the order of their classes, letters of each hyphenated piece set to the script that its
    unmistakable letters show, then recomposed and put together. Nulls and '' have no row; a word of only invisible
    characters becomes ''. A piece that shows no script, or two, keeps its letters."""
    one, look, marks = _tables(words.sparkSession)
    # Few words, but much work for each.
    own = dealt(words.select(F.col(column).alias("word")).where(F.col("word").rlike(SUSPECT)).distinct(), "word")
    points = own.select("word", F.expr(f"posexplode({_characters('word')}) as (place, c)"))
    parts = (
        points.join(one, "c", "left")
        .withColumn("parts", F.coalesce("parts", "c"))
        .select("word", "place", F.expr(f"posexplode_outer({_characters('parts')}) as (sub, c)"))
        .withColumn("c", F.coalesce("c", F.lit("")))
    )
    order = Window.partitionBy("word").orderBy("place", "sub")
    placed = (
        parts.join(look, "c", "left")
        .join(marks, "c", "left")
        .withColumn("ccc", F.coalesce("ccc", F.lit(0)))
        .withColumn("piece", F.sum((F.col("c") == "-").cast("int")).over(order))
        .withColumn("cluster", F.sum(((F.col("ccc") == 0) & (F.col("c") != "")).cast("int")).over(order))
    )
    whole = Window.partitionBy("word", "piece")
    shown = placed.withColumn("l", F.max((F.col("shows") == "L").cast("int")).over(whole)).withColumn(
        "r", F.max((F.col("shows") == "R").cast("int")).over(whole)
    )
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    letter = F.when((l > r), F.coalesce("latin", "c")).when(r > l, F.coalesce("russian", "c")).otherwise(F.col("c"))
    built = (
        shown.select("word", F.struct("cluster", "ccc", "place", "sub", letter.alias("c")).alias("x"))
        .groupBy("word")
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
        .select("word", F.array_join(F.transform("xs", lambda x: x.c), "").alias("flat"))
    )
    return built.select("word", F.trim(_recompose("flat")).alias("plain_word")).where("plain_word != word")


def plain_words(tokens: DataFrame, key: str, column: str) -> DataFrame:
    """(key, plain_word) of each row whose word differs from its plain form; repeated rows count once, null words have none."""
    # The rows that may change are looked for once.
    dirty = cut(tokens.select(key, F.col(column).alias("word")).where(F.col("word").rlike(SUSPECT)))
    forms = plain_forms(dirty, "word")
    return dirty.join(forms, "word").select(key, "plain_word").distinct()
