from pyspark.sql import functions as F

from lexloom.operators import features
from lexloom.operators import tokens as TK

TEXTS = [("a", "— Да!  \tСказал он. Ушёл.\n\n Было  тихо… Ночь\n  \n- Нет"), ("b", ""), ("c", None), ("d", "Одно"), ("e", "«Раз. Два»\n – Три? — спросил он. Да.")]


def test_sentences_from_the_text_are_those_of_the_tokens(spark):
    df = spark.createDataFrame(TEXTS, "file_id string, text string")
    t = TK.tokenize(df, "text", ["file_id"])
    d = t.join(features.dialog(t), ["file_id", "word_id"])
    s = d.groupBy("file_id", "sentence_id").agg(F.count(F.lit(1)).alias("tokens"), F.bool_or("is_dialog").alias("is_dialog"), F.min("word_id").alias("start_id"), F.max("word_id").alias("end_id"))
    want = s.join(TK.sentence_strings(t, ["file_id", "sentence_id"]), ["file_id", "sentence_id"])
    got = TK.sentence_rows(df, "text", ["file_id"], features.DASHES)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    # A row per token and what is shuffled with it is what the driver and the executors had to hold.
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
