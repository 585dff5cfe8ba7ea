"""Contexts of words, features for models, and evaluation of what models say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contexts(index: DataFrame, tokens: DataFrame, size: int, proportion: float = 0.5, zero: bool = False) -> DataFrame:
    """(sample_id, offset, another_word_id): the words around each sample inside its sentence.

    Of `size` words, round((1 - proportion) * size) stand on the right and the rest on the left; proportion <= 0 means
    all on the left, >= 1 all on the right (the reference's sense, kept). No join per offset: a sequence is exploded.
    index: sample_id, word_id, sentence_id, file_id; ids are dense inside a sentence."""
    if proportion <= 0:
        left, right = size, 0
    elif proportion >= 1:
        left, right = 0, size
    else:
        right = round((1 - proportion) * size)
        left = size - right
    limits = tokens.groupBy("file_id", "sentence_id").agg(F.min("word_id").alias("lo"), F.max("word_id").alias("hi"))
    at = index.join(limits, ["file_id", "sentence_id"])
    span = F.sequence(F.greatest(F.lit(-left).cast("long"), F.col("lo") - F.col("word_id")), F.least(F.lit(right).cast("long"), F.col("hi") - F.col("word_id")))
    out = at.select("sample_id", "word_id", F.explode(span).alias("offset")).select("sample_id", F.col("offset").cast("int").alias("offset"), (F.col("word_id") + F.col("offset")).alias("another_word_id"))
    return out if zero else out.where("offset != 0")


def best_symbol(scored: DataFrame, symbols: Sequence[str], actual: str) -> DataFrame:
    """Adds best (the symbol whose column is greatest; the first of equal ones) and correct (it is the actual one)."""
    values = F.array(*[F.col(f"`{s}`").cast("double") for s in symbols])
    best = F.element_at(F.array(*map(F.lit, symbols)), F.array_position(values, F.array_max(values)).cast("int"))
    return scored.withColumn("best", best).withColumn("correct", F.col("best") == F.col(actual))


def sign_contexts(index: DataFrame, tokens: DataFrame, size: int, proportion: float = 0.5, zero: bool = True) -> DataFrame:
    """Contexts that hide the sign to be guessed: targets lose offset 1, the others the largest offset of all.

    index has is_target besides."""
    c = contexts(index, tokens, size, proportion, zero).join(index.select("sample_id", "is_target"), "sample_id")
    top = size - (size - round((1 - proportion) * size)) if 0 < proportion < 1 else (0 if proportion <= 0 else size)
    gone = F.when(F.col("is_target"), F.lit(1)).otherwise(F.lit(top))
    return c.where(F.col("offset") != gone).drop("is_target")


def feature_columns(frame: DataFrame, key: str, numbers: Sequence[str] = (), logs: Sequence[str] = (), flags: Sequence[str] = (), allow: Sequence[str] | None = None) -> DataFrame:
    """Columns a model takes: numbers as they are, ln(x + 1), flags as 0/1; only allowed ones if a list is given."""
    ok = lambda c: allow is None or c in allow
    cols = [F.col(c).cast("double").alias(c) for c in numbers if ok(c)]
    cols += [F.log1p(F.col(c).cast("double")).alias(f"{c}_log") for c in logs if ok(c)]
    cols += [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in flags if ok(c)]
    return frame.select(key, *cols)


def top_categories(df: DataFrame, column: str, k: int, name: str | None = None, other: str = "OTHER") -> DataFrame:
    """The column with all but its k most frequent values (ties: the alphabet) replaced; nulls are other."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), column).limit(k).select(column, F.lit(True).alias("_top"))
    # At most k rows.
    return df.join(F.broadcast(top), column, "left").withColumn(name or column, F.when(F.col("_top"), F.col(column)).otherwise(other)).drop("_top")


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (F.coalesce(F.col(column) == v, F.lit(False))).cast("int") for v in values})


def imputed(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """The column with its mean for nulls, and <column>_missing."""
    mean = df.groupBy(*group).agg(F.avg(column).alias("_m"))
    joined = df.join(mean, list(group), "left") if group else df.join(F.broadcast(mean), F.lit(True), "left")
    return joined.withColumn(f"{column}_missing", F.col(column).isNull()).withColumn(column, F.coalesce(F.col(column).cast("double"), "_m")).drop("_m")


def scaled(df: DataFrame, column: str, group: Sequence[str]) -> DataFrame:
    """(x - mean) / sample standard deviation in the group; null where that is 0 or undefined."""
    stats = df.groupBy(*group).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    return df.join(stats, list(group)).withColumn(column, F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def batches(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], size: int) -> DataFrame:
    """batch: runs of `size` rows in the given order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("int"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    return df.select(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def true_class_rank(scores: DataFrame, sample: str, truth: str, classes: Sequence[str]) -> DataFrame:
    """(sample, rank): 0-based place of the true class among the scores of a row; ties: the order of the classes.

    Computed inside the row: the classes that score higher are counted, nothing is exploded or shuffled."""
    own = F.lit(None).cast("double")
    place = F.lit(None).cast("int")
    for k, c in enumerate(classes):
        own = F.when(F.col(truth) == c, F.col(c)).otherwise(own)
        place = F.when(F.col(truth) == c, k).otherwise(place)
    ahead = F.lit(0)
    for k, c in enumerate(classes):
        ahead = ahead + F.when((F.col(c) > own) | ((F.col(c) == own) & (F.lit(k) < place)), 1).otherwise(0)
    return scores.select(sample, F.when(own.isNotNull(), ahead).alias("rank"))


def auc(df: DataFrame, group: Sequence[str], score: str, positive: str) -> DataFrame:
    """(group, auc): area under the ROC curve by rank sums; equal scores share their mean rank; null without both classes.

    Rows are counted by score first, so a group's window is over its distinct scores."""
    n = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(*group, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(positive)).alias("p"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy(score)) - F.col("n")
    r = n.withColumn("r", before + (F.col("n") + 1) / 2)
    s = r.groupBy(*group).agg(F.sum(F.col("r") * F.col("p")).alias("rp"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    m = F.col("n") - F.col("p")
    return s.select(*group, F.try_divide(F.col("rp") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * m).alias("auc"))


def best_threshold(df: DataFrame, score: str, positive: str, digits: int = 4) -> DataFrame:
    """(threshold): the score that parts the classes best (true minus false positive rate); ties: the larger score.

    Scores between 0 and 1, rounded to `digits`: the running sums see 10 ** digits rows at most."""
    n = df.where(F.col(score).between(0, 1)).withColumn(score, F.round(score, digits)).groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    all_ = n.agg(F.sum("p").alias("ap"), F.sum("q").alias("aq"))
    w = Window.orderBy(F.desc(score))
    c = n.withColumn("cp", F.sum("p").over(w)).withColumn("cq", F.sum("q").over(w)).join(F.broadcast(all_), F.lit(True))
    gain = F.try_divide("cp", "ap") - F.try_divide("cq", "aq")
    return c.select(F.col(score).alias("threshold"), gain.alias("gain")).orderBy(F.desc("gain"), F.desc("threshold")).limit(1).select("threshold")


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """One row per true class, a column per predicted one."""
    return df.groupBy(truth).pivot(predicted, list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def worst(df: DataFrame, group: str, bad: str, n: int, least: int = 1) -> DataFrame:
    """The groups with the largest share of bad rows: all that tie with the n-th."""
    s = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(bad)).alias("bad")).where(F.col("rows") >= least).withColumn("share", F.col("bad") / F.col("rows"))
    cut = s.orderBy(F.desc("share")).limit(n).agg(F.min("share").alias("_cut"))
    return s.join(F.broadcast(cut), F.col("share") >= F.col("_cut")).drop("_cut")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): shares of the classes times their number."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_s"), F.count(F.lit(1)).alias("_k"))
    return n.join(F.broadcast(total), F.lit(True)).select(label, "n", (F.col("n") / F.col("_s") * F.col("_k")).alias("weight"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) per class."""
    pairs = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    t = pairs.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    p = pairs.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("said"))
    j = t.join(p, "label", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    return j.select("label", "support", F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "support").alias("recall"), F.try_divide(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"))


def log_table(logs: DataFrame, job: str, ordinal: str, time: str, metrics: Sequence[str]) -> DataFrame:
    """(job, metric, last, seconds): the last value of each metric and the seconds from first to last entry."""
    long = logs.unpivot([job, ordinal, time], list(metrics), "metric", "value")
    return long.groupBy(job, "metric").agg(F.max_by("value", ordinal).alias("last"), ((F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))) / 1e6).alias("seconds"))
