"""Streams, an extension: texts tokenized as they arrive, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tokens import tokenize


def documents(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def token_stream(stream: DataFrame, text: str, key: str, language: str = "ru") -> DataFrame:
    """Tokens of each arriving text; stateless."""
    return tokenize(stream, text, [key], language)


def event_windows(stream: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window of event time and kind; rows later than `late` are not counted (state stays bounded)."""
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    return own.groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    return own.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Each key once, as long as its copies come within `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])
