"""Columns out of nested objects: by path, flattened, and statistics of lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def by_path(df: DataFrame, paths: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One column per name from a dotted path; only the fields asked for are read."""
    return df.select(*keep, *[F.col(p).alias(n) for n, p in paths.items()])


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """All fields of all structs as columns of their own, named by their path."""

    def leaves(schema: StructType, path: tuple[str, ...] = ()):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(separator.join(p)) for p in leaves(df.schema)])


def list_stats(column: Column, name: str) -> list[Column]:
    """Number, least, greatest and mean of a list of numbers; nulls in it are left out, of an empty list only the number is known."""
    clean = F.filter(column, lambda x: x.isNotNull())
    total = F.aggregate(clean, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return [F.size(clean).alias(f"{name}_count"), F.array_min(clean).alias(f"{name}_min"), F.array_max(clean).alias(f"{name}_max"), F.try_divide(total, F.size(clean)).alias(f"{name}_mean")]
