"""The relational idioms everything else is made of. Each takes and returns DataFrames; nothing is run.

Windows are always partitioned; where an order may tie, a key is to be given as its last column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

Cols = Sequence[str]


def ordering(df: DataFrame, group: Cols, order: Sequence[str | Column], name: str = "order") -> DataFrame:
    """0-based place in the group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def fractions(df: DataFrame, group: Cols, key: str, name: str = "fraction") -> DataFrame:
    """Share of each key within its group."""
    counts = df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*group))).drop("n")


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def chunk_numbers(df: DataFrame, group: Cols, order: Cols, size: int, name: str = "chunk") -> DataFrame:
    """Numbers runs of `size` rows."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def keep(df: DataFrame, keys: DataFrame, on: Cols) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def drop(df: DataFrame, keys: DataFrame, on: Cols) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def left_fill(df: DataFrame, other: DataFrame, on: Cols, defaults: dict[str, object]) -> DataFrame:
    """Left join; what is missing gets the default."""
    out = df.join(other, list(on), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def outer_provenance(a: DataFrame, b: DataFrame, on: Cols) -> DataFrame:
    """Full outer join with `side` = both, left or right (P10)."""
    l, r = a.withColumn("_l", F.lit(True)), b.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return l.join(r, list(on), "full").withColumn("side", side).drop("_l", "_r")


def as_of(df: DataFrame, group: Cols, order: Cols, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def previous_equal(df: DataFrame, group: Cols, key: str, within: int, name: str = "reference") -> DataFrame:
    """The nearest earlier row with the same group values whose key is at most `within` less (P13), by a lag."""
    before = F.lag(key).over(Window.partitionBy(*group).orderBy(key))
    return df.withColumn(name, F.when(F.col(key) - before <= within, before))


def prefix_sum(df: DataFrame, group: Cols, order: Cols, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def dense_ids(df: DataFrame, group: Cols, columns: Cols, offset: int = 0) -> DataFrame:
    """Replaces ids by their dense 0-based rank in the group, plus offset."""
    return df.withColumns({c: F.dense_rank().over(Window.partitionBy(*group).orderBy(c)) - 1 + F.lit(offset) for c in columns})


#: Values of a numeric order that are worked on in one place.
BLOCK = 1 << 16


def _met(a: DataFrame, b: DataFrame, keys: Cols) -> DataFrame:
    """Left join in which null keys meet null keys; the columns of a and those of b that are no keys."""
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    return a.alias("a").join(b.alias("b"), same, "left").select("a.*", *[F.col(f"b.`{c}`") for c in b.columns if c not in keys])


def dense_rank_in(df: DataFrame, group: Cols, column: str, name: str) -> DataFrame:
    """1-based dense rank of a whole number in its group, nulls first: inside ranges of BLOCK values, and a running sum over the
    ranges (a row each), so that no group is one task."""
    keys = [*group, "_block"]
    own = df.withColumn("_block", F.floor(F.col(column) / BLOCK))
    inside = own.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(column)))
    sizes = inside.groupBy(*keys).agg(F.max("_rank").alias("_size"))
    before = sizes.select(*keys, (F.sum("_size").over(Window.partitionBy(*group).orderBy("_block")) - F.col("_size")).alias("_before"))
    return _met(inside, before, keys).withColumn(name, F.col("_rank") + F.coalesce("_before", F.lit(0))).drop("_block", "_rank", "_before")


def running_sum_in(df: DataFrame, group: Cols, order: str, value: Column, name: str) -> DataFrame:
    """Sum of a value over the rows of the group up to this one in a whole-number order, likewise in two levels."""
    keys = [*group, "_block"]
    own = df.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumn("_value", value)
    inside = own.withColumn("_sum", F.sum("_value").over(Window.partitionBy(*keys).orderBy(order)))
    sizes = own.groupBy(*keys).agg(F.sum("_value").alias("_size"))
    before = sizes.select(*keys, (F.sum("_size").over(Window.partitionBy(*group).orderBy("_block")) - F.col("_size")).alias("_before"))
    return _met(inside, before, keys).withColumn(name, F.col("_sum") + F.coalesce("_before", F.lit(0))).drop("_block", "_value", "_sum", "_before")


def with_margin(df: DataFrame, group: Cols, order: str, before: int) -> DataFrame:
    """df with _block, a range of BLOCK values of the order, and _own: besides its own rows each range is given copies (_own =
    false) of the `before` rows of its group that stand before it. What looks back no further may be done inside (group, _block)."""
    own = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    w = Window.partitionBy(*group, "_block").orderBy(F.desc(order))
    row = F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("_r"))
    tails = own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= before).groupBy(*group, "_block").agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    later = Window.partitionBy(*group).orderBy("_block")
    # A row for each range of a group; as none is empty, `before` of them hold all rows that are needed.
    joined = F.concat(*[F.coalesce(F.lag("_tail", k).over(later), F.array().cast(tails.schema["_tail"].dataType)) for k in range(before, 0, -1)])
    held = tails.withColumn("_m", joined).select(F.col("_block").alias("_b"), F.explode(F.slice("_m", F.greatest(F.lit(1), F.size("_m") - before + 1), F.lit(before))).alias("_x"))
    copies = held.select("_x._r.*", F.col("_b").alias("_block"), F.lit(False).alias("_own"))
    return own.withColumn("_own", F.lit(True)).unionByName(copies)


def concat_frames(*frames: DataFrame) -> DataFrame:
    """UNION ALL of frames whose columns differ (P20)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def wide(df: DataFrame, index: Cols, column: str, values: Sequence, value: Column) -> DataFrame:
    """Pivot with the columns named beforehand, so no extra job looks for them."""
    return df.groupBy(*index).pivot(column, list(values)).agg(value)


def narrow(df: DataFrame, index: Cols, columns: Cols, name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(index), list(columns), name, value)


def arg_max(df: DataFrame, group: Cols, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def row_best(df: DataFrame, columns: Cols, name: str = "best") -> DataFrame:
    """The column with the greatest value of each row, its value and the sum over the columns (P29); nulls count least."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    top = F.array_max(values)
    found = F.element_at(F.array(*map(F.lit, columns)), F.array_position(values, top).cast("int"))
    return df.withColumn(name, F.when(top.isNotNull(), found)).withColumn(f"{name}_value", top).withColumn(f"{name}_sum", F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))


def vicinity(df: DataFrame, group: Cols, order: Cols, value: str, before: int, after: int, flag: Column, name: str = "vicinity") -> DataFrame:
    """The values around each flagged row that has that many rows on both sides."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(name, F.collect_list(value).over(w)).where(flag & (F.size(name) == before + after + 1))


def rolling_mean(df: DataFrame, group: Cols, order: Cols, value: str, rows: int, name: str) -> DataFrame:
    """Mean of the last `rows` rows; null until there are so many."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == rows, F.avg(value).over(w)))


def seconds_to_next(df: DataFrame, group: Cols, order: Cols, time: str, name: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, (F.unix_micros(F.lead(F.col(time).cast("timestamp")).over(w)) - F.unix_micros(F.col(time).cast("timestamp"))) / 1e6)


def latest(df: DataFrame, group: Cols, order: str, *values: str) -> DataFrame:
    """Each value as of the greatest `order` in the group (P39); one pass with partial aggregation."""
    return df.groupBy(*group).agg(*[F.max_by(v, order).alias(v) for v in values])


def vocabulary(df: DataFrame, column: str, size: int) -> DataFrame:
    """(id, term, count): the `size` most frequent values from id 1 on; id 0 is UNK."""
    top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("term")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "term").limit(size)
    # At most `size` rows, a parameter.
    ids = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("count"), "term")).cast("int"))
    unk = df.sparkSession.range(1).select(F.lit(0).cast("int").alias("id"), F.lit("UNK").alias("term"), F.lit(0).cast("long").alias("count"))
    return unk.unionByName(ids.select("id", "term", "count"))


def sampled(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """A reproducible sample of `size` rows: those whose key's hash with the seed is least."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(size)


def numbered(df: DataFrame, order: Cols, name: str = "number") -> DataFrame:
    """0-based numbers over all rows in the given order, without a task that sees them all: rows go to ranges of the order,
    are written once (so that the ranges stay what they are), counted by range and numbered inside each."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # As many rows as partitions.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("_range").orderBy(*order)
    out = ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.row_number().over(w) - 1)
    return out.drop("_range", "_before")


def joined_text(df: DataFrame, group: Cols, order: str, piece: Column, name: str) -> DataFrame:
    """String sum of a group in order (P25)."""
    gathered = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, piece.alias("_p")))).alias("_l"))
    return gathered.select(*group, F.array_join(F.transform("_l", lambda x: x["_p"]), "").alias(name))
