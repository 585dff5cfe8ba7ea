"""Greedy packing of rows in order, in parallel: however long a group is, no task folds over all of it.

Rows go to ranges of the order. How a range goes on depends only on how full the pack is that reaches into it, and
that only on where its first new pack begins: so each range is worked on from every place where that can be, its
outcomes are composed along the group (a row per range), and the ranges are then numbered independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of the order that are worked on in one place.
BLOCK = 1 << 16
_SUMMARY = "_range long, total long, bounds array<long>, fills array<long>, packs array<long>"


def _next(sums: np.ndarray, size: int, over: bool) -> np.ndarray:
    """For each row that a pack may begin with, the row that the next one begins with (as many as there are rows: none).

    sums: running sums, 0 in front. over: a pack ends with the row that takes it to `size`; else it ends before that row,
    unless that is its first."""
    n = len(sums) - 1
    reach = np.searchsorted(sums, sums[:-1] + size, "left")  # sums[reach] is the first that is full
    return np.minimum(reach if over else np.maximum(reach - 1, np.arange(n) + 1), n)


def _first(sums: np.ndarray, fill: int, size: int, over: bool) -> int:
    """The row that the first new pack begins with if `fill` (not 0) are in the pack that reaches into the range."""
    if over and fill >= size:
        return 0
    reach = int(np.searchsorted(sums, size - fill, "left"))
    return min(reach if over else max(0, reach - 1), len(sums) - 1)


def _outcomes(sums: np.ndarray, size: int, over: bool) -> tuple[list[int], list[int], list[int]]:
    """For each row that the first new pack may begin with: how full the last pack is in the end, and how many packs there are.

    Rows beyond the first `size` units can't be first, but for the end."""
    n = len(sums) - 1
    follow = _next(sums, size, over)
    last = min(n, int(np.searchsorted(sums, size, "left")) + 1)
    known: dict[int, tuple[int, int]] = {n: (-1, 0)}
    for begin in range(last, -1, -1):
        path, at = [], begin
        while at not in known:
            path.append(at)
            at = int(follow[at])
        for p in reversed(path):
            fill, packs = known[int(follow[p])]
            known[p] = (int(sums[n] - sums[p]) if follow[p] == n else fill, packs + 1)
    starts = list(range(last + 1))
    return starts, [known[s][0] for s in starts], [known[s][1] for s in starts]


def packs(rows: DataFrame, group: str, order: str, units: str, size: int, over: bool = False) -> DataFrame:
    """(group, order, pack): rows of a group packed greedily in order, pack = 0, 1, ..

    Without `over` a pack holds fewer than `size` units, but for single rows of that many or more; with it a pack closes when it
    reaches `size`. `order` is a whole number, unique within the group; null groups are one group, null units count 0."""
    ranged = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(units).cast("long"), F.lit(0)).alias("u")).withColumn("_range", F.floor(F.col("o") / BLOCK))
    kinds = dict(ranged.dtypes)
    # At most BLOCK rows in each.
    lists = ranged.groupBy("g", "_range").agg(F.sort_array(F.collect_list(F.struct("o", "u"))).alias("items"))

    def summed(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces:
            out = []
            for items in piece.units:
                sums = np.concatenate([[0], np.asarray(items, np.int64).cumsum()])
                starts, fills, counts = _outcomes(sums, size, over)
                out.append((int(sums[-1]), [int(sums[s]) for s in starts], fills, counts))
            yield pd.concat([piece[["g", "_range"]].reset_index(drop=True), pd.DataFrame(out, columns=["total", "bounds", "fills", "packs"])], axis=1)

    def composed(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How full the open pack is and how many are closed before each range."""
        for piece in pieces:
            out = []
            for g, ranges in zip(piece.g, piece.ranges):
                fill, done, begun = 0, 0, False
                for x in ranges:
                    total, fills, counts = x["total"], x["fills"], x["packs"]
                    out.append((g, x["_range"], fill, done, begun))
                    sums = np.asarray(x["bounds"])
                    if not begun:
                        k, new = 0, True
                    else:
                        reach = fill + sums
                        full = np.flatnonzero(reach >= size)
                        k = int(full[0]) if len(full) else len(sums) - 1
                        if len(full) and not over:
                            k = max(0, k - 1)
                        new = bool(len(full))
                        if not new and total:
                            fill += total
                    if new:
                        fill, done = (int(fills[k]), done + int(counts[k])) if counts[k] else (fill + total, done)
                    begun = True
            yield pd.DataFrame(out, columns=["g", "_range", "fill", "done", "begun"])

    parts = lists.select("g", "_range", F.transform("items", lambda x: x["u"]).alias("units")).mapInPandas(summed, f"g {kinds['g']}, {_SUMMARY}")
    # An item for each range that a group reaches into; many small groups are one batch.
    ranges = parts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("_range", "total", "bounds", "fills", "packs"))).alias("ranges"))
    states = ranges.mapInPandas(composed, f"g {kinds['g']}, _range long, fill long, done long, begun boolean")

    def joined(held: list[tuple[list, list, np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame({"g": list(chain.from_iterable(g for g, _, _ in held)), "o": list(chain.from_iterable(o for _, o, _ in held)), "pack": np.concatenate([no for _, _, no in held])})

    def numbered(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces:
            held, rows = [], 0
            for g, items, fill, done, begun in zip(piece.g, piece["items"], piece.fill, piece.done, piece.begun):
                units_ = np.array([x["u"] for x in items], np.int64)
                sums = np.concatenate([[0], units_.cumsum()])
                follow = _next(sums, size, over)
                at = _first(sums, int(fill), size, over) if begun else 0
                starts = []
                while at < len(units_):
                    starts.append(at)
                    at = int(follow[at])
                no = done - 1 + np.searchsorted(starts, np.arange(len(units_)), "right")
                held.append(([g] * len(items), [x["o"] for x in items], no))
                rows += len(items)
                if rows >= BLOCK:
                    yield joined(held)
                    held, rows = [], 0
            if held:
                yield joined(held)

    held = lists.withColumn("_g", F.struct("g")).join(states.withColumn("_g", F.struct("g")).drop("g"), ["_g", "_range"])
    out = held.select("g", "items", "fill", "done", "begun").mapInPandas(numbered, f"g {kinds['g']}, o {kinds['o']}, pack long")
    return out.select(F.col("g").alias(group), F.col("o").alias(order), F.col("pack").cast("int").alias("pack"))
