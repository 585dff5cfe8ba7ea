"""Mixing sources to target weights: token blocks, slots, pseudorandom permutations."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut, spread
from .abuse import clean_name

#: Place of the vocabulary, a file of base64 tokens and ranks (see the README); tokens in a block; slots in an output shard.
TOKENIZER, BLOCK, SHARD = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 2048, 256
#: A source is ordered by a hash whose first RANGE_BITS bits are its range; running sums go over ranges, then inside one.
RANGE_BITS = 14
#: Groups of shards whose source counts are drawn on the driver.
GROUPS = 1024


_PART = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer in a file of ranks; one per worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str | None, size: int = 1 << 20) -> Iterator[str]:
    """A long text in pieces of about `size` characters that give the same tokens as the whole: cut before a single blank
    between two visible characters, where the tokenizer's pattern parts words anyway."""
    at = 0
    while at < len(text or ""):
        m = _PART.search(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def token_sizes(documents: DataFrame, doc_id: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): each document's clean source and the tokens of its whole text.

    Repeated rows count once; of an id with several texts the longest counts. Null and empty texts have 0 tokens."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(tokenizer)
        for part in parts:
            yield pd.DataFrame({"doc_id": part.doc_id, "source": part.source, "tokens": [sum(len(own.encode_ordinary(p)) for p in pieces(t)) for t in part.text]})

    docs = documents.select(F.col(doc_id).alias("doc_id"), clean_name(F.col(source)).alias("source"), F.col(text).alias("text")).where("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = spread(docs).mapInPandas(run, f"doc_id {kind}, source string, tokens long")
    return found.groupBy("doc_id").agg(F.max_by("source", "tokens").alias("source"), F.max("tokens").alias("tokens"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size), drawn by key, at index: a Feistel network over the next power of
    four, walked on until it falls into the range. Element by element; all arrays of equal length."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            l, r = x[todo] >> half[todo], x[todo] & mask[todo]
            for turn in range(4):
                h = (r + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                l, r = r, l ^ ((h >> np.uint64(29)) & mask[todo])
            x[todo] = (l << half[todo]) | r
            todo = x >= size.astype(np.uint64)
    return x.astype(np.int64)


@F.pandas_udf(LongType())
def _permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))


def blocks(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block, doc_id, from_token, to_token, offset): the documents of each source one behind the other in the order of
    a hash, cut into blocks of `block` tokens (the last one of a source may be shorter); tokens [from, to) of a
    document lie in that block, from its place `offset` on. Documents without tokens or source are in no block."""
    h = sizes.where("tokens > 0 and source is not null").withColumn("h", F.xxhash64("doc_id")).withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # 2 ** RANGE_BITS rows at most of each source.
    ranges = h.groupBy("source", "range").agg(F.sum("tokens").alias("sum")).select("source", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id")
    at = h.join(ranges, ["source", "range"]).withColumn("end", F.col("before") + F.sum("tokens").over(inside)).withColumn("start", F.col("end") - F.col("tokens"))
    each = at.select("source", "doc_id", "start", "end", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")).alias("block"))
    return each.select(
        "source",
        "block",
        "doc_id",
        F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("from_token"),
        (F.least("end", (F.col("block") + 1) * block) - F.col("start")).alias("to_token"),
        F.greatest(F.lit(0), F.col("start") - F.col("block") * block).alias("offset"),
    )


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], slots: int | None = None) -> tuple[int, dict[str, int]]:
    """(number of slots, slots of each source). available: source -> blocks; targets: source -> (share, most repeats).

    The shares of the sources that there are, scaled to 1, are met exactly (but for rounding) up to the largest number
    of slots that max_repeats allows; that is the default. With more slots asked for, sources at their limit stay
    there and the rest is shared out in proportion among the others."""
    share = {s: t for s, (t, r) in targets.items() if t and t > 0 and r and r > 0 and available.get(s)}
    whole = sum(share.values())
    if not whole:
        return 0, {}
    most = {s: available[s] * targets[s][1] for s in share}
    if slots is None:
        slots = max(1, math.floor(min(most[s] * whole / share[s] for s in share)))
    quota, free, left = {}, dict(share), min(slots, sum(most.values()))
    while free:
        room = sum(free.values())
        over = [s for s in free if left * free[s] / room > most[s]]
        if not over:
            exact = {s: left * free[s] / room for s in free}
            quota |= {s: math.floor(x) for s, x in exact.items()}
            for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s)):
                if sum(quota[q] for q in exact) < left and quota[s] < most[s]:
                    quota[s] += 1
            break
        for s in over:
            quota[s] = most[s]
            left -= most[s]
            del free[s]
    return sum(quota.values()), quota


def draw(rng: np.random.Generator, left: np.ndarray, count: int) -> np.ndarray:
    """How many of `count` slots each source gets: multinomial, in proportion to what is left of each, and no more than that."""
    got = np.zeros_like(left)
    while count > 0:
        rest = left - got
        one = np.minimum(rng.multinomial(count, rest / rest.sum()), rest)
        got += one
        count -= int(one.sum())
    return got


def _shards(seed: int, size: int):
    """(shard, slot, no, k) of groups of shards: each shard's source counts are drawn, then its slots are put in a random order;
    k counts the slots of a source over all shards."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first, slots, counts, before in zip(part["first"], part.slots, part.counts, part.before):
                left, at = np.array(counts, np.int64), np.array(before, np.int64)
                for shard in range(int(first), int(first) + -(-int(slots) // size)):
                    count = min(size, int(left.sum()))
                    rng = np.random.default_rng([seed, shard])
                    own = draw(rng, left, count)
                    no = np.repeat(np.arange(len(own)), own)
                    k = np.arange(count) - np.repeat(np.cumsum(own) - own, own) + np.repeat(at, own)
                    place = rng.permutation(count)
                    left, at = left - own, at + own
                    yield pd.DataFrame({"shard": shard, "slot": shard * size + place, "no": no, "k": k})

    return run


def mixture(cut_blocks: DataFrame, targets: DataFrame, slots: int | None = None, seed: int = 7) -> DataFrame:
    """(shard, slot, source, repetition, block, doc_id, from_token, to_token): what goes into each slot of the output.

    targets: source, target_share, max_repeats: a short list, which comes to the driver, as do the tokens of its sources and
    the counts of at most GROUPS groups of shards. The source counts of each shard are multinomial, with the shares of
    what is left of the sources' quotas, so that the quotas hold exactly. A source is a stream of its tokens, max_repeats
    times over, cut into full blocks, of which the first as many as its quota are used; the k-th slot of a source gets
    the k-th block in the order of the source's own pseudorandom permutation. So all slots but perhaps a source's last
    hold equally many tokens, and no document is used more than max_repeats times. Sources that are in one table only
    are in no slot. `block` is the block's place in the stream, `repetition` how often what stands there was used before."""
    spark = cut_blocks.sparkSession
    goal = _targets(targets)
    per = cut_blocks.where(F.col("source").isin(list(goal))).groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n"))
    held = {r.source: r for r in per.groupBy("source").agg(F.max("n").alias("width"), F.sum("n").alias("tokens")).collect()}
    width = max((r.width for r in held.values()), default=1)
    tokens = {s: r.tokens for s, r in held.items()}
    most = {s: -(-tokens[s] * (goal[s][1] or 0) // width) for s in held}
    total, quota = plan(most, {s: (goal[s][0], 1) for s in most if most[s]}, slots)
    names = [s for s in sorted(quota) if quota[s]]
    # At most GROUPS rows.
    left, first, rows, rng = np.array([quota[s] for s in names], np.int64), 0, [], np.random.default_rng(seed)
    shards = -(-total // SHARD)
    at = np.zeros_like(left)
    for part in _ranges(shards, GROUPS):
        count = int(min(len(part) * SHARD, left.sum()))
        own = draw(rng, left, count)
        rows.append((first, count, own.tolist(), at.tolist()))
        left, at, first = left - own, at + own, first + len(part)
    groups = spark.createDataFrame(rows if total else [], "first long, slots long, counts array<long>, before array<long>").repartition(max(1, len(rows)))
    placed = groups.mapInPandas(_shards(seed, SHARD), "shard long, slot long, no int, k long")
    own = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(quota[s]).cast("long").alias("quota"), F.lit(tokens[s]).cast("long").alias("tokens"), F.lit(tokens[s] * goal[s][1]).cast("long").alias("whole")) for s in names])
    own = own if names else F.array().cast("array<struct<source:string,quota:bigint,tokens:bigint,whole:bigint>>")
    slot = placed.withColumn("x", F.try_element_at(own, F.col("no") + 1)).select("shard", "slot", "x.*", _permuted(F.col("k"), F.col("x.quota"), F.col("no").cast("long") * 1000003 + seed + 1).alias("block"))
    span = slot.withColumn("a", F.col("block") * width).withColumn("b", F.least(F.col("a") + width, "whole"))
    # The block's place in the stream: in one repetition of the source or over the border of two or more.
    times = span.withColumn("repetition", F.explode(F.expr("sequence(a div tokens, (b - 1) div tokens)")))
    times = times.withColumn("a", F.greatest(F.col("a") - F.col("repetition") * F.col("tokens"), F.lit(0))).withColumn("b", F.least(F.col("b") - F.col("repetition") * F.col("tokens"), F.col("tokens")))
    bases = times.withColumn("base", F.explode(F.expr(f"sequence(a div {width}, (b - 1) div {width})")))
    bases = bases.withColumn("a", F.col("a") - F.col("base") * width).withColumn("b", F.col("b") - F.col("base") * width)
    met = bases.join(cut_blocks.withColumnRenamed("block", "base"), ["source", "base"])
    lo, hi = F.greatest("a", "offset"), F.least(F.col("b"), F.col("offset") + F.col("to_token") - F.col("from_token"))
    cut_out = met.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi")
    return cut_out.select(
        "shard", "slot", "source", F.col("repetition").cast("int").alias("repetition"), "block", "doc_id",
        (F.col("from_token") + F.col("lo") - F.col("offset")).alias("from_token"), (F.col("from_token") + F.col("hi") - F.col("offset")).alias("to_token"),
    )


def _ranges(shards: int, groups: int) -> list[range]:
    step = max(1, -(-shards // groups))
    return [range(lo, min(shards, lo + step)) for lo in range(0, shards, step)]


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select(clean_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").distinct().collect()
    return {r.source: (r.target_share, r.max_repeats) for r in sorted(rows, key=lambda r: (r.source, r.target_share or 0))}


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, available_tokens, target_share, mixed_tokens, reached_share, most_uses) of every source of either table."""
    got = mixed.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("mixed_tokens"), (F.max("repetition") + 1).alias("most_uses"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    goal = targets.select(clean_name(F.col("source")).alias("source"), "target_share").where("source is not null").distinct()
    whole = got.agg(F.sum("mixed_tokens").alias("all"))
    out = have.join(goal, "source", "full").join(got, "source", "left")
    total = whole.first()["all"] or 0
    zero = F.coalesce("mixed_tokens", F.lit(0))
    return out.select(
        "source",
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        zero.alias("mixed_tokens"),
        (F.round(zero / F.lit(float(total)), 6) if total else F.lit(0.0)).alias("reached_share"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )


def stored_sizes(documents: DataFrame, doc_id: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """token_sizes, written once: tokens are counted a single time whatever follows."""
    return cut(token_sizes(documents, doc_id, text, source, tokenizer))
