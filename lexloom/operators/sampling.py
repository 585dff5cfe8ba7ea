"""Training sets: length buckets, sentence filters, negative samples, dictionaries of pairs, indices, splits, controls."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import numbered

SENTENCE = ["file_id", "sentence_id"]


def _whole_log(n: Column, base: float) -> Column:
    """floor(log) by whole powers: exact where a logarithm would be a hair off."""
    out = F.lit(0)
    k = 1
    while base**k < 2**31:
        out = F.when(n >= math.ceil(base**k - 1e-9), k).otherwise(out)
        k += 1
    return out.cast("int")


def buckets(tokens: DataFrame, base: float = 2.0, corpus: str = "corpus_id") -> DataFrame:
    """(corpus, sentence_id, len, log_len): words of each sentence and their whole logarithm."""
    n = tokens.where("sentence_id is not null").groupBy(corpus, "sentence_id").agg(F.count(F.lit(1)).cast("int").alias("len"))
    return n.withColumn("log_len", _whole_log(F.col("len"), base))


def hash_order(*cols: str, seed: int = 0) -> Column:
    """A reproducible order that has nothing to do with the data (md5, the same in other engines)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def capped(rows: DataFrame, group: Sequence[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows of each group, by hash: the balancing of classes or buckets."""
    w = Window.partitionBy(*group).orderBy(hash_order(key, seed=seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def selected(tokens: DataFrame, allowed: DataFrame, corpus: str = "corpus_id") -> DataFrame:
    return tokens.join(allowed.select(corpus, "sentence_id").distinct(), [corpus, "sentence_id"], "left_semi")


def rounded_buckets(tokens: DataFrame, limit: int, corpus: str = "corpus_id", seed: int = 0) -> DataFrame:
    """(bucket, sentences): sentences by corpus and rounded natural logarithm of their words, at most `limit` of each."""
    n = tokens.where("word is not null and sentence_id is not null").groupBy(corpus, "sentence_id").agg(F.count(F.lit(1)).alias("len"))
    key = n.withColumn("bucket", F.concat(F.col(corpus), F.lit("/"), F.bround(F.ln("len")).cast("int").cast("string")))
    return capped(key, ["bucket"], "sentence_id", limit, seed).groupBy("bucket").agg(F.sort_array(F.collect_list("sentence_id")).alias("sentences"))


def merged_buckets(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bucket").agg(F.sort_array(F.flatten(F.collect_list("sentences"))).alias("sentences"))


def with_target(tokens: DataFrame, target: Column) -> DataFrame:
    """Sentences with at least one target; is_target on each word."""
    t = tokens.withColumn("is_target", F.coalesce(target, F.lit(False)))
    return t.withColumn("_any", F.bool_or("is_target").over(Window.partitionBy(*SENTENCE))).where("_any").drop("_any")


def in_dictionary(words: DataFrame, column: str = "word") -> Callable[[DataFrame], DataFrame]:
    """A filter: sentences with a word (in small letters) of the dictionary, which are the targets."""
    known = words.select(F.lower(column).alias("_w")).where("_w is not null").distinct().withColumn("_hit", F.lit(True))

    def run(tokens: DataFrame) -> DataFrame:
        hit = tokens.withColumn("_w", F.lower("word")).join(known, "_w", "left").drop("_w")
        return with_target(hit, F.col("_hit")).drop("_hit")

    return run


def training_bundle(
    tokens: DataFrame,
    target: Callable[[DataFrame], DataFrame],
    negative: Callable[[DataFrame], DataFrame],
    featurizers: Sequence = (),
    base: float = 2.0,
    most: int | None = None,
    seed: int = 0,
    reference: str = "word",
) -> dict[str, DataFrame]:
    """A training set from start to end: {src, index and the featurizers' frames}.

    Sentences are balanced by corpus and whole logarithm of their length (`most` of each bucket), then filtered by
    `target` (which adds is_target); what was written is label 0, what `negative` makes of it label 1, each variant with
    ids of its own: variant_no 0 for what was written, from 1 on for what was made. original_corpus_id tells where a
    sentence is from. tokens: corpus_id and a token table with ids unique over all corpora."""
    if most is not None:
        b = buckets(tokens, base)
        tokens = selected(tokens, capped(b, ["corpus_id", "log_len"], "sentence_id", most, seed))
    kept = target(tokens).withColumn("original_corpus_id", F.col("corpus_id"))
    written = kept.withColumn("variant_no", F.lit(0))
    made = negative(kept)
    made = made.withColumn("variant_no", F.col("variant_no") + 1 if "variant_no" in made.columns else F.lit(1))
    src = labelled(written, made)
    bundle = {"src": src}
    for f in featurizers:
        bundle |= f.frames(bundle)
    rows = index(src, F.col("label"), reference, seed=seed)
    # Samples of one word differ by their variant.
    own = src.where("is_target").select("word_id", "label", "variant_no").distinct()
    bundle["index"] = rows.drop("sample_id").distinct().join(own, ["word_id", "label"])
    return bundle


def starts_sequence(sequences: Sequence[Sequence[str]]) -> Column:
    """Is this word the first of one of the sequences (small letters, across sentences of the file)?"""
    w = Window.partitionBy("file_id").orderBy("word_id")
    out = F.lit(False)
    for s in sequences:
        hit = F.lower("word") == s[0].lower()
        for k, word in enumerate(s[1:], 1):
            hit = hit & (F.lower(F.lead("word", k).over(w)) == word.lower())
        out = out | F.coalesce(hit, F.lit(False))
    return out


DASHES = ("–", "—", "−", "―")


def plain_dash(word: Column) -> Column:
    """Dashes of any length as one: -."""
    return F.when(word.isin(*DASHES), "-").otherwise(word)


def next_sign(symbols: Sequence[str]) -> Column:
    """Is the next word of the sentence one of the signs, and this one no punctuation?"""
    nxt = F.lead("word").over(Window.partitionBy(*SENTENCE).orderBy("word_id"))
    return F.coalesce((F.col("word_type") != "punct") & nxt.isin(*symbols), F.lit(False))


def variants(tokens: DataFrame) -> DataFrame:
    """Every sentence once for each of its targets: variant_no = k keeps only the k-th target flagged."""
    rank = F.sum(F.col("is_target").cast("int")).over(Window.partitionBy(*SENTENCE).orderBy("word_id")) - 1
    most = F.sum(F.col("is_target").cast("int")).over(Window.partitionBy(*SENTENCE))
    t = tokens.withColumn("_rank", rank).withColumn("_most", most).where("_most > 0")
    each = t.withColumn("variant_no", F.explode(F.sequence(F.lit(0), F.col("_most").cast("int") - 1)))
    return each.withColumn("is_target", F.col("is_target") & (F.col("_rank") == F.col("variant_no"))).drop("_rank", "_most")


def swap_endings(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """Target words with ending a get b and the other way round."""
    w = F.col("word")
    end = lambda x, y: F.expr(f"concat(substring(word, 1, length(word) - {len(x)}), '{y}')")
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    swapped = F.when(w.endswith(longer), end(longer, shorter)).when(w.endswith(shorter), end(shorter, longer)).otherwise(w)
    return tokens.withColumn("word", F.when(F.col("is_target"), swapped).otherwise(w))


def rewritten(sentences: DataFrame, text: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(.., variant_no, text): every text with one place changed: each occurrence of a side of a pair becomes the other.

    The changed texts are to be tokenized again; the number of words may differ."""
    sides = [(x, y) for a, b in pairs for x, y in ((a, b), (b, a))]
    pattern = "|".join(sorted({x for x, _ in sides}, key=lambda x: (-len(x), x)))
    table = F.create_map(*[F.lit(v) for x, y in sides for v in (x, y)])
    # The places: pieces between matches and matches, in turn.
    mark = "\u0001"
    cut = F.split(F.regexp_replace(F.col(text), f"(?<![\\p{{L}}])({pattern})(?![\\p{{L}}])", f"{mark}$1{mark}"), mark)
    return (
        sentences.withColumn("_cut", cut)
        .where("size(_cut) > 1")
        .withColumn("variant_no", F.explode(F.expr("sequence(0, (size(_cut) - 1) div 2 - 1)")))
        .withColumn(text, F.array_join(F.transform("_cut", lambda x, i: F.when(i == F.col("variant_no") * 2 + 1, F.element_at(table, x)).otherwise(x)), ""))
        .drop("_cut")
    )


def combinations(sentences: DataFrame, text: str, alternatives: Sequence[Sequence[str]]) -> DataFrame:
    """(.., text): every combination of alternatives at their places, without the original, sorted and numbered; the
    case of a first letter is kept. As many rows as combinations: meant for sentences with few places."""
    flat = [a for s in alternatives for a in s]
    pattern = "|".join(sorted(flat, key=lambda x: (-len(x), x)))
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(F.col(text), f"(?iu)(?<![\\p{{L}}])({pattern})(?![\\p{{L}}])", f"{mark}$1{mark}"), mark)
    sets = F.create_map(*[x for s in alternatives for a in s for x in (F.lit(a), F.array(*map(F.lit, s)))])

    def options(x: Column, i: Column) -> Column:
        o = F.element_at(sets, F.lower(x))
        up = F.lower(F.substring(x, 1, 1)) != F.substring(x, 1, 1)
        cased = F.transform(o, lambda a: F.when(up, F.concat(F.upper(F.substring(a, 1, 1)), F.expr("''"), F.substring(a, 2, 1000))).otherwise(a))
        return F.when(i % 2 == 1, cased).otherwise(F.array(x))

    lists = F.transform("_p", options)
    product = F.aggregate(lists, F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda s: F.transform(o, lambda a: F.concat(s, a)))))
    out = sentences.withColumn("_p", pieces).where("size(_p) > 1").withColumn("_all", F.sort_array(F.array_except(product, F.array(F.col(text)))))
    return out.select(*sentences.columns, F.posexplode("_all").alias("variant_no", "_t")).withColumn(text, F.col("_t")).drop("_t")


def labelled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """label 0 for what was written, 1 for what was made."""
    return positive.withColumn("label", F.lit(0)).unionByName(negative.withColumn("label", F.lit(1)), allowMissingColumns=True)


def ending_pairs(tokens: DataFrame, a: str, b: str, known: DataFrame | None = None) -> DataFrame:
    """(stem, n_a, n_b, ratio): words seen with both endings, how often, and the smaller share; only known ones if given."""
    w = tokens.where("word is not null").select(F.lower("word").alias("w"))
    if known is not None:
        w = w.join(known.select(F.lower("word").alias("w")).distinct(), "w", "left_semi")
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    end = F.when(F.col("w").endswith(longer), longer).when(F.col("w").endswith(shorter), shorter)
    s = w.withColumn("end", end).where("end is not null").withColumn("stem", F.expr("substring(w, 1, length(w) - length(end))"))
    n = s.groupBy("stem").agg(F.count_if(F.col("end") == a).alias("n_a"), F.count_if(F.col("end") == b).alias("n_b")).where("n_a > 0 and n_b > 0")
    return n.withColumn("ratio", F.least(F.col("n_a") / F.col("n_b"), F.col("n_b") / F.col("n_a")))


def index(tokens: DataFrame, label: Column, reference: str, shares: tuple[int, int] = (80, 90), seed: int = 0) -> DataFrame:
    """(sample_id, word_id, sentence_id, label, split, reference): the targets; split by a hash of the reference, so that
    equal references stay together: below shares[0] of 100 train, below shares[1] display, else test."""
    t = tokens.where("is_target")
    h = F.conv(F.substring(hash_order(reference, seed=seed), 1, 6), 16, 10).cast("long") % 100
    split = F.when(h < shares[0], "train").when(h < shares[1], "display").otherwise("test")
    return t.select(F.col("word_id").alias("sample_id"), "word_id", "sentence_id", label.alias("label"), split.alias("split"), F.col(reference).alias("reference"))


def stratified(rows: DataFrame, strata: Sequence[str], key: str, shares: tuple[float, float] = (0.8, 0.9), seed: int = 0) -> DataFrame:
    """Splits each stratum in the same shares, by rank of hash. Ranks go in two levels, over ranges of the hash and inside
    each, so that no stratum is one task."""
    h = rows.withColumn("_h", hash_order(key, seed=seed)).withColumn("_r", F.substring("_h", 1, 3))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in strata]
    # 4096 rows at most of each stratum.
    counts = h.groupBy(*strata, "_r").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*strata)
    before = counts.select(*strata, "_r", (F.sum("_c").over(whole.orderBy("_r")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_all"))
    inside = h.withColumn("_n", F.row_number().over(Window.partitionBy(*strata, "_r").orderBy("_h", key)) - 1)
    met = inside.alias("a").join(before.alias("b"), reduce(lambda x, y: x & y, same, F.col("a._r") == F.col("b._r")))
    placed = met.select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], ((F.col("b._before") + F.col("a._n")) / F.col("b._all")).alias("_p"))
    return placed.withColumn("split", F.when(F.col("_p") < shares[0], "train").when(F.col("_p") < shares[1], "display").otherwise("test")).drop("_p")


def folds(rows: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """fold: one of `count` by a hash of the key, so that rows of one key stay together."""
    return rows.withColumn("fold", (F.conv(F.substring(hash_order(key, seed=seed), 1, 6), 16, 10).cast("long") % count).cast("int"))


def weighted_batches(rows: DataFrame, key: str, priority: str, size: int, seed: int = 0) -> DataFrame:
    """batch: rows in batches of `size`, those of high priority earlier: in the order of -ln(u) / priority, u by hash, which draws
    without replacement in proportion to priority. Rows of no priority come last. Numbered without a task that sees all."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    p = F.col(priority).cast("double")
    order = F.when(p > 0, -F.ln(u) / p).otherwise(F.lit(float("inf")))
    return numbered(rows.withColumn("_o", order), ["_o", key], "_n").withColumn("batch", (F.col("_n") / size).cast("long")).drop("_o", "_n")


def split_composition(rows: DataFrame, category: str) -> DataFrame:
    """(split, category, n, share): what each split is made of."""
    n = rows.groupBy("split", category).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def split_by_time(rows: DataFrame, time: str, *borders: tuple[str, str]) -> DataFrame:
    """split: the name of the first border (time, name) that a row lies before, else test; null times are test."""
    out = F.lit("test")
    for at, name in reversed(borders):
        out = F.when(F.col(time) < F.lit(at).cast("timestamp"), name).otherwise(out)
    return rows.withColumn("split", out)


def restricted(bundle: dict[str, DataFrame], words: DataFrame) -> dict[str, DataFrame]:
    """A bundle with only the given words (word_id): src and each frame that has that key."""
    ids = words.select("word_id").distinct()
    return {k: v.join(ids, "word_id", "left_semi") if "word_id" in v.columns else v for k, v in bundle.items()}


def control(shares: DataFrame, train: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(file_id, max_deviation, sum_deviation): how far a file's shares lie from those of the training files.

    shares and train: file_id, category, fraction; categories: the short list that counts (parts of speech, say); what a
    file lacks is 0. Deviation = |share - mean| / sample standard deviation over the training files; a category that
    doesn't vary there, or of which one file alone tells, is left out. In long form: no column per category."""

    def dense(df: DataFrame) -> DataFrame:
        has = df.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "fraction"))).alias("m"))
        each = has.select("file_id", "m", F.explode(F.array(*map(F.lit, categories))).alias("category"))
        return each.select("file_id", "category", F.coalesce(F.try_element_at("m", F.col("category")), F.lit(0.0)).alias("fraction"))

    stats = dense(train).groupBy("category").agg(F.avg("fraction").alias("mean"), F.stddev_samp("fraction").alias("std")).where("std > 1e-12")
    # One row per category of the list.
    z = dense(shares).join(F.broadcast(stats), "category").withColumn("d", F.abs(F.col("fraction") - F.col("mean")) / F.col("std"))
    return z.groupBy("file_id").agg(F.max("d").alias("max_deviation"), F.sum("d").alias("sum_deviation"))
