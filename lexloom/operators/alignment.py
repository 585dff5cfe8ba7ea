"""Alignment of sequences, fragments of books, retellings, summaries and similarity of texts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..session import cut
from .packing import packs


def edit_path(a: Sequence[str], b: Sequence[str], sim: np.ndarray | None = None, threshold: float = 0.5, drop_a: float = 1, drop_b: float = 3, change: float = 2) -> list[tuple[int, int, str]]:
    """(place in a or -1, place in b or -1, Matched, Transited or Deleted) of a cheapest alignment of two token lists.

    Costs: a token of a left out drop_a, of b drop_b; equal tokens 0; others `change`, or max(0, 10 (1 - cos) - 1) where
    their cosine exceeds the threshold. Borders cost the same as inside; ties: pairs first, then leaving out of a."""
    n, m = len(a), len(b)
    # Tokens as numbers: rows are compared at once.
    codes = pd.factorize(np.array([*a, *b], dtype=object))[0]
    x, y = codes[:n], codes[n:]

    def costs(i: int) -> np.ndarray:
        own = np.full(m, float(change))
        if sim is not None:
            near = sim[i] > threshold
            own[near] = np.minimum(change, np.maximum(0.0, 10 * (1 - sim[i][near]) - 1))
        own[y == x[i]] = 0.0
        return own

    steps = np.arange(m + 1) * drop_b

    def after(row: np.ndarray, i: int) -> np.ndarray:
        new = np.empty(m + 1)
        new[0] = (i + 1) * drop_a
        new[1:] = np.minimum(row[:-1] + costs(i), row[1:] + drop_a)
        # Leaving out of b again and again: the least of all beginnings.
        return np.minimum.accumulate(new - steps) + steps

    # Some sqrt(n) rows are kept, those between are computed again on the way back.
    block = max(1, math.isqrt(n))
    kept = [steps.astype(float)]
    row = kept[0]
    for i in range(n):
        row = after(row, i)
        if (i + 1) % block == 0:
            kept.append(row)
    out, i, j = [], n, m
    held, lowest = None, n + 1
    while i or j:
        if i and i - 1 < lowest:
            lowest = (i - 1) // block * block
            held = [kept[lowest // block]]
            for k in range(lowest, min(n, lowest + block)):
                held.append(after(held[-1], k))
        d = held[i - lowest] if held is not None else kept[0]
        if i and j and abs(d[j] - held[i - 1 - lowest][j - 1] - costs(i - 1)[j - 1]) < 1e-9:
            i, j = i - 1, j - 1
            out.append((i, j, "Matched" if a[i] == b[j] else "Transited"))
        elif i and abs(d[j] - held[i - 1 - lowest][j] - drop_a) < 1e-9:
            i -= 1
            out.append((i, -1, "Deleted"))
        else:
            j -= 1
            out.append((-1, j, "Deleted"))
    return out[::-1]


def aligned_tokens(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, place_a, place_b, status): token alignment of the texts that share a key. a, b: key, place, word."""
    both = a.select(key, F.lit(0).alias("side"), "place", "word").unionByName(b.select(key, F.lit(1).alias("side"), "place", "word"))
    kind = dict(both.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        x, y = pdf[pdf.side == 0].word.tolist(), pdf[pdf.side == 1].word.tolist()
        return pd.DataFrame([(pdf[key].iloc[0], i, j, s) for i, j, s in edit_path(x, y)], columns=[key, "place_a", "place_b", "status"])

    return both.groupBy(key).applyInPandas(run, f"{key} {kind}, place_a int, place_b int, status string")


#: Rows of a matching whose steps are held at once, at least, and similarities worked out at once, at most.
BLOCK, CELLS = 256, 1 << 22


def _advance(best: np.ndarray, sim, rows: range, at: int, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The greatest sums after the given rows, for the columns from `at` on, and with keep the steps (bits) of each row."""
    width, steps = len(best), []
    for first in range(rows.start, rows.stop, few := max(1, CELLS // width)):
        s = sim(slice(first, min(first + few, rows.stop)), slice(at, at + width))
        for i, x in enumerate(s, first):
            go = np.concatenate(([-np.inf], best[:-1]))
            step = (go >= best) & (go > -np.inf)
            if i:
                best = x + np.where(go > best, go, best)
            else:
                best = np.full(width, -np.inf)
                best[0] = x[0]
            if keep:
                steps.append(np.packbits(step))
    return best, np.array(steps) if keep else None


def _path(n: int, m: int, sim) -> list[int]:
    """The column of each of n rows in the matching `monotone` describes; sim(rows, columns) gives the similarities of two slices.

    Sums are kept at the head of each block of rows and steps for one block at a time, worked out again on the way back: some
    sqrt(n) rows instead of n. Columns from which the last one can't be reached any more are left out."""
    size, best, heads = max(BLOCK, math.isqrt(n)), np.full(m, -np.inf), []
    for start in range(0, n, size):
        rows = range(start, min(start + size, n))
        at, end = max(0, m - n + start - 1) if n >= m else 0, min(rows.stop, m)
        heads.append((rows, at, best[at:end].copy()))
        best[at:end] = _advance(best[at:end], sim, rows, at, False)[0]
    j = m - 1 if n >= m else int(np.argmax(best))
    out = [0] * n
    for rows, at, head in reversed(heads):
        steps = _advance(head, sim, rows, at, True)[1]
        for i in reversed(rows):
            out[i] = j
            j -= int(steps[i - rows.start, (j - at) >> 3] >> (7 - ((j - at) & 7))) & 1
    return out


def monotone(sim: np.ndarray) -> dict[int, int]:
    """row -> column: the non-decreasing matching, one step at a time from (0, 0), with the greatest similarity; every
    column is met if there are at least as many rows. Ties: the step to the next column."""
    n, m = sim.shape
    return dict(enumerate(_path(n, m, lambda rows, columns: sim[rows, columns]))) if n and m else {}


def matched_vectors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, place_a, place_b): monotone matching by cosine. a, b: key, place, vec array; the longer side is the rows.

    A key is one task: shorter side x (difference of the sides + a block of rows) similarities, none of them kept."""
    both = a.select(key, F.lit(0).alias("side"), "place", "vec").unionByName(b.select(key, F.lit(1).alias("side"), "place", "vec"))
    kind = dict(both.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
        cols = [key, "place_a", "place_b"]
        if not len(x) or not len(y):
            return pd.DataFrame([], columns=cols)
        u, v = np.array(x.vec.tolist(), dtype=float), np.array(y.vec.tolist(), dtype=float)
        norm = lambda t: t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        u, v = norm(u), norm(v)
        long, short = (u, v) if len(u) >= len(v) else (v, u)
        places = np.array(_path(len(long), len(short), lambda rows, columns: long[rows] @ short[columns].T))
        i, j = (np.arange(len(long)), places) if long is u else (places, np.arange(len(long)))
        return pd.DataFrame({key: pdf[key].iloc[0], "place_a": x.place.to_numpy()[i], "place_b": y.place.to_numpy()[j]}, columns=cols)

    return both.groupBy(key).applyInPandas(run, f"{key} {kind}, place_a int, place_b int")


def fragments(sentences: DataFrame, key: str, limit: int = 500) -> DataFrame:
    """(key, fragment, text_type, start_id, end_id, text): runs of sentences of one type (dialog or narrative), closed
    before `limit` tokens are reached. sentences: key, sentence_id, tokens, is_dialog, start_id, end_id, text.

    Sentences are packed in parallel (see packing); both types have their own ids and limits."""
    kind = F.when(F.col("is_dialog"), "dialog").otherwise("narrative")
    own = sentences.withColumn("text_type", kind).withColumn("_k", F.concat_ws("/", kind, F.col(key).cast("string")))
    placed = packs(own, "_k", "sentence_id", "tokens", limit + 1).withColumnRenamed("pack", "fragment")
    flat = own.join(placed, ["_k", "sentence_id"])
    return flat.groupBy(key, "text_type", "fragment").agg(
        F.min("start_id").alias("start_id"), F.max("end_id").alias("end_id"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def fragments_json(frags: DataFrame, key: str, prompt: str) -> DataFrame:
    """(key, json): one document per record."""
    item = F.struct(F.concat_ws("-", "text_type", "fragment").alias("id"), F.col(key).alias("file_id"), "text_type", "text", F.lit("").alias("retell"), F.col("start_id").alias("word_start_id"), F.col("end_id").alias("word_end_id"))
    return frags.groupBy(key).agg(F.to_json(F.struct(F.lit(prompt).alias("prompt"), F.sort_array(F.collect_list(item)).alias("fragments"))).alias("json"))


def pretty_retell(response: Column) -> Column:
    """Bulleted lines joined to one text: three characters off each line, a full stop where none stands."""
    lines = F.filter(F.split(response, "\n"), lambda x: F.trim(x) != "")
    clean = F.transform(lines, lambda x: F.trim(F.substring(x, 4, 1_000_000)))
    return F.array_join(F.transform(clean, lambda x: F.when(x.rlike("[.!?…]$"), x).otherwise(F.concat(x, F.lit(".")))), " ")


def retells(frags: DataFrame, responses: DataFrame) -> DataFrame:
    """(file_id, run, text): fragments (id, file_id, ordinal) with responses (id, response); consecutive ones of a file make a run.

    ordinal counts the fragments that have a response without gaps, so that runs show without a look at the row before."""
    j = frags.join(responses, "id").withColumn("text", pretty_retell(F.col("response")))
    w = Window.partitionBy("file_id").orderBy("ordinal")
    runs = j.withColumn("_i", F.col("ordinal") - F.row_number().over(w)).withColumn("run", F.dense_rank().over(Window.partitionBy("file_id").orderBy("_i")) - 1)
    return runs.groupBy("file_id", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))


def reversed_edges(relation: DataFrame) -> DataFrame:
    """Edges in both directions, once each; edges of a file to itself are left out."""
    r = relation.select("file_1", "file_2", "relation_name")
    return r.unionByName(r.select(F.col("file_2").alias("file_1"), F.col("file_1").alias("file_2"), "relation_name")).where("file_1 != file_2").distinct()


def readable(text: Column) -> Column:
    """Without the blanks that tokens leave before punctuation."""
    return F.regexp_replace(text, "\\s+([.,!?;:…»)])", "$1")


def zipped(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of two lists paired by place within the key, as far as both go."""
    n = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    return n(a).alias("a").join(n(b).alias("b"), [key, "place"]).select(key, "place", *[F.col(f"a.{c}").alias(f"a_{c}") for c in a.columns if c != key], *[F.col(f"b.{c}").alias(f"b_{c}") for c in b.columns if c != key])


def by_header(a: DataFrame, b: DataFrame, key: str, header: str, order: str) -> DataFrame:
    """(key, header, place, a_.., b_..): chapters of two editions that begin with the same header text, then one for one: the k-th
    after a header in one with the k-th after it in the other. a, b: key, order, header (null inside a chapter)."""

    def placed(df: DataFrame) -> DataFrame:
        clean = F.lower(F.trim(F.col(header)))
        w = Window.partitionBy(key).orderBy(order)
        h = df.withColumn("_h", F.last(clean, ignorenulls=True).over(w)).where("_h is not null")
        return h.withColumn("place", F.row_number().over(Window.partitionBy(key, "_h").orderBy(order)) - 1)

    x, y = placed(a).select(key, "_h", "place", F.col(order).alias(f"a_{order}")), placed(b).select(key, "_h", "place", F.col(order).alias(f"b_{order}"))
    return x.join(y, [key, "_h", "place"]).withColumnRenamed("_h", header)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def count_cosine(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, cosine) of word counts. a, b: key, word."""
    n = lambda df, c: df.groupBy(key, "word").agg(F.count(F.lit(1)).alias(c))
    j = n(a, "x").join(n(b, "y"), [key, "word"], "full").na.fill(0, ["x", "y"])
    return j.groupBy(key).agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("cosine"))


def bootstrap(df: DataFrame, key: str, value: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(low, middle, high): 2.5, 50 and 97.5 percentiles of the mean over Poisson resamples; one pass, partial sums only."""
    each = df.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "round", key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # Poisson(1) by inverse distribution.
    k, p, c = F.lit(0), 0.36787944117144233, 0.0
    steps = []
    for i in range(8):
        c += p
        p /= i + 1
        steps.append(c)
    for s in steps:
        k = k + (u > s).cast("int")
    means = each.withColumn("k", k).groupBy("round").agg(F.try_divide(F.sum(F.col("k") * F.col(value)), F.sum("k")).alias("m"))
    return means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p")).select(F.col("p")[0].alias("low"), F.col("p")[1].alias("middle"), F.col("p")[2].alias("high"))


def summary(words: DataFrame, key: str, k: int) -> DataFrame:
    """(key, sentence_id, score): the k sentences of each text that share most words with its other sentences.

    words: key, sentence_id, word. Score = for each distinct word of the sentence, the other sentences that have it:
    a count per word, not a join of sentences with sentences."""
    d = words.select(key, "sentence_id", "word").distinct()
    others = F.count(F.lit(1)).over(Window.partitionBy(key, "word")) - 1
    score = d.withColumn("o", others).groupBy(key, "sentence_id").agg(F.sum("o").alias("score"))
    return score.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "sentence_id"))).where(F.col("n") <= k).drop("n")


def vector_summary(sentences: DataFrame, key: str, k: int) -> DataFrame:
    """(key, sentence_id, score): the k sentences of each text nearest (cosine) to the mean vector of its sentences.

    sentences: key, sentence_id, vec array. The mean is taken by place of the vector, so no text's vectors are gathered."""
    places = sentences.select(key, "sentence_id", F.posexplode("vec").alias("place", "x"))
    mean = places.groupBy(key, "place").agg(F.avg("x").alias("m"))
    sums = places.join(mean, [key, "place"]).groupBy(key, "sentence_id").agg(F.sum(F.col("x") * F.col("m")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    score = sums.select(key, "sentence_id", F.try_divide("dot", F.sqrt(F.col("xx") * F.col("mm"))).alias("score"))
    return score.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "sentence_id"))).where(F.col("n") <= k).drop("n")


#: Bytes of query vectors that are sent to all executors at a time.
QUERY_BYTES = 64 << 20


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, block: int = 512) -> DataFrame:
    """(query, other, cosine): the k nearest vectors to each query, exactly. `queries` is a stated set: it comes in blocks
    of `block` that are compared with every partition of all vectors; only k per query and partition move on. A query
    set of more than QUERY_BYTES takes several passes over all vectors, each of which sends so much of it and is written
    before the next."""
    q = queries.select(F.col(key).alias("query"), F.col(vec).alias("qv")).where("qv is not null")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qv")).alias("d")).first()
    passes = -(-(size.n or 0) * (size.d or 0) * 8 // QUERY_BYTES) or 1
    if passes == 1:
        return _nearest(vectors, q, key, vec, k, block)
    out = None
    for p in range(passes):
        own = cut(_nearest(vectors, q.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p), key, vec, k, block))
        out = own if out is None else out.unionByName(own)
    return out


def _nearest(vectors: DataFrame, q: DataFrame, key: str, vec: str, k: int, block: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = q.collect()
    if not rows:
        return spark.createDataFrame([], "query long, other long, cosine double")
    ids = np.array([r.query for r in rows])
    m = np.array([r.qv for r in rows], dtype=float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    held = spark.sparkContext.broadcast((ids, m))

    def run(parts):
        qi, qm = held.value
        for part in parts:
            x = np.array(part[vec].tolist(), dtype=float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            o = part[key].to_numpy()
            for lo in range(0, len(qi), block):
                s = qm[lo : lo + block] @ x.T
                s[qi[lo : lo + block, None] == o[None, :]] = -2
                t = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query": np.repeat(qi[lo : lo + block], t.shape[1]), "other": o[t].ravel(), "cosine": np.take_along_axis(s, t, 1).ravel()}).query("cosine > -2")

    near = vectors.select(key, vec).where(F.col(vec).isNotNull()).mapInPandas(run, "query long, other long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def vocab_vector(words: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """A vector for each word (vocabulary: term, vec): its own; of a hyphenated one the sum of its parts'; else zeros."""
    zeros = F.array_repeat(F.lit(0.0), size)
    direct = words.join(vocabulary.select(F.col("term").alias("word"), "vec"), "word", "left")
    parts = direct.where("vec is null and word like '%-%'").select("word", F.explode(F.split("word", "-")).alias("term")).distinct().join(vocabulary, "term")
    summed = parts.groupBy("word").agg(F.collect_list("vec").alias("vs")).select("word", F.aggregate("vs", zeros, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double"))).alias("sum"))
    return direct.join(summed, "word", "left").select(*words.columns, F.coalesce(F.transform("vec", lambda x: x.cast("double")), "sum", zeros).alias("vec"))


def vector_cosine(a: str, b: str) -> Column:
    return cosine(F.col(a), F.col(b))
