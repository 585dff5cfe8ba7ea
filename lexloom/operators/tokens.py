"""Token tables: parsing texts, ids, packing into frames, and back to text.

The token table: word_id, sentence_id, word_index, paragraph_id, word_tail, word, word_type, word_length, with a
record key in front. Ids are unique within a record, or everywhere after `global_ids`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .packing import packs
from .relational import dense_rank_in

#: Word ids in a block of text that is put together in one place.
TEXT_BLOCK = 4096
#: Word ids of a record that are ranked in one place.
WORD_BLOCK = 1 << 16
#: The block of words without an id, before all others.
NO_BLOCK = -(1 << 63)
ID_COLUMNS = ("word_id", "sentence_id", "paragraph_id")
TOKENS = T.StructType(
    [
        T.StructField("word_id", T.LongType()), T.StructField("sentence_id", T.LongType()), T.StructField("word_index", T.IntegerType()),
        T.StructField("paragraph_id", T.LongType()), T.StructField("word_tail", T.IntegerType()), T.StructField("word", T.StringType()),
        T.StructField("word_type", T.StringType()), T.StructField("word_length", T.IntegerType()),
    ]
)


def tokenize(df: DataFrame, text: str | Column, keys: Sequence[str], language: str = "ru") -> DataFrame:
    """One row per token of each text, with `keys`; ids count from 0 in each text. No shuffle.

    Lines are paragraphs (blank ones take an id and give no row), word_index restarts in each sentence, word_tail is
    the number of blanks after the token. Null and empty texts give no row; repeated rows give repeated tokens."""
    lines = X.paragraphs(F.col(text) if isinstance(text, str) else text)
    parts = F.flatten(F.transform(lines, lambda p, i: F.transform(X.sentences(p), lambda s: F.struct(i.cast("long").alias("p"), s.alias("s")))))
    tokens = F.flatten(
        F.transform(
            parts,
            lambda x, k: F.transform(
                X.token_pieces(x["s"], language),
                lambda t, j: F.struct(k.cast("long").alias("sentence_id"), j.cast("int").alias("word_index"), x["p"].alias("paragraph_id"), t.alias("piece")),
            ),
        )
    )
    out = df.select(*keys, F.posexplode(tokens).alias("word_id", "t"))
    word = X.bare(F.col("t.piece"))
    return out.select(
        *keys,
        F.col("word_id").cast("long").alias("word_id"),
        F.col("t.sentence_id").alias("sentence_id"),
        F.col("t.word_index").alias("word_index"),
        F.col("t.paragraph_id").alias("paragraph_id"),
        (F.length("t.piece") - F.length(word)).cast("int").alias("word_tail"),
        word.alias("word"),
        X.word_type(word, language).alias("word_type"),
        F.length(word).cast("int").alias("word_length"),
    )


def _starts(sizes: pd.Series) -> pd.Series:
    return pd.Series([np.cumsum([0, *n])[:-1].astype("int64") for n in sizes])


def sentence_rows(df: DataFrame, text: str, keys: Sequence[str], dashes: Sequence[str], language: str = "ru") -> DataFrame:
    """(keys, sentence_id, tokens, is_dialog, start_id, end_id, text): what the token table of each text says of its sentences,
    straight from the text: no row per token, no shuffle. is_dialog: the first word of its paragraph is one of `dashes`.

    Texts must be there once each, as ids are those of `tokenize`."""
    pieces = F.transform(X.paragraphs(F.col(text)), lambda p: F.transform(X.sentences(p), lambda s: X.token_pieces(s, language)))
    lines = df.select(*keys, pieces.alias("_p"))
    spoken = lambda p: F.coalesce(X.bare(F.get(F.flatten(p), F.lit(0))).isin(*dashes), F.lit(False))
    own = F.flatten(F.transform("_p", lambda p: F.transform(p, lambda w: F.struct(w.alias("w"), spoken(p).alias("d")))))
    starts = F.pandas_udf(_starts, "array<long>")(F.transform(F.flatten("_p"), lambda w: F.size(w)))
    rows = lines.select(*keys, "_p", starts.alias("_s")).where("_p is not null").select(*keys, F.posexplode(F.arrays_zip(own.alias("x"), F.col("_s").alias("s"))).alias("sentence_id", "_x"))
    w = F.col("_x.x.w")
    blank = F.rtrim(F.array_join(F.transform(w, lambda t: F.rpad(X.bare(t), F.length(t), F.lit(" "))), ""))
    return rows.where(F.size(w) > 0).select(
        *keys, F.col("sentence_id").cast("long").alias("sentence_id"), F.size(w).cast("long").alias("tokens"), F.col("_x.x.d").alias("is_dialog"),
        F.col("_x.s").alias("start_id"), (F.col("_x.s") + F.size(w) - 1).alias("end_id"), blank.alias("text"),
    )


def from_words(df: DataFrame, words: str, keys: Sequence[str], language: str = "en") -> DataFrame:
    """A token table of a list of words: one sentence, one blank after each."""
    w = F.col("word")
    return df.select(*keys, F.posexplode(words).alias("word_id", "word")).select(
        *keys, F.col("word_id").cast("long").alias("word_id"), F.lit(0).cast("long").alias("sentence_id"), F.col("word_id").cast("int").alias("word_index"),
        F.lit(0).cast("long").alias("paragraph_id"), F.lit(1).cast("int").alias("word_tail"), w.alias("word"), X.word_type(w, language).alias("word_type"), F.length(w).cast("int").alias("word_length"),
    )


def clean(src: DataFrame) -> DataFrame:
    """A token table without repeated rows (word_id is its key); which of two differing rows stays is not defined."""
    return src.dropDuplicates(["word_id"])


def record_stats(tokens: DataFrame, key: str) -> DataFrame:
    """Per record: tokens, characters, sentences, paragraphs and the smallest id that is free again (max + 2)."""
    return tokens.groupBy(key).agg(
        F.count(F.lit(1)).alias("token_count"),
        F.sum("word_length").cast("long").alias("character_count"),
        F.count_distinct("sentence_id").alias("sentence_count"),
        F.count_distinct("paragraph_id").alias("paragraph_count"),
        (F.greatest(*[F.max(c) for c in ID_COLUMNS]) + 2).alias("max_id"),
    )


def reset_ids(tokens: DataFrame, key: str, offset: int = 0, originals: bool = True) -> DataFrame:
    """Dense ids from `offset` on in each record; the old ones stay as original_*, `updated` is false."""
    old = {f"original_{c}": F.col(c) for c in ID_COLUMNS} if originals else {}
    out = tokens.withColumns(old)
    for c in ID_COLUMNS:
        out = dense_rank_in(out, [key], c, "_new")
        # Null ids rank first; they stay null.
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col("_new") - 1 + F.lit(offset)).cast("long")).drop("_new")
    return out.withColumn("updated", F.lit(False))


def invalid_ids(tokens: DataFrame) -> DataFrame:
    """What is wrong with a token table: (problem, rows). Empty if nothing is."""
    nulls = [tokens.select(F.lit(f"null {c}").alias("problem"), F.col(c).isNull().alias("bad")) for c in ("word_id", "word", "word_length")]
    twice = tokens.groupBy("word_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("word_id comes twice").alias("problem"), (F.col("n") > 1).alias("bad"))
    out = twice
    for n in nulls:
        out = out.unionByName(n)
    return out.groupBy("problem").agg(F.count_if("bad").alias("rows")).where("rows > 0")


def global_ids(tokens: DataFrame, key: str, span: int = 10_000) -> DataFrame:
    """Ids unique over all records: each record is moved behind the one before (in the order of its key).

    Offsets are a running sum over one row per record, kept in ranges of the key's hash order so that no task sees all
    records: per range a sum, a running sum over the ranges, and one inside each."""
    sizes = tokens.groupBy(key).agg((F.greatest(*[F.max(c) for c in ID_COLUMNS]) + 2 + span).alias("room")).withColumn("range", F.pmod(F.xxhash64(key), F.lit(4096)))
    ranges = sizes.groupBy("range").agg(F.sum("room").alias("sum"))
    # 4096 rows.
    before = ranges.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))
    inside = F.sum("room").over(Window.partitionBy("range").orderBy(key)) - F.col("room")
    offsets = sizes.withColumn("inside", inside).join(F.broadcast(before), "range").select(key, (F.col("inside") + F.col("before")).alias("offset"))
    return tokens.join(offsets, key).withColumns({c: F.col(c) + F.col("offset") for c in ID_COLUMNS}).drop("offset")


def word_block() -> Column:
    """The range of word ids that a word is in."""
    return F.coalesce(F.floor(F.col("word_id") / WORD_BLOCK), F.lit(NO_BLOCK))


def fresh_ids(tokens: DataFrame, key: str, span: int, offset: int, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What reset_ids and then global_ids give, from `offset` on, for a table that is read cheaply (it is read several times).

    Sentences and paragraphs are ranked among their distinct values, so that whole rows move twice only: to meet these, and into the
    ranges of word ids in which words are ranked. kept: may write down rows between the two, so that the files of the first move go, and what is read more than once."""
    marks = [key, "sentence_id", "paragraph_id"]
    # What is read again and again is written down as well.
    ranked = kept(tokens.select(*marks).distinct())
    for c in marks[1:]:
        ranked = kept(dense_rank_in(ranked, [key], c, f"_{c}"))
    ranked = ranked.withColumns({f"_{c}": F.when(F.col(c).isNotNull(), F.col(f"_{c}") - 1) for c in marks[1:]})
    block = word_block()
    # A row for each range of word ids that a record reaches into; null ids rank first.
    sizes = tokens.select(key, block.alias("_block"), "word_id").groupBy(key, "_block").agg((F.count_distinct("word_id") + F.max(F.col("word_id").isNull().cast("int"))).alias("_size"))
    before = kept(sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(key).orderBy("_block")) - F.col("_size")))
    last = before.groupBy(key).agg(F.max(F.when(F.col("_block") != NO_BLOCK, F.col("_before") + F.col("_size") - 1)).alias("_w"))
    last = last.join(ranked.groupBy(key).agg(F.max("_sentence_id").alias("_s"), F.max("_paragraph_id").alias("_p")), key)
    room = last.select(key, (F.greatest("_w", "_s", "_p") + 2 + span).alias("room")).withColumn("range", F.pmod(F.xxhash64(key), F.lit(4096)))
    ranges = room.groupBy("range").agg(F.sum("room").alias("sum"))
    # 4096 rows.
    upto = ranges.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("upto"))
    inside = F.sum("room").over(Window.partitionBy("range").orderBy(key)) - F.col("room")
    offsets = room.withColumn("inside", inside).join(F.broadcast(upto), "range").select(key, (F.col("inside") + F.col("upto") + offset).alias("_offset"))
    new = ranked.join(offsets, key).withColumns({f"_{c}": F.col(f"_{c}") + F.col("_offset") for c in marks[1:]})
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.col("a.sentence_id").eqNullSafe(F.col("b.sentence_id")) & F.col("a.paragraph_id").eqNullSafe(F.col("b.paragraph_id"))
    rows = tokens.alias("a").join(new.alias("b"), same).select("a.*", "b._sentence_id", "b._paragraph_id", "b._offset").withColumn("_block", block)
    rows = kept(rows).withColumn("_rank", F.dense_rank().over(Window.partitionBy(key, "_block").orderBy("word_id")))
    # By the same columns as the window: rows don't move again.
    met = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._block") == F.col("b._block"))
    rows = rows.alias("a").join(before.alias("b"), met).select("a.*", "b._before")
    word = F.when(F.col("word_id").isNotNull(), F.col("_rank") + F.col("_before") - 1 + F.col("_offset"))
    out = rows.withColumns(
        {f"original_{c}": F.col(c) for c in ID_COLUMNS} | {"word_id": word.cast("long"), "sentence_id": F.col("_sentence_id").cast("long"), "paragraph_id": F.col("_paragraph_id").cast("long"), "updated": F.lit(False)}
    )
    return kept(out.drop("_sentence_id", "_paragraph_id", "_offset", "_block", "_rank", "_before"))


def packed(tokens: DataFrame, key: str, words_per_frame: int) -> DataFrame:
    """(key, sentence_id, frame): sentences packed greedily into frames of fewer than `words_per_frame` words.

    A frame never spans records; a sentence of that many words or more is a frame of its own. Sentences of one record
    are packed in parallel (see packing)."""
    lengths = tokens.where("sentence_id is not null").groupBy(key, "sentence_id").agg(F.count(F.lit(1)).alias("len"))
    return packs(lengths, key, "sentence_id", "len", words_per_frame).withColumnRenamed("pack", "frame")


def to_text(tokens: DataFrame, key: str) -> DataFrame:
    """(key, text): tokens with their blanks; paragraphs that follow one another are parted by one line break."""
    piece = F.concat(F.col("word"), F.repeat(F.lit(" "), F.col("word_tail")))
    own = tokens.select(key, F.expr(f"floor(word_id / {TEXT_BLOCK})").alias("block"), F.struct("word_id", F.col("paragraph_id").alias("p"), piece.alias("t")).alias("x"))
    lists = own.groupBy(key, "block").agg(F.sort_array(F.collect_list("x")).alias("l"))
    # A block of word ids becomes one string; a line break stands before a piece that begins another paragraph.
    inner = "array_join(transform(l, (x, i) -> concat(if(i > 0 and x.p != l[i - 1].p, '\\n', ''), x.t)), '')"
    parts = lists.select(key, F.struct("block", F.expr("l[0].p").alias("first"), F.expr("element_at(l, -1).p").alias("last"), F.expr("l[0].t is not null").alias("shown"), F.expr(inner).alias("t")).alias("b"))
    whole = parts.groupBy(key).agg(F.sort_array(F.collect_list("b")).alias("bs"))
    outer = "array_join(transform(bs, (x, i) -> concat(if(i > 0 and x.shown and x.first != bs[i - 1].last, '\\n', ''), x.t)), '')"
    return whole.select(key, F.expr(outer).alias("text"))


def sentence_strings(tokens: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, text): the text of each sentence (or other group), blanks at its end dropped."""
    piece = F.concat(F.col("word"), F.repeat(F.lit(" "), F.col("word_tail")))
    lists = tokens.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("word_id", piece.alias("piece")))).alias("l"))
    return lists.select(*group, F.rtrim(F.array_join(F.transform("l", lambda x: x["piece"]), "")).alias("text"))


def to_html(tokens: DataFrame, key: str, value: str | None = None, colors: dict[str, str] | None = None, tooltip: str | None = None) -> DataFrame:
    """(key, html): one <p> per paragraph; words whose `value` has a colour stand in a coloured span, with a title if a
    tooltip column is named. Text is escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    color = F.lit(None).cast("string")
    for v, c in (colors or {}).items():
        color = F.when(F.col(value) == v, c).otherwise(color)
    style = F.when(color.isNotNull(), F.concat(F.lit(' style="background-color:'), color, F.lit(';"'))).otherwise("")
    title = F.when(F.col(tooltip).isNotNull(), F.concat(F.lit(' title="'), esc(F.col(tooltip).cast("string")), F.lit('"'))).otherwise("") if tooltip else F.lit("")
    span = F.concat(style, title)
    word = F.when(span != "", F.concat(F.lit("<span"), span, F.lit(">"), esc(F.col("word")), F.lit("</span>"))).otherwise(esc(F.col("word")))
    piece = F.concat(word, F.repeat(F.lit(" "), F.col("word_tail")))
    lists = tokens.groupBy(key, "paragraph_id").agg(F.sort_array(F.collect_list(F.struct("word_id", piece.alias("piece")))).alias("l"))
    p = lists.select(key, "paragraph_id", F.concat(F.lit("<p>"), F.array_join(F.transform("l", lambda x: x["piece"]), ""), F.lit("</p>")).alias("p"))
    return p.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("paragraph_id", "p"))).alias("l")).select(key, F.array_join(F.transform("l", lambda x: x["p"]), "\n").alias("html"))


def gradient(column: Column, low: Column, high: Column) -> Column:
    """A colour from white to red by where a number lies between two others."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(column - low, high - low)))
    rest = F.lpad(F.lower(F.hex(F.round(255 * (1 - share)).cast("long"))), 2, "0")
    return F.concat(F.lit("#ff"), rest, rest)


def tree_dot(edges: DataFrame, key: str, node: str, parent: str, label: str) -> DataFrame:
    """(key, dot): a dependency tree as the text of a directed graph; the root (parent -1) has no edge."""
    line = F.concat(F.lit('n'), F.col(node).cast("string"), F.lit(' [label="'), F.replace(F.col(label), F.lit('"'), F.lit("'")), F.lit('"];'),
                    F.when(F.col(parent) >= 0, F.concat(F.lit(" n"), F.col(parent).cast("string"), F.lit(" -> n"), F.col(node).cast("string"), F.lit(";"))).otherwise(""))
    lists = edges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(node, line.alias("line")))).alias("l"))
    return lists.select(key, F.concat(F.lit("digraph {\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("dot"))


def sample_table(df: DataFrame, category: str, example: str, n: int, categories: Sequence[str], rarest_first: bool = False) -> DataFrame:
    """Per category its rows and its n most frequent (or rarest) examples side by side as c0..c<n-1>."""
    counts = df.groupBy(category, example).agg(F.count(F.lit(1)).alias("n"))
    order = [F.asc("n") if rarest_first else F.desc("n"), F.col(example)]
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(category).orderBy(*order)) - 1)
    picks = [F.max(F.when(F.col("r") == k, F.col(example))).alias(f"c{k}") for k in range(n)]
    out = ranked.groupBy(category).agg(F.sum("n").alias("popularity"), *picks)
    return out.where(F.col(category).isin(*categories)) if categories else out
