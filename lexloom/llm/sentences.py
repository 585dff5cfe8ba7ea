"""Sentence boundaries of documents and of token tables (see transducer.py for the rules)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import glyphs
from .transducer import CONTEXT, KINDS, LONGEST_WORD, START, STATES, line_shape, line_width, run_chunk

#: Characters in a chunk, tokens in a chunk, chunks in a block. BLOCK * BLOCK * CHUNK exceeds the longest string there is.
CHUNK, TOKENS, BLOCK = 8192, 2048, 1024
#: Tokens of the neighbouring chunks that a chunk of tokens sees.
NEAR = 48
#: Texts of more chunks than this are spread over the cluster; shorter ones stay in the task that reads them.
SPREAD = 64

_FUNCTION = "record string, copy long, chunk long, ends array<int>, events array<struct<at:long,mask:long>>"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by keys into a stated number of parts: what is few bytes but much work is not to be packed
    into a few tasks for being small."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def _run_texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for record, copy, chunk, left, core, right, width in zip(*(part[c] for c in ("record", "copy", "chunk", "left", "core", "right", "width"))):
            lo = len(left)
            ends, events = run_chunk(left + core + right, lo, lo + len(core), chunk * CHUNK - lo, chunk == 0, width)
            rows.append((record, copy, chunk, ends, [{"at": a, "mask": m} for a, m in events]))
        yield pd.DataFrame(rows, columns=["record", "copy", "chunk", "ends", "events"])


def _widths(heads: pd.Series, sizes: pd.Series, tails: pd.Series) -> pd.Series:
    """line_width of each text, of whose lines come the sizes and so many characters of both ends as bear on it."""
    out = []
    for head, size, tail in zip(heads, sizes, tails):
        # A line as long as the true one, with its ends.
        lines = [t.rjust(n, "x") if len(t) < n else t for t, n in zip(tail, size)]
        shapes = [x for k in range(len(lines) - 1) for x in line_shape([lines[k], head[k + 1]])]
        out.append(line_width(shapes, size.tolist()))
    return pd.Series(out, dtype="int32")


def _chunks(texts: DataFrame) -> DataFrame:
    """(record, copy, content) -> chunks with CONTEXT characters of their neighbours, and the width of the text's lines; one
    linear pass over each text. For the width no more than both ends of each line go to Python."""
    lines = texts.withColumn("lines", F.expr("if(instr(content, '\n') > 0, transform(split(content, '\n'), x -> rtrim(x)), null)"))
    heads, sizes, tails = (F.expr(f"transform(coalesce(lines, array()), x -> {x})") for x in (f"left(x, {LONGEST_WORD + 1})", "length(x)", f"right(x, {LONGEST_WORD + 1})"))
    width = F.when(F.col("lines").isNotNull(), F.pandas_udf(_widths, "int")(heads, sizes, tails)).otherwise(0)
    cut = lines.withColumn("width", width).drop("lines").withColumn("pieces", F.expr(f"regexp_extract_all(content, '(?s).{{1,{CHUNK}}}', 0)")).drop("content")
    spread = F.expr(
        f"transform(pieces, (c, i) -> struct(cast(i as long) as chunk, "
        f"if(i > 0, right(try_element_at(pieces, i), {CONTEXT}), '') as left, c as core, "
        f"coalesce(left(try_element_at(pieces, i + 2), {CONTEXT}), '') as right))"
    )
    return cut.select("record", "copy", "width", F.inline(spread))


def _compose(functions: DataFrame) -> DataFrame:
    """(record, copy, start_at): parallel prefix scan over chunk functions, then the boundaries of each chunk for its true start state.

    Three levels: chunks compose within blocks of BLOCK, blocks within a record (at most BLOCK of them hold chunks of
    one string), and each chunk is given the state in which its block and its predecessors leave the transducer.
    Groups are bounded: BLOCK chunks of STATES numbers and their boundaries."""
    through = "aggregate({items}, {start}, (s, x) -> element_at(x.ends, s + 1))"
    identity = "array(" + ",".join(map(str, range(STATES))) + ")"
    blocks = (
        functions.groupBy("record", "copy", F.expr(f"chunk div {BLOCK}").alias("block"))
        .agg(F.collect_list(F.struct("chunk", "ends", "events")).alias("items"))
        # Exact copies of a text give equal items; one of them is enough.
        .withColumn("items", F.expr("sort_array(array_distinct(items))"))
        .withColumn("ends", F.expr(f"aggregate(items, {identity}, (f, x) -> transform(f, s -> element_at(x.ends, s + 1)))"))
    )
    before = "collect_list(struct(block, ends)) over (partition by record, copy order by block rows between unbounded preceding and 1 preceding)"
    states = (
        blocks.withColumn("earlier", F.expr(before))
        .withColumn("start", F.expr(through.format(items="earlier", start=START)))
        .withColumn(
            "starts",
            F.expr("aggregate(items, array(start), (a, x) -> concat(a, array(element_at(x.ends, element_at(a, -1) + 1))))"),
        )
    )
    chunks = states.select("record", "copy", F.expr("inline(transform(items, (x, i) -> struct(x.events as events, element_at(starts, i + 1) as start)))"))
    events = chunks.select("record", "copy", "start", F.expr("inline(events)"))
    return events.where(F.expr("(shiftright(mask, start) & 1) = 1")).select("record", "copy", F.col("at").alias("start_at"))


def text_sentences(texts: DataFrame, record: str, content: str) -> DataFrame:
    """The sentences of texts: (record, start_at), start_at = 0-based character of the first non-blank character.

    Null, empty and blank texts have no sentence. Repeated rows and copies of a record count once; a record that
    comes with two different texts gets the sentences of both. Other columns of `texts` don't matter. Texts of any
    length: they are cut into chunks that are worked on independently."""
    return _text_starts(texts, record, content).select("record", "start_at").distinct()


def _copy(content: str) -> Column:
    """What tells the texts of one record apart."""
    return F.xxhash64(F.col(content))


def _text_starts(texts: DataFrame, record: str, content: str) -> DataFrame:
    """(record, copy, start_at): the sentences of each text of a record."""
    rows = texts.select(F.col(record).cast("string").alias("record"), _copy(content).alias("copy"), F.col(content).alias("content"))
    rows = rows.where("content is not null and record is not null and content != ''")
    schema = _FUNCTION
    long = F.length("content") > CHUNK * SPREAD
    short_part = spread(_chunks(rows.where(~long))).mapInPandas(_run_texts, schema)
    # A few very long texts: their chunks go to all executors.
    long_part = _chunks(rows.where(long)).repartition("record", "chunk").mapInPandas(_run_texts, schema)
    return _compose(short_part.unionByName(long_part)).distinct()


def _token_text(part: pd.DataFrame) -> tuple[str, list[int], list[int]]:
    """The text of tokens in order, a blank line between paragraphs; where each token begins; ids."""
    out, at, places, ids, paragraph = [], 0, [], [], None
    words = part.word.tolist()
    tails = part.word_tail.fillna(0).astype(int).tolist()
    for k, (i, w, tail, p) in enumerate(zip(part.word_id, words, tails, part.paragraph_id)):
        if paragraph is not None and p != paragraph:
            out.append("\n\n")
            at += 2
        paragraph = p
        if w is None or w != w:
            # An unknown token: after a word without a gap it is a mark, and before a capital most likely a full stop.
            nxt = words[k + 1] if k + 1 < len(words) else None
            glued = k > 0 and tails[k - 1] == 0 and isinstance(words[k - 1], str) and words[k - 1][-1:].isalnum()
            w = ("." if isinstance(nxt, str) and nxt[:1].isupper() else ",") if glued else "Ж"
        else:
            w = glyphs.plain_word(w) or "⁠"
        places.append(at)
        ids.append(i)
        piece = w + " " * max(0, tail)
        out.append(piece)
        at += len(piece)
    return "".join(out), places, ids


def _run_tokens(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    import bisect

    record, chunk = key
    part = part.drop_duplicates("word_id").sort_values("word_id")
    text, places, ids = _token_text(part)
    own = [k for k, i in enumerate(ids) if i // TOKENS == chunk]
    if not own:
        return pd.DataFrame([], columns=["record", "copy", "chunk", "ends", "events"], dtype=object)
    lo = places[own[0]]
    hi = places[own[-1] + 1] if own[-1] + 1 < len(places) else len(text)
    ends, events = run_chunk(text, lo, hi)
    seen = [{"at": int(ids[bisect.bisect_right(places, a) - 1]), "mask": m} for a, m in events]
    return pd.DataFrame([(record, 0, int(chunk), ends, seen)], columns=["record", "copy", "chunk", "ends", "events"])


def token_sentences(tokens: DataFrame) -> DataFrame:
    """The sentences of the files of a token table whose sentence_id is null: (record = file_id, start_at = word_id of
    the first token).

    Needs file_id, word_id, sentence_id, paragraph_id, word_tail, word; repeated rows count once, late rows stand
    where their word_id puts them. Null words: see _token_text; null ids are left out. Chunks are ranges of word_id of
    TOKENS, so none is larger than that whatever the size of a file."""
    rows = tokens.where("sentence_id is null and file_id is not null and word_id is not null").select(
        F.col("file_id").cast("string").alias("record"), "word_id", "paragraph_id", "word_tail", "word"
    )
    chunk = F.expr(f"word_id div {TOKENS}")
    place = F.expr(f"word_id % {TOKENS}")
    near = F.array_compact(
        F.array(chunk, F.when(place < NEAR, chunk - 1), F.when(place >= TOKENS - NEAR, chunk + 1))
    )
    functions = (
        dealt(rows.withColumn("chunk", F.explode(near)), "record", "chunk").groupBy("record", "chunk").applyInPandas(_run_tokens, _FUNCTION)
    )
    return _compose(functions).select("record", "start_at").distinct()


def sentence_texts(texts: DataFrame, record: str, content: str, *keep: str) -> DataFrame:
    """(record columns kept, sentences array<struct<start, text>> in order): each text with its sentences cut out.

    Texts without sentences are left out; of copies of a record with the same text one row comes out, of a record with
    different texts one for each, cut at its own boundaries."""
    starts = _text_starts(texts, record, content).groupBy("record", "copy").agg(F.sort_array(F.collect_list("start_at")).alias("starts"))
    rows = texts.select(F.col(record).cast("string").alias("record"), _copy(content).alias("copy"), F.col(content).alias("content"), *keep).dropDuplicates(["record", "copy"])
    cutter = F.pandas_udf(_slices, "array<struct<start:long,text:string>>")
    return rows.join(starts, ["record", "copy"]).withColumn("sentences", cutter("content", "starts")).drop("copy", "content", "starts")


def _slices(content: pd.Series, starts: pd.Series) -> pd.Series:
    out = []
    for text, at in zip(content, starts):
        ends = [*at[1:], len(text)]
        out.append([{"start": int(a), "text": " ".join(text[a:b].split())} for a, b in zip(at, ends)])
    return pd.Series(out)


assert START < STATES <= 63 and KINDS > 0
