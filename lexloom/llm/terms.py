"""Occurrences and record counts of all terms and n-grams by a distributed suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stands for "no further token" in a suffix; sorts before every token.
END = ""
#: A term is spread over so many places by its records, so that a frequent one is no single task.
SPREAD = 32
#: Width of the key ranges over which suffixes are formed.
BLOCK = 1 << 15

_PIECE = "size int, term string, record string, occurrences long, records long"


def suffixes(tokens: DataFrame, order: str, term: str, record: str, length: int) -> DataFrame:
    """(record, s1..s<length>): each token with the length - 1 tokens after it in its record, END where there is none.

    `order` is a whole number, unique, that grows within a record; gaps don't matter. Ranges of BLOCK keys are worked on
    apart, so that no record is gathered in one task; each is given the first tokens of the ranges of its record that
    follow."""
    if length == 1:
        return tokens.select(F.col(record).cast("string").alias("record"), F.col(term).alias("s1"))
    rows = tokens.select(F.col(record).cast("string").alias("record"), F.expr(f"floor({order} / {BLOCK})").alias("block"), F.col(order).alias("at"), F.col(term).alias("term"))
    w = Window.partitionBy("record", "block").orderBy("at")
    first = rows.withColumn("no", F.row_number().over(w)).where(F.col("no") < length)
    heads = first.groupBy("record", "block").agg(F.sort_array(F.collect_list(F.struct("at", "term"))).alias("head"))
    # One row for each range of a record; as none is empty, length - 1 of them hold all tokens that are needed.
    later = Window.partitionBy("record").orderBy("block")
    none = F.array().cast(heads.schema["head"].dataType)
    more = F.slice(F.concat(*[F.coalesce(F.lead("head", k).over(later), none) for k in range(1, length)]), 1, length - 1)
    extra = heads.select("record", "block", more.alias("more")).select("record", "block", F.inline("more"))
    every = rows.withColumn("own", F.lit(True)).unionByName(extra.withColumn("own", F.lit(False)))
    nexts = [F.coalesce(F.lead("term", k).over(w), F.lit(END)).alias(f"s{k + 1}") for k in range(length)]
    return every.select("record", "own", *nexts).where("own").drop("own")


def _piece(size: int, term: pa.Array, record: pa.Array | None, occurrences: np.ndarray, records: np.ndarray | None) -> pa.RecordBatch:
    rows = len(term)
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(size, pa.int32()), rows),
            term,
            pa.nulls(rows, pa.string()) if record is None else record,
            pa.array(occurrences, pa.int64()),
            pa.nulls(rows, pa.int64()) if records is None else pa.array(records, pa.int64()),
        ],
        names=["size", "term", "record", "occurrences", "records"],
    )


def common_prefixes(codes: list[np.ndarray]) -> np.ndarray:
    """Of sorted suffixes, given as one array of token codes for each place: how many tokens each has in common with the one before."""
    out = np.zeros(len(codes[0]), np.int64)
    same = np.ones(max(0, len(out) - 1), bool)
    for c in codes:
        same = same & (c[1:] == c[:-1])
        out[1:] += same
    return out


def duplicate_links(records: np.ndarray) -> np.ndarray:
    """Of sorted suffixes: the place of the last one before of the same record, -1 if none. -1 among the records is no record."""
    order = np.argsort(records, kind="stable")
    out = np.full(len(records), -1, np.int64)
    same = records[order[1:]] == records[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _intervals(length: int):
    """Over sorted suffixes (s1.., record, n): for each depth the common-prefix intervals, their occurrences and records.

    Where the common prefix with the suffix before is shorter than the depth, an interval begins. Its occurrences are its
    suffixes; its records are its occurrences less its duplicate adjacencies: suffixes whose last one of the same record
    stands in the same interval (equal suffixes of a record come as one row that counts n, n - 1 of them duplicates). An
    interval at a batch's edge may go on elsewhere: at full depth suffix and record never come twice, so its parts just
    add up; at a lower depth its records come out one by one and are counted after the parts are put together."""
    names = [f"s{k + 1}" for k in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            code = lambda c: np.asarray(pc.fill_null(pc.dictionary_encode(c).indices, -1))
            tokens = [batch.column(name) for name in names]
            codes = [code(c) for c in tokens]
            record, n = code(batch.column("record")), np.asarray(batch.column("n"))
            prefix, link = common_prefixes(codes), duplicate_links(record)
            for depth in range(1, length + 1):
                begin = prefix < depth
                begin[0] = True
                starts, no = np.flatnonzero(begin), np.cumsum(begin) - 1
                held = np.ones(len(starts), bool)
                if depth > 1:  # shorter suffixes have no prefix of this length
                    held = np.asarray(pc.not_equal(tokens[depth - 1].take(pa.array(starts)), END))
                repeats = n - 1 + np.where(record < 0, 1, (link >= 0) & (no[link] == no))
                occurrences, duplicates = np.add.reduceat(n, starts), np.add.reduceat(repeats, starts)
                if depth < length:
                    edge = np.flatnonzero(((no == 0) | (no == no[-1])) & held[no])
                    yield _piece(depth, _joined(tokens[:depth], edge), batch.column("record").take(pa.array(edge)), n[edge], None)
                    held[[0, -1]] = False
                whole = starts[held]
                yield _piece(depth, _joined(tokens[:depth], whole), None, occurrences[held], (occurrences - duplicates)[held])

    return run


def _joined(tokens: list[pa.Array], rows: np.ndarray) -> pa.Array:
    taken = [c.take(pa.array(rows)) for c in tokens]
    return taken[0] if len(taken) == 1 else pc.binary_join_element_wise(*taken, " ")


def term_counts(tokens: DataFrame, order: str, term: str, record: str, length: int = 1) -> DataFrame:
    """(size, term, occurrences, records) of all n-grams of 1..length tokens, exactly as written, joined by ' '.

    `tokens`: one row per occurrence (repeated rows are to be removed first); null terms are left out, which lets
    their neighbours meet; a null record is no record, though its occurrences count. Equal suffixes of a record are put
    together before they move. Suffixes are sorted in partitions: by hash of (suffix, part of the records) if single
    terms are asked for, by ranges of (suffix, record) otherwise; either way a term of very many records is spread.
    Empty input gives no row."""
    rows = suffixes(tokens.where(F.col(term).isNotNull()), order, term, record, length)
    names = [f"s{k + 1}" for k in range(length)]
    part = F.pmod(F.xxhash64("record"), F.lit(SPREAD)).alias("part")
    counted = rows.groupBy(*names, "record").agg(F.count(F.lit(1)).alias("n"))
    if length == 1:
        # The sum by (suffix, part, record) needs no other place than the one the sort wants.
        counted = rows.select(*names, "record", part).groupBy(*names, "part", "record").agg(F.count(F.lit(1)).alias("n"))
        ordered = counted.repartition(*names, "part").sortWithinPartitions(*names, "record")
    else:
        ordered = counted.repartitionByRange(*names, "record").sortWithinPartitions(*names, "record")
    pieces = ordered.select(*names, "record", "n").mapInArrow(_intervals(length), _PIECE)
    if length == 1:
        return pieces.groupBy("size", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    met = (
        pieces.where("records is null")
        .groupBy("size", "term", "record")
        .agg(F.sum("occurrences").alias("occurrences"))
        .select("size", "term", "occurrences", F.col("record").isNotNull().cast("long").alias("records"))
    )
    parts = pieces.where("records is not null").select("size", "term", "occurrences", "records").unionByName(met)
    return parts.groupBy("size", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def corpus_terms(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, term, occurrences, records) of the words of `tokens` (word_id, file_id, word) and the normal forms of
    `forms` (word_id, normal_form), whose file is that of their word.

    One occurrence per distinct word_id of each table. Both tables go by ranges of word_id once: repeated rows meet,
    forms meet their file, and as ids run along the files, most terms of a file are summed before they move again."""
    rows = tokens.select("word_id", "file_id", "word", F.lit(None).cast("string").alias("normal_form")).unionByName(
        forms.select("word_id", F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("string").alias("word"), "normal_form")
    )
    met = (
        rows.where("word_id is not null")
        .repartitionByRange("word_id")
        .groupBy("word_id")
        .agg(*[F.max(c).alias(c) for c in ("file_id", "word", "normal_form")])
    )
    both = met.select(
        "file_id",
        F.explode(F.array(F.concat(F.lit("w"), "word"), F.concat(F.lit("n"), "normal_form"))).alias("term"),
    )
    counts = term_counts(both, "", "term", "file_id")
    return counts.select(
        F.when(F.col("term").startswith("w"), "word").otherwise("normal_form").alias("field"),
        F.expr("substring(term, 2)").alias("term"),
        "occurrences",
        "records",
    )


def marked(counts: DataFrame, records: int, rare: int = 2, common: float = 0.5) -> DataFrame:
    """Adds mark: rare (at most `rare` occurrences or at most one record), else common (in more than `common` of the
    `records`), else null."""
    low = (F.col("occurrences") <= rare) | (F.col("records") <= 1)
    return counts.withColumn("mark", F.when(low, "rare").when(F.col("records") > common * records, "common"))


def corpus_ngrams(tokens: DataFrame, length: int) -> DataFrame:
    """(size, term, occurrences, records): all n-grams of 1..length words of the files of `tokens` (word_id, file_id, word),
    the words joined by a blank. One occurrence per distinct word_id; nulls are left out, so their neighbours meet. A file
    is followed in the order of word_id, wherever its rows stand."""
    met = tokens.where("word_id is not null and file_id is not null").groupBy("word_id").agg(F.max("file_id").alias("file_id"), F.max("word").alias("word"))
    return term_counts(met, "word_id", "word", "file_id", length)
