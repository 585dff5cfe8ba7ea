"""Dependency trees: repair, closure, statistics. Edges: file_id, sentence_id, word_id, syntax_parent_id (-1 root), relation.

A sentence is small, so what must walk a tree does so inside one sentence; sentences are spread by (file, sentence).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = ["file_id", "sentence_id"]


def heads(words: DataFrame) -> DataFrame:
    """syntax_parent_id from head numbers inside the sentence (syntax_id, syntax_head_id); -1 where there is no head."""
    head = words.select(*SENTENCE, F.col("syntax_id").alias("syntax_head_id"), F.col("word_id").alias("parent"))
    return words.join(head, [*SENTENCE, "syntax_head_id"], "left").withColumn("syntax_parent_id", F.coalesce("parent", F.lit(-1))).drop("parent")


def links(edges: DataFrame) -> DataFrame:
    """Adds links_to: how many words have this one as parent."""
    n = edges.where("syntax_parent_id != -1").groupBy(*SENTENCE, F.col("syntax_parent_id").alias("word_id")).agg(F.count(F.lit(1)).alias("links_to"))
    return edges.join(n, [*SENTENCE, "word_id"], "left").withColumn("links_to", F.coalesce("links_to", F.lit(0)))


def one_root(edges: DataFrame) -> DataFrame:
    """Each sentence gets exactly one root: `root` = Good, Picked (had none: the word with most links), KeptMultRoot or
    DeletedMultRoot (had several: the one with most links stays, the others hang on it), No. Ties: the smallest id."""
    e = links(edges)
    s = Window.partitionBy(*SENTENCE)
    is_root = F.col("syntax_parent_id") == -1
    e = e.withColumn("roots", F.sum(is_root.cast("int")).over(s))
    rank = F.row_number().over(Window.partitionBy(*SENTENCE).orderBy(F.desc(is_root | (F.col("roots") == 0)), F.desc("links_to"), "word_id"))
    e = e.withColumn("chosen", rank == 1)
    e = e.withColumn("correct_root", F.max(F.when(F.col("chosen"), F.col("word_id"))).over(s))
    root = (
        F.when(F.col("chosen") & (F.col("roots") == 0), "Picked").when(F.col("chosen") & (F.col("roots") == 1), "Good").when(F.col("chosen"), "KeptMultRoot").when(is_root, "DeletedMultRoot").otherwise("No")
    )
    parent = F.when(F.col("chosen"), -1).when(is_root, F.col("correct_root")).otherwise(F.col("syntax_parent_id"))
    return e.withColumn("root", root).withColumn("syntax_parent_id", parent).drop("chosen", "roots")


def closure(edges: DataFrame, limit: int = 20) -> DataFrame:
    """(file_id, sentence_id, word_id, ancestor_id, relation, distance): every ancestor within `limit` steps, with the
    relation of the last step. Cycles give what `limit` allows; a parent outside the sentence ends the walk."""
    up = edges.where("syntax_parent_id != -1").groupBy(*SENTENCE).agg(F.collect_list(F.struct("word_id", "syntax_parent_id", "relation")).alias("words"))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, sentence, words in zip(part.file_id, part.sentence_id, part.words):
                parent = {w["word_id"]: (w["syntax_parent_id"], w["relation"]) for w in words}
                for w in parent:
                    at, d = w, 0
                    while at in parent and d < limit:
                        at, rel = parent[at]
                        d += 1
                        rows.append((file, sentence, w, at, rel, d))
            yield pd.DataFrame(rows, columns=[*SENTENCE, "word_id", "ancestor_id", "relation", "distance"])

    kind = dict(edges.dtypes)
    # One row per sentence, many sentences per batch.
    return up.mapInPandas(walk, f"file_id {kind['file_id']}, sentence_id long, word_id long, ancestor_id long, relation string, distance int")


def break_cycles(edges: DataFrame) -> DataFrame:
    """Hangs, in each sentence with a cycle, the cycle's word with most links on the root, until there is none.

    Adds cycle_status: No, Yes (was in a cycle), Broken (was moved). Needs one_root's columns."""

    def mended(words: list) -> list[tuple]:
        parent = {w["word_id"]: w["syntax_parent_id"] for w in words}
        weight = {w["word_id"]: w["links_to"] for w in words}
        root, status = words[0]["correct_root"], {}
        while found := _cycle(parent):
            for w in found:
                status.setdefault(w, "Yes")
            move = max(found, key=lambda w: (weight.get(w, 0), -w))
            parent[move], status[move] = root, "Broken"
        return [(w, parent[w], status.get(w, "No")) for w in parent]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, s, *r) for f, s, words in zip(part.file_id, part.sentence_id, part.words) for r in mended(words)]
            yield pd.DataFrame(rows, columns=[*SENTENCE, "word_id", "syntax_parent_id", "cycle_status"])

    lists = edges.groupBy(*SENTENCE).agg(F.collect_list(F.struct("word_id", "syntax_parent_id", "links_to", "correct_root")).alias("words"))
    fixed = lists.mapInPandas(run, f"file_id {dict(edges.dtypes)['file_id']}, sentence_id long, word_id long, syntax_parent_id long, cycle_status string")
    return edges.drop("syntax_parent_id").join(fixed, [*SENTENCE, "word_id"])


def _cycle(parent: dict[int, int]) -> list[int]:
    """The words of some cycle, [] if there is none; each word is visited once."""
    done: set[int] = set()
    for w in parent:
        path, at = [], w
        while at in parent and at not in done:
            if at in path:
                return path[path.index(at) :]
            path.append(at)
            at = parent[at]
        done.update(path)
    return []


def repaired(edges: DataFrame) -> DataFrame:
    return break_cycles(one_root(edges))


def problems(edges: DataFrame) -> DataFrame:
    """(problem, file_id, sentence_id): sentences without exactly one root, with a parent that is not in them, a
    word that comes twice or one without parent."""
    roots = edges.groupBy(*SENTENCE).agg(F.count_if(F.col("syntax_parent_id") == -1).alias("n")).where("n != 1").select(F.lit("roots").alias("problem"), *SENTENCE)
    ids = edges.select(*SENTENCE, F.col("word_id").alias("syntax_parent_id"))
    lost = edges.where("syntax_parent_id != -1").join(ids, [*SENTENCE, "syntax_parent_id"], "left_anti").select(F.lit("parent").alias("problem"), *SENTENCE).distinct()
    twice = edges.groupBy(*SENTENCE, "word_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("twice").alias("problem"), *SENTENCE).distinct()
    null = edges.where("syntax_parent_id is null").select(F.lit("null").alias("problem"), *SENTENCE).distinct()
    return roots.unionByName(lost).unionByName(twice).unionByName(null)


def tree_stats(edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """children, descendants, up_depth, down_depth, sentence_length, descendants_relative of each word; 0 if none."""
    key = [*SENTENCE, "word_id"]
    up = ancestors.groupBy(*key).agg(F.max("distance").alias("up_depth"))
    down = ancestors.groupBy(*SENTENCE, F.col("ancestor_id").alias("word_id")).agg(
        F.count_if(F.col("distance") == 1).alias("children"), F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("down_depth")
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(*SENTENCE))
    out = edges.select(*key).withColumn("sentence_length", size).join(up, key, "left").join(down, key, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("up_depth", "children", "descendants", "down_depth")})
    return out.withColumn("descendants_relative", F.col("descendants") / F.col("sentence_length"))


def context(edges: DataFrame, shift: int = 1) -> DataFrame:
    """(word_id, other_id, kind, distance): parents, children (closure up to `shift`) and siblings of each word."""
    c = closure(edges, shift)
    parents = c.select(*SENTENCE, "word_id", F.col("ancestor_id").alias("other_id"), F.lit("parent").alias("kind"), "distance")
    children = c.select(*SENTENCE, F.col("ancestor_id").alias("word_id"), F.col("word_id").alias("other_id"), F.lit("child").alias("kind"), "distance")
    own = edges.where("syntax_parent_id != -1").select(*SENTENCE, "word_id", "syntax_parent_id")
    sib = own.join(own.withColumnRenamed("word_id", "other_id"), [*SENTENCE, "syntax_parent_id"]).where("word_id != other_id").select(*SENTENCE, "word_id", "other_id", F.lit("sibling").alias("kind"), F.lit(1).alias("distance"))
    return parents.unionByName(children).unionByName(sib)


def nearest_children(edges: DataFrame, count: int) -> DataFrame:
    """The `count` children nearest to each word, by distance in words: (word_id, place, child_id)."""
    e = edges.where("syntax_parent_id != -1").select(*SENTENCE, F.col("syntax_parent_id").alias("word_id"), F.col("word_id").alias("child_id"))
    w = Window.partitionBy(*SENTENCE, "word_id").orderBy(F.abs(F.col("child_id") - F.col("word_id")), "child_id")
    return e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)
