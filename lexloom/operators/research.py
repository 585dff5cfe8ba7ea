"""Agreement of endings, gender scores, antecedents, distances, pairs, co-occurrence and first mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_capitalized
from .relational import dense_rank_in, running_sum_in, with_margin

KEY = ["file_id", "word_id"]


def longest_ending(word: Column, endings: Sequence[str]) -> Column:
    """The longest of the endings that the word has, '' if none."""
    return F.regexp_extract(F.lower(word), "(" + "|".join(sorted(endings, key=lambda e: (-len(e), e))) + ")$", 1)


def agreement_index(src: DataFrame, forms: DataFrame, pos: str, endings: Sequence[str], declensions: dict[str, int], labels: dict[str, int]) -> DataFrame:
    """(word_id, file_id, ending, declension, label, thrown): words of a part of speech with the class of their ending.

    Declension by the ending of the normal form; thrown where ending or declension is unknown."""
    base = src.select(*KEY, "word").join(forms.where(F.col("pos") == pos).select("word_id", "normal_form").dropDuplicates(["word_id"]), "word_id")
    ending = longest_ending(F.col("word"), endings)
    kind = longest_ending(F.col("normal_form"), list(declensions))
    pick = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    out = base.withColumn("ending", ending).withColumn("declension", pick(declensions, kind)).withColumn("label", pick(labels, F.col("ending")))
    return out.withColumn("thrown", F.col("declension").isNull() | F.col("label").isNull())


def masked(index: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds the mask of each row's declension (a row per declension)."""
    return index.join(F.broadcast(masks), "declension", "left")


def agreement_errors(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Where the best class of ending is not the written one: error and the stem with the better ending. scored: word,
    ending and a column per ending class."""
    values = F.array(*[F.col(c).cast("double") for c in classes])
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position(values, F.array_max(values)).cast("int"))
    return scored.withColumn("best", best).where(F.col("best") != F.col("ending")).withColumn("suggest", F.array(F.expr("concat(substring(word, 1, length(word) - length(ending)), best)"))).withColumn("error", F.lit(True))


def gender_scores(parses: DataFrame, genders: Sequence[str] = ("masc", "femn", "neut")) -> DataFrame:
    """Sum of parse scores by gender, per word. parses: word_id, gender, score (several rows per word)."""
    return parses.groupBy("word_id").pivot("gender", list(genders)).agg(F.sum("score")).na.fill(0.0)


def proper_names(src: DataFrame, least: int = 2) -> DataFrame:
    """(file_id, name, n): words that always begin with a capital in their file and come more than `least` times."""
    w = src.where("word_type in ('ru', 'en')").groupBy("file_id", F.lower("word").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(is_capitalized(F.col("word"))).alias("always"))
    return w.where(F.col("always") & (F.col("n") > least)).drop("always")


def antecedents(nouns: DataFrame, pronouns: DataFrame, k: int) -> DataFrame:
    """(file_id, word_id, candidate_id, place): for each pronoun the k nearest earlier nouns of its gender in its file.

    nouns, pronouns: file_id, gender, word_id. Instead of joining every earlier noun, the last k nouns run along with the
    rows of (file, gender) in order: linear, and no more than k per pronoun."""
    both = nouns.select("file_id", "gender", "word_id", F.lit(0).alias("p")).unionByName(pronouns.select("file_id", "gender", "word_id", F.lit(1).alias("p")))
    w = Window.partitionBy("file_id", "gender").orderBy("word_id", "p")
    no = F.sum((F.col("p") == 0).cast("int")).over(w)
    numbered = both.withColumn("no", no)
    want = numbered.where("p = 1 and no > 0").select("file_id", "gender", "word_id", F.explode(F.sequence(F.col("no"), F.greatest(F.lit(1), F.col("no") - (k - 1)), F.lit(-1))).alias("no"), F.col("no").alias("last"))
    have = numbered.where("p = 0").select("file_id", "gender", "no", F.col("word_id").alias("candidate_id"))
    return want.join(have, ["file_id", "gender", "no"]).select("file_id", "word_id", "candidate_id", (F.col("last") - F.col("no") + 1).cast("int").alias("place"))


def without_siblings(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that don't hang on the same word as their pronoun (edges: file_id, word_id, syntax_parent_id), the nearest of
    each noun kept once. candidates: file_id, word_id, candidate_id, place."""
    own = edges.where("syntax_parent_id != -1").select("file_id", "word_id", F.col("syntax_parent_id").alias("own_parent"))
    other = edges.where("syntax_parent_id != -1").select("file_id", F.col("word_id").alias("candidate_id"), F.col("syntax_parent_id").alias("other_parent"))
    met = candidates.join(own, ["file_id", "word_id"], "left").join(other, ["file_id", "candidate_id"], "left")
    return met.where("own_parent is null or other_parent is null or own_parent != other_parent").select(*candidates.columns)


def accepted(scored: DataFrame) -> DataFrame:
    """The best candidate of each pronoun if it stands out: e^score, normalised per pronoun; accepted if the first is
    more than a standard deviation ahead of the second. scored: file_id, word_id, candidate_id, score."""
    p = Window.partitionBy("file_id", "word_id")
    s = scored.withColumn("share", F.exp("score") / F.sum(F.exp("score")).over(p)).withColumn("n", F.row_number().over(p.orderBy(F.desc("share"), F.desc("candidate_id"))))
    g = s.groupBy("file_id", "word_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("candidate_id"))).alias("candidate_id"), F.max(F.when(F.col("n") == 1, F.col("share"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("share"))).alias("second"), F.stddev_samp("share").alias("std")
    )
    return g.withColumn("accepted", F.coalesce(F.col("first") - F.col("second") > F.col("std"), F.lit(False)))


def distances(pairs: DataFrame, src: DataFrame) -> DataFrame:
    """Of pairs (file_id, word_id, candidate_id): words between that are no punctuation, sentences and paragraphs between,
    candidates between. By prefix counts; nothing is scanned per pair."""
    at = src.select("file_id", "word_id", F.coalesce(F.col("word_type"), F.lit("unk")).alias("word_type"), "sentence_id", "paragraph_id")
    at = running_sum_in(at, ["file_id"], "word_id", (F.col("word_type") != "punct").cast("int"), "n")
    at = dense_rank_in(dense_rank_in(at, ["file_id"], "sentence_id", "s"), ["file_id"], "paragraph_id", "g")
    a = at.select("file_id", "word_id", F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("g").alias("g1"))
    b = at.select("file_id", F.col("word_id").alias("candidate_id"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("g").alias("g2"), F.col("word_type").alias("t2"))
    j = pairs.select("file_id", "word_id", "candidate_id").join(a, ["file_id", "word_id"]).join(b, ["file_id", "candidate_id"])
    w = Window.partitionBy("file_id", "word_id").orderBy(F.desc("candidate_id"))
    return j.select("file_id", "word_id", "candidate_id", (F.col("n1") - F.col("n2") - 1).alias("words_between"), (F.col("s1") - F.col("s2")).alias("sentences_between"), (F.col("g1") - F.col("g2")).alias("paragraphs_between"), (F.row_number().over(w) - 1).alias("candidates_between"))


def contrast_pairs(rows: DataFrame, group: str, match: str, key: str) -> DataFrame:
    """(group, good, bad): each matching row beside each that doesn't match; groups are small (the candidates of a word)."""
    good = rows.where(F.col(match)).select(group, F.col(key).alias("good"))
    bad = rows.where(~F.col(match)).select(group, F.col(key).alias("bad"))
    return good.join(bad, group)


def cooccurrence(words: DataFrame, reach: int = 15, weighted: bool = False) -> DataFrame:
    """(a, b, n): how often words stand within `reach` places of each other in a file; a <= b. weighted: sum of 1 / distance.

    words: file_id, word_id, word. Each word looks at the `reach` words before it by lags: linear in the text."""
    own = with_margin(words.select("file_id", "word_id", "word"), ["file_id"], "word_id", reach)
    w = Window.partitionBy("file_id", "_block").orderBy("word_id")
    before = F.array(*[F.struct(F.lit(d).alias("d"), F.lag("word", d).over(w).alias("o")) for d in range(1, reach + 1)])
    each = own.withColumn("_b", before).where("_own").select("word", F.explode("_b").alias("x")).where("x.o is not null and word is not null")
    a, b = F.least("word", "x.o"), F.greatest("word", "x.o")
    n = F.sum(1 / F.col("x.d")) if weighted else F.count(F.lit(1))
    return each.select(a.alias("a"), b.alias("b"), "x").groupBy("a", "b").agg(n.alias("n"))


def normalised(pairs: DataFrame, smooth: float = 0.0) -> DataFrame:
    """(a, b, n, share): each entry of a co-occurrence matrix in long form as a share of its row; both triangles count."""
    whole = pairs.select("a", "b", "n").unionByName(pairs.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    rows = whole.groupBy("a").agg(F.sum(F.col("n") + smooth).alias("_all"))
    return whole.join(rows, "a").select("a", "b", "n", ((F.col("n") + smooth) / F.col("_all")).alias("share"))


def merged_matrices(*matrices: DataFrame) -> DataFrame:
    """(a, b, n): the entries of several matrices added up."""
    out = matrices[0].select("a", "b", "n")
    for m in matrices[1:]:
        out = out.unionByName(m.select("a", "b", "n"))
    return out.groupBy("a", "b").agg(F.sum("n").alias("n"))


def masked_matrix(pairs: DataFrame, words: DataFrame, column: str = "word") -> DataFrame:
    """The entries none of whose words is in the list."""
    own = words.select(F.col(column).alias("_w")).where("_w is not null").distinct()
    return pairs.join(own.withColumnRenamed("_w", "a"), "a", "left_anti").join(own.withColumnRenamed("_w", "b"), "b", "left_anti")


def not_first_mention(rows: DataFrame, category: str) -> DataFrame:
    """Rows that are not the first of their category in the file; rows without a category are left out."""
    first = rows.groupBy("file_id", category).agg(F.min("word_id").alias("word_id"))
    return rows.join(first.select("file_id", "word_id"), ["file_id", "word_id"], "left_anti").where(F.col(category).isNotNull())


def candidate_recall(candidates: DataFrame, match: str) -> DataFrame:
    """(n, found): pronouns and those with the right noun among their candidates."""
    per = candidates.groupBy("file_id", "word_id").agg(F.bool_or(match).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("found"))


def first_sentences(src: DataFrame, k: int) -> DataFrame:
    """The tokens of the first k sentences of each file."""
    w = Window.partitionBy("file_id").orderBy("sentence_id")
    return src.where("sentence_id is not null").withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= k).drop("_k")


def by_tag(src: DataFrame, toc: DataFrame, tag: str, *values: str) -> DataFrame:
    """src of the files whose tag is one of the values."""
    return src.join(toc.where(F.col("tags")[tag].isin(*values)).select("file_id").distinct(), "file_id", "left_semi")
