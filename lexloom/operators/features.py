"""Word-level feature frames. Each function takes a token table (with file_id) and gives (file_id, word_id, features).

Windows start with the file; a distinct-word step stands before everything that is costly per word. Analysers that
need a model are given by the caller: a missing one is an error, never an invented result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

KEY = ["file_id", "word_id"]
# Dialogue dashes, and punctuation that borders no speech.
DASHES = ("—", "–", "-")
NO_BORDER = ("»", '"', ")", "–", "“", "”", "(", "«")


class Featurizer(Protocol):
    """Gives named frames for a bundle of frames; changes nothing."""

    def frames(self, bundle: dict[str, DataFrame]) -> dict[str, DataFrame]: ...


def simple(name: str, build: Callable[[dict[str, DataFrame]], DataFrame]) -> Featurizer:
    """A featurizer of one frame."""

    class _One:
        def frames(self, bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
            return {name: build(bundle)}

    return _One()


def incremental(src: DataFrame, old: DataFrame, build: Callable[[DataFrame], DataFrame], index: str = "word_id") -> DataFrame:
    """Features after an edit: paragraphs with an updated word are computed anew, the other words keep their old row.

    Old rows are found by original_<index>; those of recomputed paragraphs are left out, so no word comes twice."""
    touched = src.groupBy("file_id", "paragraph_id").agg(F.bool_or(F.coalesce("updated", F.lit(False))).alias("t")).where("t").drop("t")
    fresh = build(src.join(touched, ["file_id", "paragraph_id"], "left_semi"))
    same = src.join(touched, ["file_id", "paragraph_id"], "left_anti").select("file_id", index, F.coalesce(f"original_{index}", index).alias("_old"))
    kept = same.join(old.withColumnRenamed(index, "_old"), ["file_id", "_old"]).drop("_old")
    return fresh.unionByName(kept.select(*fresh.columns))


def one_pass(rows: DataFrame, key: str, numbers: list[str], flags: list[str] = ()) -> DataFrame:
    """Statistics of every key in one pass: n, for each number its sum, least, greatest and mean, for each flag how often it is set."""
    each = [f(c).alias(f"{c}_{n}") for c in numbers for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max), ("mean", F.avg))]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *each, *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"{c}_n") for c in flags])


def expanded(rows: DataFrame, key: str, order: str, value: str, buffer: int) -> DataFrame:
    """(key, order, values): each row with the `buffer` values that stand before it and its own, once there are so many."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-buffer, 0)
    return rows.select(key, order, F.collect_list(F.coalesce(value, F.lit(0))).over(w).alias("values")).where(F.size("values") == buffer + 1)


def per_distinct_word(src: DataFrame, analyse: Callable[[pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """(file_id, word_id, analysis): runs an analyser once for each distinct word and joins its result back."""
    if analyse is None:
        raise ValueError("an analyser is needed: there is no model in this library")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = analyse(part.word)
            out.insert(0, "word", part.word.to_numpy())
            yield out

    words = src.select("word").where("word is not null").distinct()
    return src.select(*KEY, "word").join(words.mapInPandas(run, f"word string, {schema}"), "word").drop("word")


def morphology(src: DataFrame, parses: DataFrame) -> DataFrame:
    """Morphology joined to words, part of speech NONE where there is none (parses: word_id and grammemes)."""
    own = parses.dropDuplicates(["word_id"])
    return src.select(*KEY).join(own, "word_id", "left").withColumn("pos", F.coalesce("pos", F.lit("NONE")))


def without_adjectives(parses: DataFrame, grammemes: list[str]) -> DataFrame:
    """The grammemes of full and short adjectives set to null."""
    adj = F.col("pos").isin("ADJF", "ADJS")
    return parses.withColumns({c: F.when(~F.coalesce(adj, F.lit(False)), F.col(c)) for c in grammemes})


def capitalization(src: DataFrame, forms: DataFrame) -> DataFrame:
    """is_capitalized, is_unexpectedly_capitalized (not the first Russian word of its sentence), uc_proportion (mean
    over the words of the same normal form in the file), uc_somewhere. Words without a normal form count by themselves."""
    cap = F.coalesce(X.is_capitalized(F.col("word")), F.lit(False))
    ru = F.col("word_type") == "ru"
    order = F.sum(ru.cast("int")).over(Window.partitionBy("file_id", "sentence_id").orderBy("word_id")) - 1
    base = src.join(forms.select("word_id", "normal_form").dropDuplicates(["word_id"]), "word_id", "left")
    lemma = Window.partitionBy("file_id", F.coalesce("normal_form", F.lower("word")))
    return (
        base.withColumn("is_capitalized", cap)
        .withColumn("ru_order", F.when(ru, order).otherwise(-1).cast("int"))
        .withColumn("is_unexpectedly_capitalized", F.col("is_capitalized") & (F.col("ru_order") != 0))
        .withColumn("uc_proportion", F.avg(F.col("is_capitalized").cast("double")).over(lemma))
        .withColumn("uc_somewhere", F.bool_or("is_capitalized").over(lemma))
        .select(*KEY, "is_capitalized", "ru_order", "is_unexpectedly_capitalized", "uc_proportion", "uc_somewhere")
    )


def local_frequency(src: DataFrame, forms: DataFrame) -> DataFrame:
    """The share of a word's normal form among the words of its file."""
    base = src.select(*KEY).join(forms.select("word_id", "normal_form").dropDuplicates(["word_id"]), "word_id").where("normal_form is not null")
    # Counts first, so that no file is one task.
    lemmas = base.groupBy("file_id", "normal_form").agg(F.count(F.lit(1)).alias("n"))
    whole = lemmas.groupBy("file_id").agg(F.sum("n").alias("all"))
    shares = lemmas.join(whole, "file_id").select("file_id", "normal_form", (F.col("n") / F.col("all")).alias("local_freq"))
    return base.join(shares, ["file_id", "normal_form"]).select(*KEY, "normal_form", "local_freq")


def frequencies(forms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary frequencies of normal forms: lemma, freq, range, juilland, text_count; 0 where there is none.

    Equal lemmas in other case are put together: frequencies summed, the rest at its largest."""
    d = dictionary.groupBy(F.lower("lemma").alias("normal_form")).agg(
        F.sum("freq").alias("freq"), F.max("range").alias("corpus_range"), F.max("juilland").alias("juilland_coef"), F.max("text_count").alias("text_count"), F.lit(1).alias("freq_found")
    )
    numbers = ["freq", "corpus_range", "juilland_coef", "text_count", "freq_found"]
    return forms.select("word_id", "normal_form").dropDuplicates(["word_id"]).join(d, "normal_form", "left").select("word_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def morpheme_dictionary(lines: DataFrame) -> DataFrame:
    """(normal_form, morpheme_index, morpheme_type, morpheme) of lines `word<tab>m1:T1/m2:T2`; of a word that comes twice
    the line with the smaller number counts. lines: no, line."""
    parts = lines.select("no", F.split("line", "\t").alias("p")).where("size(p) = 2").select("no", F.col("p")[0].alias("normal_form"), F.col("p")[1].alias("m"))
    first = parts.groupBy("normal_form").agg(F.min_by("m", "no").alias("m"))
    each = first.select("normal_form", F.posexplode(F.split("m", "/")).alias("morpheme_index", "x"))
    return each.select("normal_form", "morpheme_index", F.split_part("x", F.lit(":"), F.lit(2)).alias("morpheme_type"), F.split_part("x", F.lit(":"), F.lit(1)).alias("morpheme"))


def morphemes(forms: DataFrame, dictionary: DataFrame, types: list[str] | None = None) -> DataFrame:
    """0..n rows per word: the morphemes of its normal form."""
    d = dictionary.where(F.col("morpheme_type").isin(types)) if types else dictionary
    return forms.select("word_id", "normal_form").dropDuplicates(["word_id"]).join(d, "normal_form").select("word_id", "morpheme_index", "morpheme_type", "morpheme")


# The classes of endings of the published Snowball algorithm for Russian. Those under *_A must follow а or я.
VOWELS = "аеиоуыэюя"
GERUND_A, GERUND = "вшись|вши|в", "ившись|ивши|ив|ывшись|ывши|ыв"
ADJECTIVE = "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE_A, PARTICIPLE = "ем|нн|вш|ющ|щ", "ивш|ывш|ующ"
VERB_A = "ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно"
VERB = "ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю"
NOUN = "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def snowball(word: Column) -> Column:
    """The stem of a Russian word by the Snowball algorithm; ё counts as е. Regular expressions only, so all of it stays in
    the JVM; endings are taken off behind the first vowel, -ост(ь) behind the second syllable's end."""

    def either(c: Column, after: str, plain: str) -> Column:
        return _let(F.regexp_replace(c, f"(?:{plain})$", ""), lambda bare: F.when(bare != c, bare).otherwise(F.regexp_replace(c, f"([ая])(?:{after})$", "$1")))

    def inflected(active: Column) -> Column:
        adjective = F.regexp_replace(active, f"(?:{ADJECTIVE})$", "")
        verb = F.regexp_replace(active, f"([ая])(?:{VERB_A})$|(?:{VERB})$", "$1")
        rest = lambda: _let(verb, lambda v: F.when(v != active, v).otherwise(F.regexp_replace(active, f"(?:{NOUN})$", "")))
        return _let(adjective, lambda a: F.when(a != active, either(a, PARTICIPLE_A, PARTICIPLE)).otherwise(rest()))

    def first(rest: Column) -> Column:
        return _let(either(rest, GERUND_A, GERUND), lambda g: F.when(g != rest, g).otherwise(_let(F.regexp_replace(rest, "(?:ся|сь)$", ""), inflected)))

    def tidied(c: Column) -> Column:
        single = lambda x: F.regexp_replace(x, "нн$", "н")
        return _let(F.regexp_replace(c, "ейше?$", ""), lambda g: F.when(g != c, single(g)).otherwise(F.regexp_replace(single(c), "ь$", "")))

    def stemmed(low: Column, head: Column) -> Column:
        second = F.length(F.regexp_extract(low, f"^.*?[{VOWELS}][^{VOWELS}].*?[{VOWELS}][^{VOWELS}]", 0))
        derived = lambda v: _let(F.regexp_replace(v, "ость?$", ""), lambda x: F.when((second > 0) & (F.length(head) + F.length(x) >= second), x).otherwise(v))
        bare = F.regexp_replace(first(F.substr(low, F.length(head) + 1)), "и$", "")
        return F.when(head == "", low).otherwise(F.concat(head, _let(_let(bare, derived), tidied)))

    return _let(X.yo(F.lower(word)), lambda low: _let(F.regexp_extract(low, f"^[^{VOWELS}]*[{VOWELS}]", 0), lambda head: stemmed(low, head)))


# Endings that the simple English stemmer takes off, longest first.
EN_ENDINGS = "ingly edly ations ation ness ment ings ing ies ied est ers er ed es ly s".split()


def stem(word: Column, language: str = "ru") -> Column:
    """The stem of a Russian word (Snowball), or of an English one by a light rule: one ending off, at least three letters left."""
    if language == "ru":
        return snowball(word)
    pattern = "^(.{3,}?)(?:" + "|".join(EN_ENDINGS) + ")$"
    low = F.lower(word)
    got = F.regexp_extract(low, pattern, 1)
    return F.when(got != "", got).otherwise(low)


def stems(src: DataFrame, language: str = "ru", tagger: Callable[[pd.Series], pd.DataFrame] | None = None) -> DataFrame:
    """stem, ending and, with a tagger, pos (else null)."""
    low = X.yo(F.lower("word")) if language == "ru" else F.lower("word")
    words = src.select("word").where("word is not null").distinct().withColumn("stem", stem(F.col("word"), language))
    out = src.select(*KEY, "word").join(words, "word", "left").select(*KEY, low.alias("word"), "stem")
    out = out.withColumn("ending", F.expr("substring(word, length(stem) + 1)"))
    if tagger is None:
        return out.withColumn("pos", F.lit(None).cast("string"))
    return out.join(per_distinct_word(src, tagger, "pos string"), KEY, "left")


def dialog(src: DataFrame) -> DataFrame:
    """dialog_type: no, dialog-dash, dialog-symbol, speech or action; is_dialog.

    A paragraph whose first word is a dash is a line of dialogue. Its borders are that word and each mark right before
    a dash in it; a word belongs to the last border at or before it: an even border begins speech, an odd one action."""
    p = Window.partitionBy("file_id", "paragraph_id").orderBy("word_id")
    first = F.row_number().over(p) == 1
    dash = F.col("word").isin(*DASHES)
    base = (
        src.select(*KEY, "paragraph_id", "word", "word_type")
        .withColumn("first", first)
        .withColumn("next", F.lead("word").over(p))
        .withColumn("is_dialog", F.coalesce(F.max(F.when(F.col("first"), dash)).over(Window.partitionBy("file_id", "paragraph_id")), F.lit(False)))
    )
    mark = (F.col("word_type") == "punct") & ~F.col("word").isin(*NO_BORDER, *DASHES) & F.col("next").isin(*DASHES)
    border = F.coalesce(F.col("first") | mark, F.lit(False))
    marked = base.withColumn("border", border).withColumn("no", F.sum(F.col("border").cast("int")).over(p) - 1)
    after = F.lag("border").over(p) & ~F.lag("first").over(p)
    kind = (
        F.when(~F.col("is_dialog"), "no")
        .when(F.col("border") | F.coalesce(after, F.lit(False)), F.when(dash, "dialog-dash").otherwise("dialog-symbol"))
        .when(F.col("no") % 2 == 0, "speech")
        .otherwise("action")
    )
    return marked.select(*KEY, kind.alias("dialog_type"), "is_dialog")


def vector_keys(src: DataFrame, forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Which spelling of each Russian word has a vector: selected_word, selected_word_column, vector_id.

    Tried in order: the word, with е for ё, in small letters, both, its normal form, that with е for ё; `<unk>` if none.
    vocabulary: term, vector_id."""
    base = src.where("word_type = 'ru'").join(forms.select("word_id", "normal_form").dropDuplicates(["word_id"]), "word_id", "left")
    w, n = F.col("word"), F.col("normal_form")
    tries = [("word", w), ("word_e", X.yo(w)), ("lower", F.lower(w)), ("lower_e", X.yo(F.lower(w))), ("normal_form", n), ("normal_form_e", X.yo(n))]
    each = base.select(*KEY, F.posexplode(F.array(*[F.struct(F.lit(k).alias("how"), c.alias("term")) for k, c in tries])).alias("no", "t"))
    hit = each.select(*KEY, "no", "t.how", "t.term").join(vocabulary.select("term", "vector_id"), "term")
    best = hit.groupBy(*KEY).agg(F.min_by(F.struct("term", "how", "vector_id"), "no").alias("b"))
    return base.select(*KEY).join(best, KEY, "left").select(
        *KEY, F.coalesce("b.term", F.lit("<unk>")).alias("selected_word"), F.col("b.how").alias("selected_word_column"), F.col("b.vector_id").alias("vector_id")
    )


def vectors_used(keys: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors that some word has, once each. keys: vector_keys; vectors: vector_id and the vector."""
    return vectors.join(keys.select("vector_id").where("vector_id is not null").distinct(), "vector_id", "left_semi")


def neighbourhood(src: DataFrame, value: str, reach: int, default: str = "") -> DataFrame:
    """The value of the `reach` words on either side in the sentence as left_k and right_k."""
    w = Window.partitionBy("file_id", "sentence_id").orderBy("word_id")
    cols = [F.coalesce(F.lag(value, k).over(w), F.lit(default)).alias(f"left_{k}") for k in range(1, reach + 1)]
    cols += [F.coalesce(F.lead(value, k).over(w), F.lit(default)).alias(f"right_{k}") for k in range(1, reach + 1)]
    return src.select(*KEY, *cols)
