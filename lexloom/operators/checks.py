"""Checkers: each gives (file_id, word_id, error, suggest, algorithm, hint, error_type); combining and counting them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["file_id", "word_id"]
RESULT = {"suggest": "array<string>", "algorithm": "string", "hint": "string", "error_type": "string"}


def result(src: DataFrame, found: DataFrame | None, name: str, kind: str = "unknown") -> DataFrame:
    """The full result frame: every word of src; what is no error has nulls. found: key, error and any of the others."""
    if found is None:
        out = src.select(*KEY).withColumn("error", F.lit(False))
        return out.withColumns({c: F.lit(None).cast(t) for c, t in RESULT.items()})
    if "error" not in found.columns:
        raise ValueError("a checker must say where it found an error")
    have = [c for c in RESULT if c in found.columns]
    out = src.select(*KEY).join(found.select(*KEY, "error", *have), KEY, "left").withColumn("error", F.coalesce("error", F.lit(False)))
    fill = {"algorithm": F.lit(name), "error_type": F.lit(kind)}
    cols = {}
    for c, t in RESULT.items():
        value = F.col(c) if c in have else F.lit(None).cast(t)
        cols[c] = F.when(F.col("error"), F.coalesce(value, fill.get(c, F.lit(None).cast(t))))
    return out.withColumns(cols).select(*KEY, "error", *RESULT)


def repetitions(src: DataFrame, within: int = 50, forms: DataFrame | None = None, roots: DataFrame | None = None, index: DataFrame | None = None, simple: bool = True) -> DataFrame:
    """Russian words that an earlier one within `within` ids repeats: by its letters, its normal form, its root.

    forms: word_id, normal_form; roots: word_id, morpheme; index: the words to be judged (all if none). The first tier
    that hits wins. reference = the nearest earlier word. One lag per tier: n log n, whatever `within` is."""
    ru = src.where("word_type = 'ru' and word is not null").select(*KEY, "word")
    tiers = []
    if simple:
        tiers.append(("word", ru.select(*KEY, F.lower("word").alias("v"))))
    if forms is not None:
        tiers.append(("normal form", ru.join(forms.select("word_id", F.col("normal_form").alias("v")).where("v is not null").distinct(), "word_id").select(*KEY, "v")))
    if roots is not None:
        tiers.append(("root", ru.join(roots.select("word_id", F.col("morpheme").alias("v")).distinct(), "word_id").select(*KEY, "v")))
    out = ru
    for no, (_, values) in enumerate(tiers):
        before = F.lag("word_id").over(Window.partitionBy("file_id", "v").orderBy("word_id"))
        hit = values.withColumn("b", before).where(F.col("word_id") - F.col("b") <= within).groupBy(*KEY).agg(F.max("b").alias(f"r{no}"))
        out = out.join(hit, KEY, "left")
    refs = [F.col(f"r{no}") for no in range(len(tiers))]
    how = F.coalesce(*[F.when(r.isNotNull(), name) for r, (name, _) in zip(refs, tiers)])
    out = out.withColumn("reference", F.coalesce(*refs)).withColumn("how", how).where("reference is not null")
    if index is not None:
        out = out.join(index.select(*KEY).distinct(), KEY, "left_semi")
    return out.select(*KEY, F.lit(True).alias("error"), "reference", "how", F.concat(F.lit("repeats a "), "how").alias("hint"), F.lit("stylistic").alias("error_type"))


def spelling(src: DataFrame, dictionary: DataFrame, suggestions: int = 3, distance: int = 1) -> DataFrame:
    """Russian words outside the dictionary (word), with the dictionary's words at most `distance` edits away.

    Distinct words only; candidates meet on their deletions (words within d edits share what is left of both after
    leaving out at most d letters), then are measured. Order: distance, then the alphabet. distance: 1 or 2, as the number of
    deletions grows with its power."""
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    low = src.where("word_type = 'ru' and word is not null").select(*KEY, F.lower("word").alias("w"))
    known = dictionary.select(F.lower("word").alias("w")).distinct()
    wrong = low.select("w").distinct().join(known, "w", "left_anti")
    cut = "array_union(array(w), transform(sequence(1, greatest(1, length(w))), k -> concat(substring(w, 1, k - 1), substring(w, k + 1))))"
    if distance == 2:
        cut = f"array_distinct(flatten(transform({cut}, v -> array_union(array(v), transform(sequence(1, greatest(1, length(v))), k -> concat(substring(v, 1, k - 1), substring(v, k + 1)))))))"
    a = wrong.select(F.col("w").alias("bad"), F.explode(F.expr(cut)).alias("cut"))
    b = known.select(F.col("w").alias("good"), F.explode(F.expr(cut)).alias("cut"))
    near = a.join(b, "cut").select("bad", "good").distinct().withColumn("d", F.levenshtein("bad", "good")).where(F.col("d") <= distance)
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("bad").orderBy("d", "good"))).where(F.col("n") <= suggestions)
    lists = best.groupBy("bad").agg(F.sort_array(F.collect_list(F.struct("n", "good"))).alias("l")).select(F.col("bad").alias("w"), F.transform("l", lambda x: x["good"]).alias("suggest"))
    found = low.join(wrong, "w").join(lists, "w", "left")
    return found.select(*KEY, F.lit(True).alias("error"), F.coalesce("suggest", F.array().cast("array<string>")).alias("suggest"), F.lit("orthographic").alias("error_type"))


def combined(src: DataFrame, results: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One verdict per word: that of the first checker in the list that flags it."""
    union = None
    for no, (name, r) in enumerate(results):
        cols = [F.col(c) if c in r.columns else F.lit(None).cast(t).alias(c) for c, t in RESULT.items()]
        own = r.where("error").select(*KEY, F.lit(no).alias("no"), *cols).withColumn("algorithm", F.coalesce("algorithm", F.lit(name)))
        union = own if union is None else union.unionByName(own)
    first = union.groupBy(*KEY).agg(F.min_by(F.struct(*RESULT), "no").alias("x")).select(*KEY, "x.*", F.lit(True).alias("error"))
    return src.select(*KEY).join(first, KEY, "left").select(*KEY, F.coalesce("error", F.lit(False)).alias("error"), *RESULT)


def all_errors(results: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Every error of every checker, by word."""
    union = None
    for name, r in results:
        cols = [F.col(c) if c in r.columns else F.lit(None).cast(t).alias(c) for c, t in RESULT.items()]
        own = r.where("error").select(*KEY, *cols).withColumn("algorithm", F.coalesce("algorithm", F.lit(name)))
        union = own if union is None else union.unionByName(own)
    return union.orderBy("file_id", "word_id", "algorithm")


def merged_by_text(results: Sequence[DataFrame]) -> DataFrame:
    """Verdicts on texts put together: error if any says so, all suggestions, the last type. Each: text, error, suggest, error_type."""
    union = None
    for no, r in enumerate(results):
        own = r.select("text", "error", "suggest", "error_type", F.lit(no).alias("no"))
        union = own if union is None else union.unionByName(own)
    return union.groupBy("text").agg(
        F.bool_or("error").alias("error"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "suggest"))), lambda x: F.coalesce(x["suggest"], F.array().cast("array<string>")))).alias("suggest"),
        F.max_by("error_type", F.when(F.col("error_type").isNotNull(), F.col("no"))).alias("error_type"),
    )


def rare_spelling(src: DataFrame, forms: DataFrame, wrong: DataFrame, less: int = 3) -> DataFrame:
    """Spelling errors only where the word's normal form comes fewer than `less` times in the file."""
    n = F.count(F.lit(1)).over(Window.partitionBy("file_id", "normal_form"))
    rare = src.select(*KEY).join(forms.select("word_id", "normal_form").distinct(), "word_id").withColumn("n", n).where(F.col("n") < less)
    return wrong.join(rare.select(*KEY), KEY, "left_semi")


def house_check(src: DataFrame, forms: DataFrame, wrong: DataFrame, more: Sequence[tuple[str, DataFrame]] = (), stop_pos: Sequence[str] = ("PREP", "CONJ", "PRCL", "NPRO")) -> DataFrame:
    """Rare spelling errors, then repetitions within 20 words except of the stop parts of speech, then further checkers."""
    spoken = forms.where(~F.coalesce(F.col("pos"), F.lit("NONE")).isin(*stop_pos)).select("word_id").distinct()
    again = repetitions(src, 20, forms).join(spoken, "word_id", "left_semi")
    return combined(src, [("spelling", rare_spelling(src, forms, wrong)), ("repetitions", again), *more])


# What the three kinds of alternatives look like, in small letters.
TARGETS = {"tsa": "т(ь)?ся$", "chtoby": "^(чтобы|что бы)$", "ne": "^не"}


def target_index(src: DataFrame, kind: str) -> DataFrame:
    """(file_id, sentence_id, word_id, word, first, last): the words, or pairs of words, that may be written otherwise.

    tsa: a word in -тся or -ться; chtoby: чтобы, or что with бы right behind it; ne: a word in не-, or не with the word behind it."""
    if kind not in TARGETS:
        raise ValueError(f"there is no kind {kind!r}; there are {', '.join(TARGETS)}")
    low = F.lower("word")
    w = Window.partitionBy("file_id", "sentence_id").orderBy("word_id")
    own = src.where("word is not null").select(*KEY, "sentence_id", low.alias("word")).withColumn("next", F.lead("word").over(w)).withColumn("next_id", F.lead("word_id").over(w))
    two = {"chtoby": (F.col("word") == "что") & (F.col("next") == "бы"), "ne": (F.col("word") == "не") & F.col("next").rlike("^[а-яё]")}.get(kind, F.lit(False))
    found = own.withColumn("two", F.coalesce(two, F.lit(False))).where(F.col("two") | F.col("word").rlike(TARGETS[kind]) & ~F.col("word").isin("не"))
    shown = F.when(F.col("two"), F.concat_ws(" ", "word", "next")).otherwise(F.col("word"))
    return found.select("file_id", "sentence_id", "word_id", shown.alias("word"), F.col("word_id").alias("first"), F.when(F.col("two"), F.col("next_id")).otherwise(F.col("word_id")).alias("last"))


def other_writing(word: Column, kind: str) -> Column:
    """The other way to write what target_index finds."""
    joined = F.regexp_replace(word, " ", "")
    if kind == "tsa":
        return swapped_ending(word, "тся", "ться")
    if kind == "chtoby":
        return F.when(word == "чтобы", "что бы").otherwise("чтобы")
    return F.when(word.contains(" "), joined).otherwise(F.concat(F.lit("не "), F.substr(word, F.lit(3))))


def swapped_ending(word: Column, a: str, b: str) -> Column:
    """The word with ending a for b or b for a; null if it has neither."""
    return F.when(word.endswith(b), F.expr(f"concat(substring(word, 1, length(word) - {len(b)}), '{a}')")).when(word.endswith(a), F.expr(f"concat(substring(word, 1, length(word) - {len(a)}), '{b}')"))


def alternative(src: DataFrame, target: str, predict: Callable[[DataFrame], DataFrame], endings: tuple[str, str] = ("тся", "ться")) -> DataFrame:
    """Words that match `target` and that the given model (adds `p`, the probability that the word is right) doubts."""
    if predict is None:
        raise ValueError("a model is needed: there is none in this library")
    scored = predict(src.where(F.lower("word").rlike(target)))
    bad = scored.where("p < 0.5")
    return bad.select(*KEY, F.lit(True).alias("error"), F.array(swapped_ending(F.col("word"), *endings)).alias("suggest"), F.lit("grammatic").alias("error_type"))


def quality(df: DataFrame, truth: str, predicted: str, *groups: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of boolean columns; null where they aren't defined."""
    t, p = F.col(truth), F.col(predicted)
    out = df.groupBy(*groups).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return out.withColumns(
        {"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))}
    )


def qualified(errors: DataFrame, a: str = "тся", b: str = "ться") -> DataFrame:
    """Errors that are the swap of two endings: the swapped word is among the suggestions."""
    return errors.where(F.array_contains("suggest", swapped_ending(F.col("word"), a, b)))
