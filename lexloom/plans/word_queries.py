"""Queries over token tables: features, checks, sampling, contexts, research operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, context, features, research, sampling, syntax
from ..operators import relational as R
from ..operators import tokens as TK
from ..session import table
from .registry import query

#: The token table without repeated rows, and the parses.
T = "t as (select distinct * exclude (corpus_id, split) from src), m as (select word_id, min(normal_form) as normal_form, min(pos) as pos, min(gender) as gender, max(score) as score from pymorphy group by word_id)"
FORMS = ("word_id", "normal_form", "pos", "gender", "score")


def _src(spark, folder):
    return TK.clean(table(spark, folder, "src"))


def _forms(spark, folder):
    return table(spark, folder, "pymorphy", *FORMS).groupBy("word_id").agg(F.min("normal_form").alias("normal_form"), F.min("pos").alias("pos"), F.min("gender").alias("gender"), F.max("score").alias("score"))


@query(f"with {T} select t.word_id, normal_form, coalesce(pos, 'NONE') as pos from t left join m on m.word_id = t.word_id")
def morphology(spark, folder):
    return features.morphology(_src(spark, folder), _forms(spark, folder)).select("word_id", "normal_form", "pos")


@query(f"with {T} select word_id, case when pos in ('ADJF', 'ADJS') then null else gender end as gender, pos from m")
def without_adjectives(spark, folder):
    return features.without_adjectives(_forms(spark, folder), ["gender"]).select("word_id", "gender", "pos")


@query(f"""with {T}, b as (select t.*, m.normal_form, coalesce(lower(substr(word, 1, 1)) <> substr(word, 1, 1), false) as cap,
 case when word_type = 'ru' then sum((word_type = 'ru')::int) over (partition by file_id, sentence_id order by t.word_id) - 1 else -1 end as o from t left join m on m.word_id = t.word_id)
select word_id, cap as is_capitalized, cast(o as int) as ru_order, cap and o <> 0 as is_unexpectedly_capitalized,
 round(avg(cap::int) over (partition by file_id, coalesce(normal_form, lower(word))), 6) as uc_proportion, bool_or(cap) over (partition by file_id, coalesce(normal_form, lower(word))) as uc_somewhere from b""")
def capitalization(spark, folder):
    out = features.capitalization(_src(spark, folder), _forms(spark, folder))
    return out.drop("file_id").withColumn("uc_proportion", F.round("uc_proportion", 6))


@query(f"""with {T}, b as (select t.file_id, t.word_id, normal_form from t join m on m.word_id = t.word_id where normal_form is not null)
select word_id, normal_form, round(count(*) over (partition by file_id, normal_form) / count(*) over (partition by file_id), 6) as local_freq from b""")
def local_frequency(spark, folder):
    return features.local_frequency(_src(spark, folder), _forms(spark, folder)).drop("file_id").withColumn("local_freq", F.round("local_freq", 6))


@query(f"""with {T}, d as (select lower(ru_word) as normal_form, count(*) * 10 as freq from glossary where ru_word is not null group by 1)
select m.word_id, coalesce(freq, 0) as freq, case when freq is null then 0 else 1 end as freq_found from m left join d on d.normal_form = m.normal_form""")
def dictionary_frequency(spark, folder):
    """Dictionary frequencies of normal forms; the glossary plays the dictionary."""
    d = table(spark, folder, "glossary", "ru_word").where("ru_word is not null").select(F.col("ru_word").alias("lemma"), F.lit(10).alias("freq"), F.lit(1).alias("range"), F.lit(1).alias("juilland"), F.lit(1).alias("text_count"))
    return features.frequencies(_forms(spark, folder), d).select("word_id", "freq", "freq_found")


@query(f"""with {T}, g as (select lower(ru_word) as w from glossary where ru_word is not null group by 1),
d as (select w, unnest([substr(w, 1, 3), substr(w, 4)]) as morpheme, unnest([0, 1]) as morpheme_index, unnest(['ROOT', 'END']) as morpheme_type from g where length(w) > 4)
select m.word_id, morpheme_index, morpheme_type, morpheme from m join d on d.w = m.normal_form""")
def morphemes(spark, folder):
    """Morphemes of normal forms; the glossary's words, cut after three letters, play the dictionary."""
    w = F.lower("ru_word")
    lines = table(spark, folder, "glossary", "ru_word").where("length(ru_word) > 4").select(F.lit(1).alias("no"), F.concat(w, F.lit("\t"), F.substring(w, 1, 3), F.lit(":ROOT/"), F.substring(w, 4, 100), F.lit(":END")).alias("line"))
    return features.morphemes(_forms(spark, folder), features.morpheme_dictionary(lines))


@query(f"""with {T}, v as (select lower(ru_word) as term, min(length(ru_word)) as vector_id from glossary where ru_word is not null group by 1),
b as (select t.word_id, word, normal_form from t left join m on m.word_id = t.word_id where word_type = 'ru'),
e as (select word_id, unnest([0, 1, 2, 3, 4, 5]) as no, unnest([word, translate(word, 'ёЁ', 'еЕ'), lower(word), translate(lower(word), 'ёЁ', 'еЕ'), normal_form, translate(normal_form, 'ёЁ', 'еЕ')]) as term,
 unnest(['word', 'word_e', 'lower', 'lower_e', 'normal_form', 'normal_form_e']) as how from b),
h as (select e.*, vector_id, row_number() over (partition by word_id order by no) as n from e join v using (term))
select b.word_id, coalesce(h.term, '<unk>') as selected_word, h.how as selected_word_column, h.vector_id from b left join h on h.word_id = b.word_id and n = 1""")
def vector_keys(spark, folder):
    v = table(spark, folder, "glossary", "ru_word").where("ru_word is not null").groupBy(F.lower("ru_word").alias("term")).agg(F.min(F.length("ru_word")).alias("vector_id"))
    return features.vector_keys(_src(spark, folder), _forms(spark, folder), v).drop("file_id")


@query(f"""with {T}, b as (select t.file_id, t.word_id, sentence_id, coalesce(pos, 'NONE') as pos from t left join m on m.word_id = t.word_id where sentence_id is not null)
select word_id, coalesce(lag(pos, 1) over w, '') as left_1, coalesce(lag(pos, 2) over w, '') as left_2, coalesce(lead(pos, 1) over w, '') as right_1, coalesce(lead(pos, 2) over w, '') as right_2
from b window w as (partition by file_id, sentence_id order by word_id)""")
def neighbourhood(spark, folder):
    s = _src(spark, folder).where("sentence_id is not null").join(_forms(spark, folder).select("word_id", "pos"), "word_id", "left").withColumn("pos", F.coalesce("pos", F.lit("NONE")))
    return features.neighbourhood(s, "pos", 2).drop("file_id")


# Syntax: the tables have no dependencies; word i of a sentence hangs on word (i - 1) div 2.

TREE = f"""{T}, e as (select t.file_id, t.sentence_id, t.word_id, case when word_index = 0 then -1 else t.word_id - word_index + (word_index - 1) // 2 end as parent, word_type as relation
 from t where sentence_id is not null and word_index is not null)"""


def _edges(spark, folder):
    s = _src(spark, folder).where("sentence_id is not null and word_index is not null")
    return s.select("file_id", "sentence_id", "word_id", F.expr("if(word_index = 0, -1, word_id - word_index + (word_index - 1) div 2)").alias("syntax_parent_id"), F.col("word_type").alias("relation"))


@query(f"""with recursive {TREE}, c as (select file_id, sentence_id, word_id, parent as ancestor_id, relation, 1 as distance from e where parent <> -1
 union all select c.file_id, c.sentence_id, c.word_id, e.parent, e.relation, c.distance + 1 from c join e on e.file_id = c.file_id and e.sentence_id = c.sentence_id and e.word_id = c.ancestor_id where e.parent <> -1 and c.distance < 20)
select sentence_id, word_id, ancestor_id, relation, distance from c""")
def tree_closure(spark, folder):
    return syntax.closure(_edges(spark, folder)).drop("file_id")


@query(f"""with recursive {TREE}, c as (select file_id, sentence_id, word_id, parent as ancestor_id, 1 as distance from e where parent <> -1
 union all select c.file_id, c.sentence_id, c.word_id, e.parent, c.distance + 1 from c join e on e.file_id = c.file_id and e.sentence_id = c.sentence_id and e.word_id = c.ancestor_id where e.parent <> -1 and c.distance < 20),
u as (select file_id, sentence_id, word_id, max(distance) as up_depth from c group by all),
d as (select file_id, sentence_id, ancestor_id as word_id, count(*) filter (distance = 1) as children, count(*) as descendants, max(distance) as down_depth from c group by all)
select e.word_id, coalesce(children, 0) as children, coalesce(descendants, 0) as descendants, coalesce(up_depth, 0) as up_depth, coalesce(down_depth, 0) as down_depth,
 count(*) over (partition by e.file_id, e.sentence_id) as sentence_length, round(coalesce(descendants, 0) / count(*) over (partition by e.file_id, e.sentence_id), 6) as descendants_relative
from e left join u using (file_id, sentence_id, word_id) left join d using (file_id, sentence_id, word_id)""")
def tree_stats(spark, folder):
    e = _edges(spark, folder)
    out = syntax.tree_stats(e, syntax.closure(e))
    return out.drop("file_id", "sentence_id").withColumn("descendants_relative", F.round("descendants_relative", 6))


@query()
def tree_repair(spark, folder):
    """Trees with several roots and cycles, mended: every third word without parent, every fifth hanging on the next one."""
    e = _edges(spark, folder)
    broken = F.when(F.col("word_id") % 3 == 0, -1).when(F.col("word_id") % 5 == 0, F.col("word_id") + 1).otherwise(F.col("syntax_parent_id"))
    inside = e.withColumn("hi", F.max("word_id").over(syntax.Window.partitionBy("file_id", "sentence_id")))
    return syntax.repaired(inside.withColumn("syntax_parent_id", F.when(broken > F.col("hi"), -1).otherwise(broken)).drop("hi"))


@query(f"""with {TREE}, l as (select file_id, sentence_id, parent as word_id, word_id as child_id, abs(word_id - parent) as d from e where parent <> -1)
select word_id, place, child_id from (select *, row_number() over (partition by file_id, sentence_id, word_id order by d, child_id) as place from l) where place <= 2""")
def nearest_children(spark, folder):
    return syntax.nearest_children(_edges(spark, folder), 2).select("word_id", "place", "child_id")


# Checkers


@query(f"""with {T}, r as (select file_id, t.word_id, lower(word) as w, normal_form from t left join m on m.word_id = t.word_id where word_type = 'ru' and word is not null),
a as (select file_id, word_id, lag(word_id) over (partition by file_id, w order by word_id) as b from r), n as (select file_id, word_id, lag(word_id) over (partition by file_id, normal_form order by word_id) as b from r where normal_form is not null),
x as (select r.word_id, case when r.word_id - a.b <= 50 then a.b end as ra, case when r.word_id - n.b <= 50 then n.b end as rn from r left join a on a.word_id = r.word_id left join n on n.word_id = r.word_id)
select word_id, coalesce(ra, rn) as reference, case when ra is not null then 'word' else 'normal form' end as how from x where coalesce(ra, rn) is not null""")
def repetition_hits(spark, folder):
    return checks.repetitions(_src(spark, folder), 50, _forms(spark, folder)).select("word_id", "reference", "how")


@query(f"""with {T}, r as (select file_id, word_id, lower(word) as w from t where word_type = 'ru' and word is not null), a as (select word_id, word_id - lag(word_id) over (partition by file_id, w order by word_id) <= 20 as hit from r)
select t.word_id, coalesce(a.hit, false) or coalesce(word_length > 12, false) as error, case when coalesce(a.hit, false) then 'repetitions' when word_length > 12 then 'long' end as algorithm
from t left join a on a.word_id = t.word_id""")
def combined_checks(spark, folder):
    src = _src(spark, folder)
    long = src.where("word_length > 12").select("file_id", "word_id", F.lit(True).alias("error"))
    return checks.combined(src, [("repetitions", checks.repetitions(src, 20)), ("long", long)]).select("word_id", "error", "algorithm")


def _dictionary(spark, folder):
    return table(spark, folder, "glossary", "ru_word").where("ru_word is not null").select(F.col("ru_word").alias("word"))


@query(f"""with {T} select word_id from t where word_type = 'ru' and word is not null and lower(word) not in (select lower(ru_word) from glossary where ru_word is not null)""")
def unknown_words(spark, folder):
    """Words outside a dictionary; the glossary plays the dictionary."""
    return checks.spelling(_src(spark, folder), _dictionary(spark, folder)).select("word_id")


#: Russian letters as single bytes, as DuckDB measures edits in bytes.
BYTES = "translate({}, 'абвгдежзийклмнопрстуфхцчшщъыьэюяё′', 'abcdefghijklmnopqrstuvwxyz012345678')"


@query(f"""with {T}, g as (select distinct lower(ru_word) as w from glossary where ru_word is not null), b as (select word_id, lower(word) as w from t where word_type = 'ru' and word is not null and lower(word) not in (select w from g)),
u as (select distinct w from b), p as (select u.w, g.w as good, levenshtein({BYTES.format('u.w')}, {BYTES.format('g.w')}) as d from u join g on abs(length(u.w) - length(g.w)) <= 1),
l as (select w, list(good order by d, good)[1:3] as suggest from p where d <= 1 group by w) select word_id, coalesce(suggest, []::varchar[]) as suggest from b left join l using (w)""")
def spelling_suggestions(spark, folder):
    return checks.spelling(_src(spark, folder), _dictionary(spark, folder)).select("word_id", "suggest")


@query(f"""with {T}, g as (select distinct lower(ru_word) as w from glossary where ru_word is not null),
b as (select t.file_id, t.word_id, lower(word) as w from t where word_type = 'ru' and word is not null and lower(word) not in (select w from g)),
c as (select file_id, word_id, count(*) over (partition by file_id, normal_form) as n from t join (select distinct word_id, normal_form from m) using (word_id))
select b.word_id from b join c using (file_id, word_id) where n < 3""")
def rare_spelling(spark, folder):
    src, forms = _src(spark, folder), _forms(spark, folder)
    return checks.rare_spelling(src, forms, checks.spelling(src, _dictionary(spark, folder))).select("word_id")


@query("""with l as (select distinct doc_id, rater, toxic from review_label), x as (select doc_id, rater, max(toxic) = 1 as said from l group by all), y as (select doc_id, max(toxic) = 1 as truth from l group by doc_id),
j as (select rater, said, truth from x join y using (doc_id)), c as (select rater, count(*) filter (truth and said) as tp, count(*) filter (not truth and said) as fp, count(*) filter (truth and not said) as fn, count(*) filter (not truth and not said) as tn from j group by rater)
select rater, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c""")
def rater_quality(spark, folder):
    l = table(spark, folder, "review_label", "doc_id", "rater", "toxic").distinct()
    x = l.groupBy("doc_id", "rater").agg((F.max("toxic") == 1).alias("said")).join(l.groupBy("doc_id").agg((F.max("toxic") == 1).alias("truth")), "doc_id")
    return checks.quality(x, "truth", "said", "rater").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# Sampling


@query(f"""with t as (select distinct corpus_id, word_id, sentence_id from src where sentence_id is not null), n as (select corpus_id, sentence_id, count(*) as len from t group by all)
select corpus_id, cast(floor(log2(len) + 1e-9) as int) as log_len, count(*) as sentences, sum(len) as words from n group by all""")
def sentence_length_buckets(spark, folder):
    return sampling.buckets(_src(spark, folder)).groupBy("corpus_id", "log_len").agg(F.count(F.lit(1)).alias("sentences"), F.sum("len").alias("words"))


@query("""with t as (select distinct corpus_id, word_id, sentence_id, word from src where sentence_id is not null), n as (select corpus_id, sentence_id, cast(floor(log2(count(*)) + 1e-9) as int) as b from t group by all),
k as (select corpus_id, sentence_id from (select *, row_number() over (partition by corpus_id, b order by md5('0:' || sentence_id), sentence_id) as n from n) where n <= 20)
select t.word_id, t.word from t join k using (corpus_id, sentence_id)""")
def bucket_balanced(spark, folder):
    src = _src(spark, folder)
    allowed = sampling.capped(sampling.buckets(src), ["corpus_id", "log_len"], "sentence_id", 20)
    return sampling.selected(src, allowed).select("word_id", "word")


@query("""with t as (select distinct corpus_id, word_id, sentence_id from src where sentence_id is not null and word is not null), n0 as (select corpus_id, sentence_id, count(*) as n from t group by all), n as (select corpus_id, sentence_id, corpus_id || '/' || cast(round_even(ln(n), 0) as int) as bucket from n0),
k as (select bucket, sentence_id, row_number() over (partition by bucket order by md5('0:' || sentence_id), sentence_id) as n from n)
select bucket, list_sort(list(sentence_id)) as sentences from k where n <= 5 group by bucket""")
def rounded_buckets(spark, folder):
    return sampling.rounded_buckets(_src(spark, folder), 5)


SHARES = f"""{T}, c as (select file_id, coalesce(pos, 'NONE') as category, count(*) as n from t left join m on m.word_id = t.word_id group by all), f as (select file_id, category, n / sum(n) over (partition by file_id) as fraction from c)"""


@query(f"with {SHARES} select file_id, category, round(fraction, 6) as fraction from f")
def category_fractions(spark, folder):
    return R.fractions(features.morphology(_src(spark, folder), _forms(spark, folder)).withColumnRenamed("pos", "category"), ["file_id"], "category").withColumn("fraction", F.round("fraction", 6))


@query(f"""with {SHARES}, cats as (select unnest(['NOUN', 'VERB', 'ADJF', 'NONE', 'PREP', 'CONJ']) as category), d as (select file_id, category, coalesce(fraction, 0) as fraction from (select distinct file_id from f) cross join cats left join f using (file_id, category)),
tr as (select d.* from d join (select distinct file_id from src where corpus_id = 'proza.fantasy.zip') using (file_id)), st as (select category, avg(fraction) as mean, stddev_samp(fraction) as std from tr group by category)
select file_id, round(max(abs(fraction - mean) / std), 5) as max_deviation, round(sum(abs(fraction - mean) / std), 5) as sum_deviation from d join st using (category) where std > 1e-12 group by file_id""")
def control_deviation(spark, folder):
    src = _src(spark, folder)
    f = R.fractions(features.morphology(src, _forms(spark, folder)).withColumnRenamed("pos", "category"), ["file_id"], "category")
    train = R.keep(f, src.where("corpus_id = 'proza.fantasy.zip'"), ["file_id"])
    out = sampling.control(f, train, ["NOUN", "VERB", "ADJF", "NONE", "PREP", "CONJ"])
    return out.withColumns({c: F.round(c, 5) for c in ("max_deviation", "sum_deviation")})


SEQ = """x as (select *, (lower(word) = 'и' and lower(lead(word, 1) over w) = 'никому') or (lower(word) = 'но' and lower(lead(word, 1) over w) = 'никто') as hit from t window w as (partition by file_id order by word_id))"""


@query(f"""with {T}, {SEQ} select word_id, word, coalesce(hit, false) as is_target from x where sentence_id is not null and (file_id, sentence_id) in (select (file_id, sentence_id) from x where hit and sentence_id is not null)""")
def sequence_targets(spark, folder):
    s = _src(spark, folder)
    out = sampling.with_target(s, sampling.starts_sequence([["и", "никому"], ["но", "никто"]]))
    return out.where("sentence_id is not null").select("word_id", "word", "is_target")


@query(f"""with {T}, x as (select file_id, sentence_id, word_id, word, coalesce(word like '%ая' or word like '%ую', false) as hit from t where sentence_id is not null),
r as (select *, sum(hit::int) over (partition by file_id, sentence_id order by word_id) - 1 as k, sum(hit::int) over (partition by file_id, sentence_id) as m from x),
v as (select *, unnest(range(m::bigint)) as variant_no from r where m > 0)
select word_id, cast(variant_no as int) as variant_no, hit and k = variant_no as is_target,
 case when hit and k = variant_no then case when word like '%ая' then substr(word, 1, length(word) - 2) || 'ую' else substr(word, 1, length(word) - 2) || 'ая' end else word end as word from v""")
def negative_variants(spark, folder):
    s = _src(spark, folder).where("sentence_id is not null")
    t = sampling.with_target(s, F.col("word").endswith("ая") | F.col("word").endswith("ую"))
    return sampling.swap_endings(sampling.variants(t), "ая", "ую").select("word_id", "variant_no", "is_target", "word")


@query(f"""with {T}, w as (select lower(word) as w from t where word is not null), e as (select case when w like '%ый' then 'ый' when w like '%ую' then 'ую' end as e, substr(w, 1, length(w) - 2) as stem from w where w like '%ый' or w like '%ую'),
n as (select stem, count(*) filter (e = 'ый') as n_a, count(*) filter (e = 'ую') as n_b from e group by stem) select stem, n_a, n_b, round(least(n_a / n_b, n_b / n_a), 6) as ratio from n where n_a > 0 and n_b > 0""")
def ending_pairs(spark, folder):
    return sampling.ending_pairs(_src(spark, folder), "ый", "ую").withColumn("ratio", F.round("ratio", 6))


@query(f"""with {T}, i as (select word_id, sentence_id, lower(word) as reference, case when word like '%ая' then 1 else 0 end as label from t where word like '%ая' or word like '%ый')
select word_id as sample_id, word_id, sentence_id, label, case when h < 80 then 'train' when h < 90 then 'display' else 'test' end as split, reference from (select *, cast('0x' || substr(md5('0:' || reference), 1, 6) as bigint) % 100 as h from i)""")
def training_index(spark, folder):
    t = _src(spark, folder).withColumn("reference", F.lower("word")).withColumn("is_target", F.coalesce(F.col("word").endswith("ая") | F.col("word").endswith("ый"), F.lit(False)))
    return sampling.index(t, F.col("word").endswith("ая").cast("int"), "reference")


@query("""with d as (select doc_id, coalesce(lang, '?') as lang from documents), p as (select *, (row_number() over (partition by lang order by md5('0:' || doc_id), doc_id) - 1) / count(*) over (partition by lang) as p from d)
select doc_id, case when p < 0.8 then 'train' when p < 0.9 then 'display' else 'test' end as split from p""")
def stratified_split(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "lang").withColumn("lang", F.coalesce("lang", F.lit("?")))
    return sampling.stratified(d, ["lang"], "doc_id").select("doc_id", "split")


# Contexts


@query(f"""with {T}, i as (select file_id, sentence_id, word_id from t where sentence_id is not null and lower(word) in ('не', 'the')), l as (select file_id, sentence_id, min(word_id) as lo, max(word_id) as hi from t group by all)
select word_id as sample_id, cast(o as int) as offset_, word_id + o as another_word_id from i join l using (file_id, sentence_id), lateral (select unnest(range(greatest(-3, lo - word_id), least(2, hi - word_id) + 1)) as o) where o <> 0""")
def context_windows(spark, folder):
    s = _src(spark, folder).where("sentence_id is not null")
    i = s.where("lower(word) in ('не', 'the')").withColumn("sample_id", F.col("word_id")).select("sample_id", "word_id", "sentence_id", "file_id")
    return context.contexts(i, s, 5, 0.5).withColumnRenamed("offset", "offset_")


@query(f"""with {T}, n as (select word_id, file_id, sentence_id, coalesce(word_type <> 'punct' and lead(word) over (partition by file_id, sentence_id order by word_id) in (',', '.'), false) as hit, lead(word) over (partition by file_id, sentence_id order by word_id) as label from t where sentence_id is not null)
select word_id, label from n where hit""")
def next_signs(spark, folder):
    s = _src(spark, folder).where("sentence_id is not null").withColumn("hit", sampling.next_sign([",", "."]))
    label = F.lead("word").over(syntax.Window.partitionBy("file_id", "sentence_id").orderBy("word_id"))
    return s.withColumn("label", label).where("hit").select("word_id", "label")


# Research operators


@query(f"""with {T}, w as (select file_id, lower(word) as name, count(*) as n, bool_and(lower(substr(word, 1, 1)) <> substr(word, 1, 1)) as always from t where word_type in ('ru', 'en') group by file_id, lower(word))
select file_id, name, n from w where always and n > 2""")
def proper_names(spark, folder):
    return research.proper_names(_src(spark, folder))


ANTE = f"""{T}, b as (select t.file_id, t.word_id, m.pos, m.gender from t join m on m.word_id = t.word_id where gender is not null), n as (select *, row_number() over (partition by file_id, gender order by word_id) as no from b where pos = 'NOUN'),
p as (select b.file_id, b.word_id, b.gender, (select max(no) from n where n.file_id = b.file_id and n.gender = b.gender and n.word_id < b.word_id) as last from b where pos = 'VERB'),
c as (select p.file_id, p.word_id, n.word_id as candidate_id, cast(p.last - n.no + 1 as int) as place from p join n on n.file_id = p.file_id and n.gender = p.gender and n.no between p.last - 2 and p.last)"""


@query(f"with {ANTE} select word_id, candidate_id, place from c")
def antecedent_candidates(spark, folder):
    """The three nearest earlier nouns of the same gender; verbs stand for pronouns, which the tables don't mark."""
    return _candidates(spark, folder).drop("file_id")


def _candidates(spark, folder):
    b = _src(spark, folder).select("file_id", "word_id").join(_forms(spark, folder), "word_id").where("gender is not null")
    return research.antecedents(b.where("pos = 'NOUN'"), b.where("pos = 'VERB'"), 3)


@query(f"""with {ANTE}, a as (select file_id, word_id, sum((coalesce(word_type, 'unk') <> 'punct')::int) over (partition by file_id order by word_id) as n, dense_rank() over (partition by file_id order by sentence_id nulls first) as s, dense_rank() over (partition by file_id order by paragraph_id) as g from t)
select c.word_id, c.candidate_id, x.n - y.n - 1 as words_between, x.s - y.s as sentences_between, x.g - y.g as paragraphs_between, row_number() over (partition by c.file_id, c.word_id order by c.candidate_id desc) - 1 as candidates_between
from c join a x on x.word_id = c.word_id and x.file_id = c.file_id join a y on y.word_id = c.candidate_id and y.file_id = c.file_id""")
def candidate_distances(spark, folder):
    return research.distances(_candidates(spark, folder), _src(spark, folder)).drop("file_id")


@query(f"""with {T}, w as (select file_id, word, row_number() over (partition by file_id order by word_id) as i from t)
select least(a.word, b.word) as a, greatest(a.word, b.word) as b, count(*) as n from w a join w b on a.file_id = b.file_id and b.i between a.i - 4 and a.i - 1 where a.word is not null and b.word is not null group by 1, 2""")
def cooccurrence(spark, folder):
    return research.cooccurrence(_src(spark, folder), 4)


@query(f"""with {T}, b as (select t.file_id, t.word_id, m.pos from t join m on m.word_id = t.word_id where pos is not null) select word_id, pos from b qualify word_id <> min(word_id) over (partition by file_id, pos)""")
def not_first_mention(spark, folder):
    b = _src(spark, folder).select("file_id", "word_id").join(_forms(spark, folder).select("word_id", "pos"), "word_id").where("pos is not null")
    return research.not_first_mention(b, "pos").drop("file_id")


@query("""with p as (select distinct word_id, gender, score from pymorphy) select word_id, round(coalesce(sum(score) filter (gender = 'masc'), 0), 6) as masc, round(coalesce(sum(score) filter (gender = 'femn'), 0), 6) as femn,
 round(coalesce(sum(score) filter (gender = 'neut'), 0), 6) as neut from p group by word_id""")
def gender_scores(spark, folder):
    out = research.gender_scores(table(spark, folder, "pymorphy", "word_id", "gender", "score").distinct())
    return out.withColumns({c: F.round(c, 6) for c in ("masc", "femn", "neut")})


ENDINGS = ["ый", "ий", "ой", "ая", "ое", "ую", "ого", "ым", "ом"]


@query(f"""with {T}, b as (select t.word_id, word, m.normal_form from t join m on m.word_id = t.word_id where pos = 'ADJF'), e as (select word_id, regexp_extract(lower(word), '(ого|ая|ий|ое|ой|ом|ую|ый|ым)$', 1) as ending, regexp_extract(lower(normal_form), '(ий|ой|ый)$', 1) as kind from b),
l as (select word_id, ending, case kind when 'ый' then 0 when 'ий' then 1 when 'ой' then 2 end as declension, case ending when 'ый' then 0 when 'ая' then 1 when 'ое' then 2 when 'ую' then 3 when 'ого' then 4 end as label from e)
select *, declension is null or label is null as thrown from l""")
def agreement_index(spark, folder):
    out = research.agreement_index(_src(spark, folder), _forms(spark, folder), "ADJF", ENDINGS, {"ый": 0, "ий": 1, "ой": 2}, {"ый": 0, "ая": 1, "ое": 2, "ую": 3, "ого": 4})
    return out.select("word_id", "ending", "declension", "label", "thrown")


@query(f"""with {T}, r as (select *, dense_rank() over (partition by file_id order by sentence_id) as k from t where sentence_id is not null) select word_id, word from r where k <= 2""")
def first_sentences(spark, folder):
    return research.first_sentences(_src(spark, folder), 2).select("word_id", "word")


@query(f"""with {T}, n as (select word_type, word, count(*) as n from t where word_type is not null and word is not null group by all), r as (select *, row_number() over (partition by word_type order by n desc, word) - 1 as r from n)
select word_type, sum(n) as popularity, max(case when r = 0 then word end) as c0, max(case when r = 1 then word end) as c1, max(case when r = 2 then word end) as c2 from r group by word_type""")
def sample_table(spark, folder):
    s = _src(spark, folder).where("word_type is not null and word is not null")
    return TK.sample_table(s, "word_type", "word", 3, [])


@query(f"""with {T}, n as (select word as term, count(*) as count from t where word is not null group by word order by count desc, term limit 50)
select cast(row_number() over (order by count desc, term) as int) as id, term, count from n union all select 0, 'UNK', 0""")
def vocabulary_top(spark, folder):
    return R.vocabulary(_src(spark, folder), "word", 50)


