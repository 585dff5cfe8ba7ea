"""Further queries over token tables: stems, trees, checks, training sets, contexts, antecedents, matrices, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, checks, context, features, research, sampling, syntax
from ..operators import relational as R
from ..operators import tokens as TK
from ..session import table
from .registry import query
from .word_queries import TREE, T, _edges, _forms, _src

V = features.VOWELS
#: The published stemming rules as SQL: head (up to the first vowel), rest, second (where the second syllable ends).
STEM = f"""w as (select distinct word from src where word is not null), s0 as (select word, translate(lower(word), 'ёЁ', 'еЕ') as low from w),
 s1 as (select *, regexp_extract(low, '^[^{V}]*[{V}]') as head, length(regexp_extract(low, '^.*?[{V}][^{V}].*?[{V}][^{V}]')) as second from s0),
 s2 as (select *, substr(low, length(head) + 1) as rest from s1),
 s3 as (select *, case when regexp_replace(rest, '(?:{features.GERUND})$', '') <> rest then regexp_replace(rest, '(?:{features.GERUND})$', '') else regexp_replace(rest, '([ая])(?:{features.GERUND_A})$', '\\1') end as g,
  regexp_replace(rest, '(?:ся|сь)$', '') as a from s2),
 s4 as (select *, regexp_replace(a, '(?:{features.ADJECTIVE})$', '') as j, regexp_replace(a, '([ая])(?:{features.VERB_A})$|(?:{features.VERB})$', '\\1') as v, regexp_replace(a, '(?:{features.NOUN})$', '') as n from s3),
 s5 as (select *, case when g <> rest then g when j <> a then case when regexp_replace(j, '(?:{features.PARTICIPLE})$', '') <> j then regexp_replace(j, '(?:{features.PARTICIPLE})$', '')
  else regexp_replace(j, '([ая])(?:{features.PARTICIPLE_A})$', '\\1') end when v <> a then v else n end as f from s4),
 s6 as (select *, regexp_replace(f, 'и$', '') as i from s5),
 s7 as (select *, case when second > 0 and length(head) + length(regexp_replace(i, 'ость?$', '')) >= second then regexp_replace(i, 'ость?$', '') else i end as d from s6),
 s8 as (select word, low, case when head = '' then low else head || case when regexp_replace(d, 'ейше?$', '') <> d then regexp_replace(regexp_replace(d, 'ейше?$', ''), 'нн$', 'н')
  else regexp_replace(regexp_replace(d, 'нн$', 'н'), 'ь$', '') end end as stem from s7)"""


@query(f"with {T}, {STEM} select t.word_id, low as word, stem, substr(low, length(stem) + 1) as ending from t join s8 on s8.word = t.word")
def stems(spark, folder):
    """Russian stems by the Snowball algorithm."""
    return features.stems(_src(spark, folder).where("word is not null")).drop("pos", "file_id")


@query(f"""with {T}, e as (select file_id, sentence_id, word_id, word_index + 1 as n, (word_index + 1) // 2 as head from t where sentence_id is not null and word_index is not null)
select e.word_id, coalesce(h.word_id, -1) as syntax_parent_id from e left join e h on h.file_id = e.file_id and h.sentence_id = e.sentence_id and h.n = e.head""")
def syntax_heads(spark, folder):
    """Parents of words from the numbers of their heads in the sentence."""
    s = _src(spark, folder).where("sentence_id is not null and word_index is not null")
    numbered = s.select("file_id", "sentence_id", "word_id", (F.col("word_index") + 1).alias("syntax_id"), F.expr("(word_index + 1) div 2").cast("int").alias("syntax_head_id"))
    return syntax.heads(numbered).select("word_id", "syntax_parent_id")


@query(f"with {TREE} select e.word_id, count(c.word_id) as links_to from e left join e c on c.file_id = e.file_id and c.sentence_id = e.sentence_id and c.parent = e.word_id group by e.word_id")
def tree_links(spark, folder):
    """How many words hang on each word."""
    return syntax.links(_edges(spark, folder)).select("word_id", "links_to")


#: Trees of which some have no root and some have several.
ROOTS = f"""{TREE}, x as (select *, case when sentence_id % 3 = 0 and parent = -1 then word_id + 1 when sentence_id % 3 = 1 and word_id % 4 = 0 then -1 else parent end as p from e),
 l as (select x.*, (select count(*) from x c where c.file_id = x.file_id and c.sentence_id = x.sentence_id and c.p = x.word_id) as links, count(*) filter (p = -1) over (partition by file_id, sentence_id) as roots from x),
 r as (select *, row_number() over (partition by file_id, sentence_id order by (p = -1 or roots = 0) desc, links desc, word_id) = 1 as chosen from l),
 c as (select *, max(case when chosen then word_id end) over (partition by file_id, sentence_id) as top from r)"""


def _rootless(spark, folder):
    e = _edges(spark, folder)
    parent = F.col("syntax_parent_id")
    return e.withColumn("syntax_parent_id", F.when((F.col("sentence_id") % 3 == 0) & (parent == -1), F.col("word_id") + 1).when((F.col("sentence_id") % 3 == 1) & (F.col("word_id") % 4 == 0), -1).otherwise(parent))


@query(f"""with {ROOTS} select word_id, case when chosen then -1 when p = -1 then top else p end as syntax_parent_id,
 case when chosen and roots = 0 then 'Picked' when chosen and roots = 1 then 'Good' when chosen then 'KeptMultRoot' when p = -1 then 'DeletedMultRoot' else 'No' end as root from c""")
def tree_roots(spark, folder):
    """One root for every sentence: picked where there is none, the heaviest kept where there are several."""
    return syntax.one_root(_rootless(spark, folder)).select("word_id", "syntax_parent_id", "root")


@query(f"""with {ROOTS}, n as (select file_id, sentence_id, max(roots) as roots, max(word_id) as hi, min(word_id) as lo from c group by all)
select 'roots' as problem, sentence_id from n where roots <> 1 union all select distinct 'parent', c.sentence_id from c left join c o on o.file_id = c.file_id and o.sentence_id = c.sentence_id and o.word_id = c.p where c.p <> -1 and o.word_id is null""")
def tree_problems(spark, folder):
    """Sentences whose tree is none."""
    return syntax.problems(_rootless(spark, folder)).select("problem", "sentence_id")


@query(f"""with {TREE}, n as (select *, row_number() over (partition by file_id, sentence_id order by word_id) - 1 as i, count(*) over (partition by file_id, sentence_id) as n, min(word_id) over (partition by file_id, sentence_id) as lo from e)
select word_id, case when i = 0 then -1 when i = 1 then lo else lo + (case when i = 2 then 1 else (i - 1) // 2 end) end as syntax_parent_id, case when i = 1 and n > 2 then 'Broken' when i = 2 then 'Yes' else 'No' end as cycle_status from n""")
def tree_cycles(spark, folder):
    """The first and the second word behind the root hang on each other: the heavier one is hung on the root."""
    w = R.Window.partitionBy("file_id", "sentence_id")
    e = _edges(spark, folder).withColumn("i", F.row_number().over(w.orderBy("word_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("lo", F.min("word_id").over(w))
    parent = F.when(F.col("i") == 0, F.lit(-1)).when((F.col("i") == 1) & (F.col("n") > 2), F.col("lo") + 2).when(F.col("i") == 2, F.col("lo") + 1).otherwise(F.col("lo") + F.floor((F.col("i") - 1) / 2))
    broken = e.withColumn("syntax_parent_id", parent.cast("long")).drop("i", "n", "lo")
    return syntax.repaired(broken).select("word_id", "syntax_parent_id", "cycle_status")


@query(f"""with {TREE}, o as (select * from e where parent <> -1)
select word_id, parent as other_id, 'parent' as kind, 1 as distance from o union all select parent, word_id, 'child', 1 from o
union all select a.word_id, b.word_id, 'sibling', 1 from o a join o b on a.file_id = b.file_id and a.sentence_id = b.sentence_id and a.parent = b.parent where a.word_id <> b.word_id""")
def syntactic_context(spark, folder):
    """Parents, children and siblings of each word."""
    return syntax.context(_edges(spark, folder)).select("word_id", "other_id", "kind", "distance")


@query(f"""with {T} select word_id, coalesce(length(word) > 9, false) as error, case when length(word) > 9 then 'long' end as algorithm, case when length(word) > 9 then 'shorter?' end as hint, case when length(word) > 9 then 'style' end as error_type from t""")
def checker_result(spark, folder):
    """The full result frame of a checker: every word, nulls where there is no error."""
    src = _src(spark, folder)
    found = src.where("length(word) > 9").select("file_id", "word_id", F.lit(True).alias("error"), F.lit("shorter?").alias("hint"))
    return checks.result(src, found, "long", "style").select("word_id", "error", "algorithm", "hint", "error_type")


@query(f"""with {T} select word_id, 'long' as algorithm from t where length(word) > 9 union all select word_id, 'capital' from t where substr(word, 1, 1) <> lower(substr(word, 1, 1))""")
def all_errors(spark, folder):
    """Every error of two checkers, by word."""
    src = _src(spark, folder)
    return checks.all_errors([("long", checks.result(src, src.where("length(word) > 9").withColumn("error", F.lit(True)), "long")), ("capital", src.where("lower(left(word, 1)) != left(word, 1)").withColumn("error", F.lit(True)))]).select("word_id", "algorithm")


HOUSE = f"""{T}, ru as (select file_id, word_id, lower(word) as w, normal_form as nf, pos from t left join m using (word_id) where word_type = 'ru' and word is not null),
 a as (select word_id from (select word_id, word_id - lag(word_id) over (partition by file_id, w order by word_id) as d from ru) where d <= 20),
 b as (select word_id from (select word_id, word_id - lag(word_id) over (partition by file_id, nf order by word_id) as d from ru where nf is not null) where d <= 20),
 spoken as (select word_id from m where coalesce(pos, 'NONE') not in ('PREP', 'CONJ', 'PRCL', 'NPRO')),
 rep as (select word_id from spoken where word_id in (select word_id from a union select word_id from b)),
 rare as (select word_id from (select t.word_id, count(*) over (partition by file_id, normal_form) as n from t join m using (word_id)) where n < 3),
 wrong as (select word_id from t where word_type = 'ru' and length(word) > 9 and word_id in (select word_id from rare))"""


@query(f"""with {HOUSE} select word_id, word_id in (select word_id from wrong) or word_id in (select word_id from rep) as error,
 case when word_id in (select word_id from wrong) then 'spelling' when word_id in (select word_id from rep) then 'repetitions' end as algorithm from t""")
def house_check(spark, folder):
    """Rare spelling errors, then repetitions."""
    src = _src(spark, folder)
    wrong = src.where("word_type = 'ru' and length(word) > 9").select("file_id", "word_id", F.lit(True).alias("error"))
    return checks.house_check(src, _forms(spark, folder), wrong).select("word_id", "error", "algorithm")


@query(f"""with {T}, x as (select word_id, case when word_type = 'ru' and word is not null then regexp_extract(lower(word), '(а|о|е|и)$') end as root, file_id from t), d as (select word_id, word_id - lag(word_id) over (partition by file_id, root order by word_id) as d, lag(word_id) over (partition by file_id, root order by word_id) as r from x where root <> '')
select word_id, r as reference, 'root' as how from d where d <= 3""")
def root_repetitions(spark, folder):
    """Repetitions of a root (here: of a last vowel), the third tier alone."""
    src = _src(spark, folder)
    roots = src.select("word_id", F.regexp_extract(F.lower("word"), "(а|о|е|и)$", 1).alias("morpheme")).where("morpheme != ''")
    return checks.repetitions(src, 3, roots=roots, simple=False).select("word_id", "reference", "how")


@query(f"""with {T}, w as (select file_id, sentence_id, word_id, lower(word) as word, lead(lower(word)) over (partition by file_id, sentence_id order by word_id) as nxt, lead(word_id) over (partition by file_id, sentence_id order by word_id) as nid from t where word is not null),
 x as (select word_id, 'tsa' as kind, word, word_id as last from w where regexp_matches(word, 'т(ь)?ся$')
  union all select word_id, 'chtoby', case when word = 'что' then 'что бы' else word end, case when word = 'что' then nid else word_id end from w where word = 'чтобы' or word = 'что' and nxt = 'бы'
  union all select word_id, 'ne', case when word = 'не' then 'не ' || nxt else word end, case when word = 'не' then nid else word_id end from w where word = 'не' and regexp_matches(nxt, '^[а-яё]') or word like 'не_%')
select word_id, kind, word, last, case when kind = 'tsa' then case when word like '%ться' then substr(word, 1, length(word) - 4) || 'тся' else substr(word, 1, length(word) - 3) || 'ться' end
 when word = 'чтобы' then 'что бы' when kind = 'chtoby' then 'чтобы' when contains(word, ' ') then replace(word, ' ', '') else 'не ' || substr(word, 3) end as other from x""")
def alternative_targets(spark, folder):
    """Words that may be written otherwise, of all three kinds, and how."""
    src, out = _src(spark, folder), None
    for kind in checks.TARGETS:
        own = checks.target_index(src, kind).select("word_id", F.lit(kind).alias("kind"), "word", "last", checks.other_writing(F.col("word"), kind).alias("other"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""with {T} select word_id, case when word like '%ая' then substr(word, 1, length(word) - 2) || 'ый' else substr(word, 1, length(word) - 2) || 'ая' end as suggestion from t where word_id % 3 = 0 and regexp_matches(word, '(ый|ая)$')""")
def alternative_doubts(spark, folder):
    """Words in -ый and -ая that a model (here: every third word) doubts, each with the other ending; all of them are swaps."""
    src = _src(spark, folder)
    model = lambda df: df.withColumn("p", F.when(F.col("word_id") % 3 == 0, 0.1).otherwise(0.9))
    bad = checks.alternative(src, "(ый|ая)$", model, ("ый", "ая")).join(src.select("word_id", "word"), "word_id")
    return checks.qualified(bad, "ый", "ая").select("word_id", F.col("suggest")[0].alias("suggestion"))


@query("""with d as (select distinct doc_id, text from documents where text is not null), x as (select text, length(text) > 400 as long, contains(text, '!') as loud from d)
select md5(text) as text, bool_or(long or loud) as error, case when bool_or(loud) then 'loud' else 'long' end as error_type, count(*) filter (long) + count(*) filter (loud) as suggestions from x group by text""")
def verdicts_by_text(spark, folder):
    """Verdicts of two checkers on texts, put together."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").distinct()
    own = lambda flag, kind: d.select("text", flag.alias("error"), F.when(flag, F.array(F.lit(kind))).alias("suggest"), F.when(flag | F.lit(kind == "long"), F.lit(kind)).alias("error_type"))
    merged = checks.merged_by_text([own(F.length("text") > 400, "long"), own(F.contains("text", F.lit("!")), "loud")])
    return merged.select(F.md5("text").alias("text"), "error", "error_type", F.size("suggest").cast("long").alias("suggestions"))


@query(f"""with {T}, d as (select distinct lower(ru_word) as w from glossary where ru_word is not null), x as (select t.*, w is not null as hit from t left join d on d.w = lower(t.word))
select word_id, hit as is_target from x qualify bool_or(hit) over (partition by file_id, sentence_id)""")
def dictionary_targets(spark, folder):
    """Sentences with a word of a dictionary."""
    return sampling.in_dictionary(table(spark, folder, "glossary", "ru_word"), "ru_word")(_src(spark, folder)).select("word_id", "is_target")


@query(f"""with {T}, b as (select sentence_id, count(*) as n from t where sentence_id is not null group by sentence_id), c as (select *, cast(floor(log2(n)) as int) as k from b),
 p as (select sentence_id from c qualify row_number() over (partition by k order by md5('0:' || sentence_id), sentence_id) <= 20),
 x as (select *, coalesce(regexp_matches(word, '[аи]ла?$'), false) as hit from t where sentence_id in (select sentence_id from p)),
 s as (select * from x qualify bool_or(hit) over (partition by file_id, sentence_id)), k as (select sentence_id, count(*) filter (hit) as hits, count(*) as words from s group by sentence_id)
select 0 as label, count(*) as sentences, cast(sum(words) as bigint) as words, cast(sum(hits) as bigint) as samples from k union all select 1, count(*), cast(sum(hits * words) as bigint), cast(sum(hits) as bigint) from k""")
def training_bundle(spark, folder):
    """A training set from start to end: balanced, filtered, with its negatives and index."""
    src = _src(spark, folder).where("sentence_id is not null").withColumn("corpus_id", F.lit("c"))
    target = lambda t: sampling.with_target(t, F.col("word").rlike("[аи]ла?$"))
    negative = lambda t: sampling.swap_endings(sampling.variants(t), "ла", "л")
    b = sampling.training_bundle(src, target, negative, most=20)
    words = b["src"].groupBy("label").agg(F.count_distinct("sentence_id").alias("sentences"), F.count(F.lit(1)).alias("words"))
    return words.join(b["index"].groupBy("label").agg(F.count(F.lit(1)).alias("samples")), "label")


PAIRS = "w as (select distinct lower(word) as word from src where word_type = 'ru' and length(word) > 6 and lower(word) not in ('чтобы', 'новый', 'старый'))"


def _paired(spark, folder):
    w = table(spark, folder, "src", "word", "word_type").where("word_type = 'ru' and length(word) > 6").select(F.lower("word").alias("word")).distinct().where("word not in ('чтобы', 'новый', 'старый')")
    return w.withColumn("text", F.concat(F.lit("новый "), "word", F.lit(" чтобы.")))


@query(f"with {PAIRS} select word, unnest([0, 1]) as variant_no, unnest(['старый ' || word || ' чтобы.', 'новый ' || word || ' что бы.']) as text from w")
def rewritten_words(spark, folder):
    """Sentences with one place rewritten."""
    return sampling.rewritten(_paired(spark, folder), "text", [("чтобы", "что бы"), ("новый", "старый")])


@query(f"with {PAIRS} select word, unnest([0, 1, 2]) as variant_no, unnest(['новый ' || word || ' что бы.', 'старый ' || word || ' что бы.', 'старый ' || word || ' чтобы.']) as text from w")
def word_combinations(spark, folder):
    """Sentences with every combination of alternatives."""
    return sampling.combinations(_paired(spark, folder), "text", [["чтобы", "что бы"], ["новый", "старый"]])


@query(f"""with recursive {T}, s as (select file_id, sentence_id, count(*) as n, min(word_id) as a, max(word_id) as z, sentence_id % 3 = 0 as d from t where sentence_id is not null group by all),
 l as (select *, row_number() over (partition by file_id, d order by sentence_id) as i from s),
 g as (select file_id, d, i, n, n as held, 0 as fragment, a, z from l where i = 1 union all
  select l.file_id, l.d, l.i, l.n, case when g.held + l.n > 60 then l.n else g.held + l.n end, case when g.held + l.n > 60 then g.fragment + 1 else g.fragment end, l.a, l.z from g join l on l.file_id = g.file_id and l.d = g.d and l.i = g.i + 1)
select file_id, case when d then 'dialog' else 'narrative' end as text_type, fragment, min(a) as start_id, max(z) as end_id, count(*) as sentences from g group by all""")
def fragments(spark, folder):
    """Runs of sentences of one kind, closed before 60 words are passed."""
    t = _src(spark, folder).where("sentence_id is not null")
    s = t.groupBy("file_id", "sentence_id").agg(F.count(F.lit(1)).alias("tokens"), F.min("word_id").alias("start_id"), F.max("word_id").alias("end_id")).withColumn("is_dialog", F.col("sentence_id") % 3 == 0).withColumn("text", F.lit("x"))
    return alignment.fragments(s, "file_id", 60).withColumn("sentences", ((F.length("text") + 1) / 2).cast("long")).drop("text")


@query("""with c as (select chapter_id, min(retell) as retell, book_id % 3 as f from chapter_info where retell is not null and book_id is not null group by chapter_id, book_id % 3),
 o as (select *, row_number() over (order by chapter_id, f) as n from c), i as (select *, n - row_number() over (partition by f order by n) as k from o), r as (select *, dense_rank() over (partition by f order by k) - 1 as run from i)
select 'f' || f as file_id, run, count(*) as texts, cast(sum(n) as bigint) as ordinals from r group by all""")
def retell_runs(spark, folder):
    """Retellings of consecutive chapters of one file put together."""
    c = table(spark, folder, "chapter_info", "chapter_id", "book_id", "retell").where("retell is not null and book_id is not null").groupBy("chapter_id", (F.col("book_id") % 3).alias("f")).agg(F.min("retell").alias("retell"))
    o = R.numbered(c, ["chapter_id", "f"], "n").withColumn("ordinal", F.col("n") + 1).withColumn("id", F.col("ordinal"))
    marked = o.select("id", F.concat(F.lit("1) "), F.col("ordinal").cast("string")).alias("response"))
    runs = alignment.retells(o.select("id", "ordinal", F.concat(F.lit("f"), F.col("f").cast("string")).alias("file_id")), marked)
    parts = F.split("text", "\n")
    return runs.select("file_id", "run", F.size(parts).cast("long").alias("texts"), F.aggregate(F.transform(parts, lambda x: F.regexp_replace(x, "[.]", "").cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("ordinals"))


@query(f"""with {T}, s as (select sentence_id, string_agg(word, ' ' order by word_id) as text from t where sentence_id is not null group by sentence_id)
select sentence_id, regexp_replace(text, '\\s+([.,!?;:…»)])', '\\1', 'g') as text from s where text is not null""")
def readable_sentences(spark, folder):
    """Sentences without the blanks that joining leaves before punctuation."""
    t = _src(spark, folder).where("sentence_id is not null and word is not null")
    s = R.joined_text(t, ["sentence_id"], "word_id", F.concat(F.lit(" "), "word"), "text")
    return s.select("sentence_id", alignment.readable(F.substr("text", F.lit(2))).alias("text"))


@query("""with b as (select distinct book_id, lang, name from book where book_id is not null and lang is not null and name is not null),
 r as (select *, row_number() over (partition by lang order by book_id) - 1 as place from b where lang in ('ru', 'en')), h as (select *, 'h' || place // 4 as head from r),
 a as (select head, place, book_id, row_number() over (partition by head order by book_id) as k from h where lang = 'ru'), e as (select head, place, book_id, row_number() over (partition by head order by book_id) as k from h where lang = 'en')
select a.head as header, a.k - 1 as place, a.book_id as a_book_id, e.book_id as b_book_id from a join e using (head, k)""")
def chapters_by_header(spark, folder):
    """Chapters of two editions paired behind equal headers."""
    b = table(spark, folder, "book", "book_id", "lang", "name").where("book_id is not null and name is not null and lang in ('ru', 'en')").distinct()
    r = R.ordering(b, ["lang"], ["book_id"], "p").withColumn("header", F.when(F.col("p") % 4 == 0, F.concat(F.lit("  H"), F.expr("p div 4")))).withColumn("all", F.lit(0))
    own = lambda g: r.where(F.col("lang") == g).select("all", "book_id", "header")
    return alignment.by_header(own("ru"), own("en"), "all", "header", "book_id").select("header", "place", "a_book_id", "b_book_id")


@query("""with b as (select distinct book_id, name from book where book_id is not null and name is not null), p as (select name, book_id, row_number() over (partition by name order by book_id) as k from b),
 c as (select distinct chapter_id, book_name from chapter_info where book_name is not null and chapter_id is not null), q as (select book_name as name, chapter_id, row_number() over (partition by book_name order by chapter_id) as k from c)
select p.name, p.k - 1 as place, book_id, chapter_id from p join q using (name, k)""")
def zipped_chapters(spark, folder):
    """Rows of two lists paired by place."""
    a = table(spark, folder, "book", "book_id", "name").where("book_id is not null and name is not null").distinct().withColumnRenamed("book_id", "o")
    b = table(spark, folder, "chapter_info", "chapter_id", "book_name").where("book_name is not null and chapter_id is not null").distinct().select(F.col("book_name").alias("name"), F.col("chapter_id").alias("o"))
    return alignment.zipped(a, b, "name", "o").select("name", "place", F.col("a_o").alias("book_id"), F.col("b_o").alias("chapter_id"))


@query("""with v as (select lower(ru_word) as term, cast(length(ru_word) as double) as x, cast(ascii(ru_word) % 7 as double) as y from glossary where ru_word is not null group by all), u as (select term, min(x) as x, min(y) as y from v group by term),
 k as (select term from u union select term || '-' || term from u where length(term) > 5 union select 'нет-слова'), p as (select k.term, unnest(string_split(k.term, '-')) as part from k where contains(k.term, '-')), s as (select p.term, sum(x) as x, sum(y) as y from (select distinct * from p) p join u on u.term = p.part group by p.term)
select k.term as word, coalesce(u.x, s.x, 0) as x, coalesce(u.y, s.y, 0) as y from k left join u using (term) left join s using (term)""")
def word_vectors(spark, folder):
    """Vectors of words from a vocabulary; of hyphenated ones the sum of their parts' (each once); zeros if unknown."""
    g = table(spark, folder, "glossary", "ru_word").where("ru_word is not null").select(F.lower("ru_word").alias("term"), F.length("ru_word").cast("double").alias("x"), (F.expr("ascii(ru_word)") % 7).cast("double").alias("y"))
    u = g.groupBy("term").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    k = u.select("term").union(u.where("length(term) > 5").select(F.concat_ws("-", "term", "term"))).union(spark.createDataFrame([("нет-слова",)], "term string")).distinct()
    out = alignment.vocab_vector(k.withColumnRenamed("term", "word"), u.select("term", F.array("x", "y").alias("vec")), 2)
    return out.select("word", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


@query("""with q as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null and label is not null), e as (select label, vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from q), m as (select label, i, avg(x) as m from e group by all),
 s as (select label, vec_id, sum(x * m) / sqrt(sum(x * x) * sum(m * m)) as score from e join m using (label, i) group by all)
select label, vec_id as sentence_id, round(score, 6) as score from s qualify row_number() over (partition by label order by score desc, vec_id) <= 2""")
def vector_summary(spark, folder):
    """The two vectors of each label that are nearest to its mean."""
    v = table(spark, folder, "embeddings", "vec_id", "label", "embedding").where("embedding is not null and label is not null")
    return alignment.vector_summary(v.select("label", F.col("vec_id").alias("sentence_id"), F.col("embedding").alias("vec")), "label", 2).withColumn("score", F.round("score", 6))


@query(f"""with {T}, x as (select file_id, sentence_id, word_id, word_type, lead(word) over (partition by file_id, sentence_id order by word_id) as nxt from t where sentence_id is not null),
 i as (select word_id, word_id as sample_id, file_id, sentence_id, coalesce(word_type <> 'punct' and nxt in (',', '.'), false) as hit from x), l as (select file_id, sentence_id, min(word_id) as lo, max(word_id) as hi from t where sentence_id is not null group by all),
 c as (select sample_id, unnest(range(greatest(-2, lo - word_id), least(2, hi - word_id) + 1)) as off, word_id, hit from i join l using (file_id, sentence_id))
select sample_id, cast(off as int) as "offset", word_id + off as another_word_id from c where off <> case when hit then 1 else 2 end""")
def sign_contexts(spark, folder):
    """Contexts that hide the sign to be guessed."""
    t = _src(spark, folder).where("sentence_id is not null")
    i = t.withColumn("is_target", sampling.next_sign([",", "."])).select(F.col("word_id").alias("sample_id"), "word_id", "sentence_id", "file_id", "is_target")
    return context.sign_contexts(i, t, 4)


@query(f"""with {T}, x as (select word_id, word_length % 5 as "," , word_length % 3 as "." , word_length % 2 as "no", case when word = ',' then ',' when word = '.' then '.' else 'no' end as actual from t where word_length is not null)
select word_id, case when "," >= "." and "," >= "no" then ',' when "." >= "no" then '.' else 'no' end as best, case when "," >= "." and "," >= "no" then ',' when "." >= "no" then '.' else 'no' end = actual as correct from x""")
def best_signs(spark, folder):
    """The sign that a model (here: the word's length) likes best, beside the true one."""
    t = _src(spark, folder).where("word_length is not null")
    n = F.col("word_length")
    scored = t.select("word_id", (n % 5).alias(","), (n % 3).alias("."), (n % 2).alias("no"), F.when(F.col("word").isin(",", "."), F.col("word")).otherwise("no").alias("actual"))
    return context.best_symbol(scored, [",", ".", "no"], "actual").select("word_id", "best", "correct")


@query(f"with {T} select word_id, '-' as word from t where word in ('–', '—', '−', '―')")
def plain_dashes(spark, folder):
    t = _src(spark, folder)
    return t.where("word is not null").select("word_id", "word", sampling.plain_dash(F.col("word")).alias("p")).where("p != word").select("word_id", F.col("p").alias("word"))


@query(f"""with {T}, x as (select word_id, word, case when right(word, 2) in ('ый', 'ая', 'ое') then right(word, 2) end as ending, length(word) % 3 as k from t where word is not null), b as (select *, ['ый', 'ая', 'ое'][k + 1] as best from x where ending is not null)
select word_id, best, substr(word, 1, length(word) - 2) || best as suggestion from b where best <> ending""")
def agreement_errors(spark, folder):
    """Words whose ending a model (here: by the word's length) would rather have otherwise."""
    ends = ["ый", "ая", "ое"]
    t = _src(spark, folder).where(F.expr("right(word, 2)").isin(ends)).select("word_id", "word", F.expr("right(word, 2)").alias("ending"), *[(F.length("word") % 3 == k).cast("int").alias(e) for k, e in enumerate(ends)])
    return research.agreement_errors(t, ends).select("word_id", "best", F.col("suggest")[0].alias("suggestion"))


@query(f"with {T} select word_id, word_length % 4 as declension, case word_length % 4 when 0 then 'a' when 1 then 'b' end as mask from t where word_length is not null")
def masked_index(spark, folder):
    """An index with the mask of each row's class."""
    masks = spark.createDataFrame([(0, "a"), (1, "b")], "declension int, mask string")
    return research.masked(_src(spark, folder).where("word_length is not null").select("word_id", (F.col("word_length") % 4).alias("declension")), masks)


ANTE = f"""{T}, e as (select t.file_id, t.word_id, pos, gender, case when word_index = 0 then -1 else t.word_id - word_index + (word_index - 1) // 2 end as parent from t left join m using (word_id) where sentence_id is not null and word_index is not null),
 n as (select * from e where pos = 'NOUN' and gender is not null), p as (select * from e where pos = 'VERB' and gender is not null),
 c as (select p.file_id, p.word_id, n.word_id as candidate_id, row_number() over (partition by p.word_id order by n.word_id desc) as place from p join n on n.file_id = p.file_id and n.gender = p.gender and n.word_id < p.word_id)"""


def _candidates(spark, folder, k):
    """Nouns before each verb that shows a gender; the tables' pronouns show none."""
    e = _edges(spark, folder).join(_forms(spark, folder).select("word_id", "pos", "gender"), "word_id", "left")
    nouns, pronouns = e.where("pos = 'NOUN' and gender is not null"), e.where("pos = 'VERB' and gender is not null")
    return e, research.antecedents(nouns, pronouns, k)


@query(f"""with {ANTE} select c.word_id, candidate_id, cast(place as int) as place from c join e a on a.word_id = c.word_id join e b on b.word_id = c.candidate_id where place <= 4 and (a.parent = -1 or b.parent = -1 or a.parent <> b.parent)""")
def antecedents_no_siblings(spark, folder):
    """Candidates for pronouns that don't hang on the same word."""
    e, c = _candidates(spark, folder, 4)
    return research.without_siblings(c, e).drop("file_id")


@query(f"""with {ANTE}, s as (select word_id, candidate_id, exp(1.0 / place) as x from c where place <= 4), h as (select *, x / sum(x) over (partition by word_id) as share from s), r as (select *, row_number() over (partition by word_id order by share desc, candidate_id desc) as n from h)
select word_id, max(case when n = 1 then candidate_id end) as candidate_id, coalesce(max(case when n = 1 then share end) - max(case when n = 2 then share end) > stddev_samp(share), false) as accepted from r group by word_id""")
def accepted_antecedents(spark, folder):
    """The best candidate of each pronoun, and whether it stands out."""
    _, c = _candidates(spark, folder, 4)
    return research.accepted(c.withColumn("score", 1.0 / F.col("place"))).select("word_id", "candidate_id", "accepted")


@query(f"""with {ANTE}, k as (select word_id, bool_or(candidate_id % 2 = 0) as hit from c where place <= 4 group by word_id) select count(*) as n, count(*) filter (hit) as found from k""")
def antecedent_recall(spark, folder):
    """How many pronouns have a right noun (here: one of even id) among their candidates."""
    _, c = _candidates(spark, folder, 4)
    return research.candidate_recall(c.withColumn("match", F.col("candidate_id") % 2 == 0), "match")


@query(f"""with {ANTE}, k as (select word_id, candidate_id, candidate_id % 2 = 0 as hit from c where place <= 4) select a.word_id, a.candidate_id as good, b.candidate_id as bad from k a join k b on a.word_id = b.word_id where a.hit and not b.hit""")
def contrast_pairs(spark, folder):
    """Each right candidate beside each wrong one of the same word."""
    _, c = _candidates(spark, folder, 4)
    return research.contrast_pairs(c.withColumn("match", F.col("candidate_id") % 2 == 0), "word_id", "match", "candidate_id")


MATRIX = f"""{T}, w as (select file_id, word_type, row_number() over (partition by file_id order by word_id) as i from t where word_type is not null),
 p as (select least(a.word_type, b.word_type) as a, greatest(a.word_type, b.word_type) as b, count(*) as n from w a join w b on a.file_id = b.file_id and b.i between a.i - 3 and a.i - 1 group by all)"""


def _matrix(spark, folder):
    return research.cooccurrence(_src(spark, folder).where("word_type is not null").select("file_id", "word_id", F.col("word_type").alias("word")), 3)


@query(f"with {MATRIX}, f as (select a, b, n from p union all select b, a, n from p where a <> b) select a, b, n, round(n / sum(n) over (partition by a), 6) as share from f")
def matrix_rows(spark, folder):
    """Co-occurrence of word types as shares of each row."""
    return research.normalised(_matrix(spark, folder)).withColumn("share", F.round("share", 6))


@query(f"with {MATRIX} select a, b, cast(2 * n as bigint) as n from p where a not in ('unk') and b not in ('unk')")
def matrix_sum(spark, folder):
    """Two matrices added up, without the rows and columns of a list."""
    m = _matrix(spark, folder)
    return research.masked_matrix(research.merged_matrices(m, m), spark.createDataFrame([("unk",)], "word string"))


@query(f"""with {T}, v as (select unnest(['и', 'в', 'the']) as term, unnest([1, 2, 3]) as vector_id), u as (select distinct vector_id from v join t on t.word in (term, upper(term)) or lower(t.word) = term where word_type = 'ru') select vector_id, 'v' || vector_id as vec from u""")
def vectors_used(spark, folder):
    """The vectors that some word has."""
    v = spark.createDataFrame([("и", 1), ("в", 2), ("the", 3)], "term string, vector_id int")
    keys = features.vector_keys(_src(spark, folder), _forms(spark, folder).withColumn("normal_form", F.lit(None).cast("string")), v)
    return features.vectors_used(keys, v.select("vector_id", F.concat(F.lit("v"), F.col("vector_id").cast("string")).alias("vec")))


@query(f"""with {T} select word_id, word_length % 2 = 0 as even, word_length > 5 as long from t where word_length is not null""")
def featurizer_chain(spark, folder):
    """Featurizers one after another over a bundle of frames."""
    own = lambda name, f: features.simple(name, lambda b: b["src"].select("file_id", "word_id", f.alias(name)))
    bundle = {"src": _src(spark, folder).where("word_length is not null")}
    for step in (own("even", F.col("word_length") % 2 == 0), own("long", F.col("word_length") > 5)):
        bundle |= step.frames(bundle)
    return bundle["even"].join(bundle["long"], ["file_id", "word_id"]).drop("file_id")


@query(f"""with {T}, p as (select file_id, paragraph_id, bool_or(word_id % 500 = 0) as touched from t where paragraph_id is not null group by all)
select word_id, case when touched then 'new' else 'old' end as kind from t join p using (file_id, paragraph_id)""")
def incremental_features(spark, folder):
    """Features after an edit: paragraphs with a changed word are computed anew."""
    src = _src(spark, folder).where("paragraph_id is not null").withColumn("updated", F.col("word_id") % 500 == 0).withColumn("original_word_id", F.lit(None).cast("long"))
    own = lambda kind: lambda s: s.select("file_id", "word_id", F.lit(kind).alias("kind"))
    return features.incremental(src, own("old")(src), own("new")).drop("file_id")


@query(f"""with {T} select file_id, count(*) as n, cast(sum(word_length) as bigint) as word_length_sum, min(word_length) as word_length_min, max(word_length) as word_length_max, round(avg(word_length), 6) as word_length_mean, count(*) filter (word_type = 'punct') as mark_n from t group by file_id""")
def one_pass_features(spark, folder):
    """Statistics of every file in one pass."""
    t = _src(spark, folder).withColumn("mark", F.col("word_type") == "punct")
    return features.one_pass(t, "file_id", ["word_length"], ["mark"]).withColumn("word_length_mean", F.round("word_length_mean", 6))


@query(f"""with {T}, x as (select word_id, coalesce(word_length, 0) + lag(coalesce(word_length, 0)) over w + lag(coalesce(word_length, 0), 2) over w as total from t window w as (partition by file_id order by word_id)) select * from x where total is not null""")
def buffered_features(spark, folder):
    """Each word with a buffer of the two before it."""
    e = features.expanded(_src(spark, folder), "file_id", "word_id", "word_length", 2)
    return e.select("word_id", F.aggregate("values", F.lit(0), lambda a, x: a + x).alias("total"))


@query("""with d as (select doc_id, n_chars from documents group by all) select count(*) as rows, count(distinct doc_id) as ids, cast(ceil(count(*) / 64.0) as bigint) as batches, 64 as largest from d""")
def priority_batches(spark, folder):
    """Batches of 64 drawn by priority: how many there are, and that the first ones are full."""
    d = table(spark, folder, "documents", "doc_id", "n_chars").distinct()
    b = sampling.weighted_batches(d, "doc_id", "n_chars", 64)
    sizes = b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    one = lambda x: x.withColumn("k", F.lit(1))
    n = b.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids"))
    return one(n).join(one(sizes.agg(F.count(F.lit(1)).alias("batches"), F.max("n").cast("int").alias("largest"))), "k").drop("k")


@query("""with d as (select distinct doc_id, coalesce(kind, '?') as kind from documents), f as (select *, cast(('0x' || substr(md5('0:' || doc_id), 1, 6))::bigint % 4 as int) as fold from d), n as (select 'fold ' || fold as split, kind, count(*) as n from f group by all)
select split, kind, n, round(n / sum(n) over (partition by split), 6) as share from n""")
def fold_composition(spark, folder):
    """What the folds of the documents are made of."""
    d = table(spark, folder, "documents", "doc_id", "kind").distinct().withColumn("kind", F.coalesce("kind", F.lit("?"))).distinct()
    f = sampling.folds(d, "doc_id", 4).withColumn("split", F.concat(F.lit("fold "), F.col("fold").cast("string")))
    return sampling.split_composition(f, "kind").withColumn("share", F.round("share", 6))


@query("""with b as (select 'c' || (n_chars % 5) as bucket, doc_id from documents where n_chars is not null group by all), a as (select * from b where doc_id % 2 = 0), c as (select * from b where doc_id % 2 = 1) select bucket, list(doc_id order by doc_id) as sentences from (select * from a union all select * from c) group by bucket""")
def merged_buckets(spark, folder):
    """Buckets of two collections put together."""
    d = table(spark, folder, "documents", "doc_id", "n_chars").where("n_chars is not null").distinct()
    own = lambda k: d.where(F.col("doc_id") % 2 == k).groupBy(F.concat(F.lit("c"), (F.col("n_chars") % 5).cast("string")).alias("bucket")).agg(F.sort_array(F.collect_list("doc_id")).alias("sentences"))
    return sampling.merged_buckets(own(0), own(1))


@query(f"""with {T}, p as (select file_id, paragraph_id, string_agg(case when word_type = 'punct' then '<span style="background-color:red;">' || e || '</span>' else e end || repeat(' ', word_tail), '' order by word_id) as x
 from (select *, replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as e from t where word is not null and paragraph_id is not null and word_tail is not null) group by all),
 h as (select file_id, string_agg('<p>' || x || '</p>', chr(10) order by paragraph_id) as html from p group by file_id) select file_id, md5(html) as digest from h""")
def highlighted(spark, folder):
    """Texts as HTML with punctuation coloured."""
    t = _src(spark, folder).where("word is not null and paragraph_id is not null and word_tail is not null")
    return TK.to_html(t, "file_id", "word_type", {"punct": "red"}).select("file_id", F.md5("html").alias("digest"))


@query("""with d as (select distinct doc_id, n_chars from documents where n_chars is not null) select doc_id, '#ff' || lpad(lower(hex(cast(round(255 * (1 - least(1.0, n_chars / 2000.0))) as int))), 2, '0') || lpad(lower(hex(cast(round(255 * (1 - least(1.0, n_chars / 2000.0))) as int))), 2, '0') as color from d""")
def length_colours(spark, folder):
    """A colour by where a number lies between two others."""
    d = table(spark, folder, "documents", "doc_id", "n_chars").where("n_chars is not null").distinct()
    return d.select("doc_id", TK.gradient(F.col("n_chars"), F.lit(0.0), F.lit(2000.0)).alias("color"))


@query(f"""with {TREE}, x as (select e.file_id, e.sentence_id, e.word_id, e.parent, replace(t.word, '"', '''') as w from e join t on t.word_id = e.word_id where t.word is not null),
 l as (select file_id, sentence_id, string_agg('n' || word_id || ' [label="' || w || '"];' || case when parent >= 0 then ' n' || parent || ' -> n' || word_id || ';' else '' end, chr(10) order by word_id) as s from x group by all)
select sentence_id, md5('digraph {{' || chr(10) || s || chr(10) || '}}') as digest from l""")
def tree_graphs(spark, folder):
    """Trees as the text of graphs."""
    e = _edges(spark, folder).join(_src(spark, folder).select("word_id", "word").where("word is not null"), "word_id")
    keyed = e.withColumn("k", F.struct("file_id", "sentence_id"))
    return TK.tree_dot(keyed, "k", "word_id", "syntax_parent_id", "word").select("k.sentence_id", F.md5("dot").alias("digest"))
