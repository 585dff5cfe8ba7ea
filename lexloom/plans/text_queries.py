"""Queries over whole texts: parsing, ids, packing, alignment, retellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alignment, context, features
from ..operators import relational as R
from ..operators import tokens as TK
from ..session import cut, spread, table
from ..sources import formats
from .registry import query

RU = X.TOKEN["ru"]
#: The tokenizer in SQL: p (paragraphs), s (sentences), w (tokens) of {table}.{text} by {key}.
SPLIT = """
p as (select {key} as k, unnest(range(len(string_split({text}, chr(10))))) as par, unnest(string_split({text}, chr(10))) as line from {table}),
s0 as (select k, par, unnest(list_filter(string_split(regexp_replace(line, '([.!?…]+["”»)]*\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) as sent,
   generate_subscripts(list_filter(string_split(regexp_replace(line, '([.!?…]+["”»)]*\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), 1) as sno from p),
s as (select k, par, sent, row_number() over (partition by k order by par, sno) - 1 as sentence_id from s0),
w0 as (select k, par, sentence_id, unnest(regexp_extract_all(sent, '{pattern}')) as word, generate_subscripts(regexp_extract_all(sent, '{pattern}'), 1) - 1 as word_index from s),
w as (select k, par, sentence_id, word_index, word, row_number() over (partition by k order by sentence_id, word_index) - 1 as word_id,
   case when regexp_matches(word, '^[\\p{{P}}\\p{{S}}]+$') then 'punct' when regexp_matches(word, '{ru}') then 'ru' else 'unk' end as word_type from w0)
"""


def split_sql(source: str, key: str, text: str) -> str:
    return SPLIT.format(table=source, key=key, text=text, pattern=RU.replace("'", "''"), ru=X.RU_WORD)


DOCS = split_sql("documents", "doc_id", "text")


def _document_tokens(spark, folder):
    return TK.tokenize(table(spark, folder, "documents", "doc_id", "text"), "text", ["doc_id"])


@query(f"""with {DOCS}
select k as doc_id, count(*) as token_count, sum(length(word)) as character_count, count(distinct sentence_id) as sentence_count,
 count(distinct par) as paragraph_count, greatest(max(word_id), max(sentence_id), max(par)) + 2 as max_id from w group by k""")
def doc_token_stats(spark, folder):
    return TK.record_stats(_document_tokens(spark, folder), "doc_id")


@query(f"with {DOCS} select word_type, count(*) as n, count(distinct word) as words, max(length(word)) as longest from w group by word_type")
def tokens_by_type(spark, folder):
    t = _document_tokens(spark, folder)
    return t.groupBy("word_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("words"), F.max("word_length").alias("longest"))


@query("""with t as (select distinct file_id, word_id, paragraph_id, word, word_tail from src),
x as (select file_id, word_id, case when lag(paragraph_id) over (partition by file_id order by word_id) <> paragraph_id then chr(10) else '' end || word || repeat(' ', word_tail) as piece from t)
select file_id, length(string_agg(piece, '' order by word_id)) as size, md5(string_agg(piece, '' order by word_id)) as digest from x group by file_id""")
def text_roundtrip(spark, folder):
    src = TK.clean(table(spark, folder, "src", "file_id", "word_id", "paragraph_id", "word", "word_tail"))
    return TK.to_text(src, "file_id").select("file_id", F.length("text").alias("size"), F.md5("text").alias("digest"))


@query("""with t as (select distinct file_id, word_id, sentence_id, word, word_tail from src where sentence_id is not null)
select file_id, sentence_id, rtrim(string_agg(word || repeat(' ', word_tail), '' order by word_id)) as text from t group by file_id, sentence_id""")
def sentence_strings(spark, folder):
    src = TK.clean(table(spark, folder, "src", "file_id", "word_id", "sentence_id", "word", "word_tail")).where("sentence_id is not null")
    return TK.sentence_strings(src, ["file_id", "sentence_id"])


@query("""with t as (select distinct file_id, word_id, sentence_id, paragraph_id from src),
r as (select file_id, word_id as old, dense_rank() over (partition by file_id order by word_id) + 49 as word_id,
 case when sentence_id is not null then dense_rank() over (partition by file_id order by sentence_id nulls first) + 49 end as sentence_id,
 dense_rank() over (partition by file_id order by paragraph_id) + 49 as paragraph_id from t)
select old as original_word_id, word_id, sentence_id, paragraph_id from r""")
def token_id_reindex(spark, folder):
    src = TK.clean(table(spark, folder, "src", "file_id", "word_id", "sentence_id", "paragraph_id"))
    return TK.reset_ids(src, "file_id", 50).select("original_word_id", "word_id", "sentence_id", "paragraph_id")


@query("""with t as (select distinct file_id, word_id, sentence_id, paragraph_id from src), f as (select file_id, count(*) as tokens, count(distinct sentence_id) as sentences, count(distinct paragraph_id) as paragraphs from t group by file_id)
select file_id, tokens, tokens as ids, tokens - 1 as span, sentences, paragraphs, true as apart from f""")
def token_global_ids(spark, folder):
    """Fresh ids over all files, by file: unique everywhere, dense inside a file, and no file's ids reach into another's."""
    src = TK.clean(table(spark, folder, "src", "file_id", "word_id", "sentence_id", "paragraph_id"))
    ids = TK.global_ids(TK.reset_ids(src, "file_id", originals=False), "file_id")
    n = ids.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.count_distinct("word_id").alias("ids"), (F.max("word_id") - F.min("word_id")).alias("span"), F.count_distinct("sentence_id").alias("sentences"), F.count_distinct("paragraph_id").alias("paragraphs"),
        F.min("word_id").alias("lo"), F.greatest(F.max("word_id"), F.max("sentence_id"), F.max("paragraph_id")).alias("hi"),
    )
    # A row per file.
    before = F.max("hi").over(R.Window.partitionBy(F.lit(0)).orderBy("lo").rowsBetween(R.Window.unboundedPreceding, -1))
    return n.withColumn("apart", F.coalesce(F.col("lo") > before, F.lit(True))).drop("lo", "hi")


@query("""with t as (select distinct word_id, word, word_length from src), x as (
 select 'null word' as problem, word is null as bad from t union all select 'null word_length', word_length is null from t union all select 'null word_id', word_id is null from t
 union all select 'word_id comes twice', count(*) > 1 from t group by word_id)
select problem, count(*) as rows from x where bad group by problem""")
def token_problems(spark, folder):
    return TK.invalid_ids(table(spark, folder, "src", "word_id", "word", "word_length").distinct())


@query("""with recursive t as (select distinct file_id, word_id, sentence_id from src where sentence_id is not null),
l as (select file_id, sentence_id, count(*) as len, row_number() over (partition by file_id order by sentence_id) as n from t group by file_id, sentence_id),
f as (select file_id, sentence_id, n, len as words, 0 as frame from l where n = 1
 union all select l.file_id, l.sentence_id, l.n, case when f.words + l.len >= 200 then l.len else f.words + l.len end, case when f.words + l.len >= 200 then f.frame + 1 else f.frame end
 from f join l on l.file_id = f.file_id and l.n = f.n + 1)
select file_id, sentence_id, frame from f""")
def greedy_frames(spark, folder):
    return TK.packed(TK.clean(table(spark, folder, "src", "file_id", "word_id", "sentence_id")), "file_id", 200)


@query("""with t as (select distinct file_id, word_id, sentence_id, paragraph_id, word_length from src), f as (select distinct file_id, filename from toc),
s as (select file_id, count(*) as token_count, sum(word_length) as character_count, greatest(max(word_id), max(sentence_id), max(paragraph_id)) + 2 as max_id, min(word_id) as first_id from t group by file_id)
select file_id, filename, token_count, character_count, max_id, cast(row_number() over (partition by filename order by first_id, file_id) - 1 as int) as part_index from s join f using (file_id)""")
def toc_stats(spark, folder):
    from ..sources.corpus import toc_of

    src = TK.clean(table(spark, folder, "src", "file_id", "word_id", "sentence_id", "paragraph_id", "word_length"))
    named = src.join(table(spark, folder, "toc", "file_id", "filename").distinct(), "file_id")
    return toc_of(named).drop("written_at")


@query("""with t as (select distinct file_1, file_2, relation_name from relation)
select file_1, file_2, relation_name from t where file_1 <> file_2 union select file_2, file_1, relation_name from t where file_1 <> file_2""")
def both_directions(spark, folder):
    return alignment.reversed_edges(table(spark, folder, "relation"))


@query("""with e as (select file_1, relation_name, min(file_2) as file_id from (select distinct * from relation) group by file_1, relation_name),
t as (select distinct file_id, word_id from src)
select file_1, relation_name, e.file_id, count(*) as tokens from e join t on t.file_id = e.file_id group by all""")
def related_src(spark, folder):
    """Tokens of the first related file of each file and relation name."""
    e = table(spark, folder, "relation", "file_1", "file_2", "relation_name").groupBy("file_1", "relation_name").agg(F.min("file_2").alias("file_id"))
    n = TK.clean(table(spark, folder, "src", "file_id", "word_id")).groupBy("file_id").agg(F.count(F.lit(1)).alias("tokens"))
    return e.join(n, "file_id").select("file_1", "relation_name", "file_id", "tokens")


BOOKS = split_sql("(select distinct file_id, content from book)", "file_id", "content")


@query(f"""with {BOOKS},
a as (select *, row_number() over (partition by k, par order by word_id) = 1 as first, lead(word) over (partition by k, par order by word_id) as nxt from w),
b as (select *, first or (word_type = 'punct' and word not in ('»','"',')','–','“','”','(','«','—','-') and coalesce(nxt in ('—','–','-'), false)) as border,
 max(case when first then word in ('—','–','-') end) over (partition by k, par) as dlg from a),
c as (select *, sum(border::int) over (partition by k, par order by word_id) - 1 as no, lag(border) over (partition by k, par order by word_id) and not lag(first) over (partition by k, par order by word_id) as after_border from b)
select k as file_id, word_id, case when not dlg then 'no' when border or coalesce(after_border, false) then case when word in ('—','–','-') then 'dialog-dash' else 'dialog-symbol' end
 when no % 2 = 0 then 'speech' else 'action' end as dialog_type, dlg as is_dialog from c""")
def dialog_markup(spark, folder):
    books = table(spark, folder, "book", "file_id", "content").distinct()
    return features.dialog(TK.tokenize(books, "content", ["file_id"]))


@query("""with c as (select distinct chapter_id, retell, summary from chapter_info where retell is not null and summary is not null),
x as (select chapter_id, list_distinct(regexp_extract_all(lower(retell), '[\\p{L}\\p{N}]+')) as a, list_distinct(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+')) as b from c)
select chapter_id, round(len(list_intersect(a, b)) / cast(nullif(len(list_distinct(list_concat(a, b))), 0) as double), 6) as jaccard from x""")
def retell_jaccard(spark, folder):
    c = table(spark, folder, "chapter_info", "chapter_id", "retell", "summary").distinct().where("retell is not null and summary is not null")
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    return c.select("chapter_id", F.round(alignment.jaccard(words("retell"), words("summary")), 6).alias("jaccard"))


@query("""with c as (select distinct chapter_id, retell, summary from chapter_info where retell is not null and summary is not null),
a as (select chapter_id, unnest(regexp_extract_all(lower(retell), '[\\p{L}\\p{N}]+')) as word from c), b as (select chapter_id, unnest(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+')) as word from c),
x as (select chapter_id, word, count(*) as x from a group by all), y as (select chapter_id, word, count(*) as y from b group by all),
j as (select coalesce(x.chapter_id, y.chapter_id) as chapter_id, coalesce(x, 0) as x, coalesce(y, 0) as y from x full join y on x.chapter_id = y.chapter_id and x.word = y.word)
select chapter_id, round(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 6) as cosine from j group by chapter_id""")
def retell_cosine(spark, folder):
    c = table(spark, folder, "chapter_info", "chapter_id", "retell", "summary").distinct().where("retell is not null and summary is not null")
    words = lambda x: c.select("chapter_id", F.explode(F.regexp_extract_all(F.lower(x), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("word"))
    return alignment.count_cosine(words("retell"), words("summary"), "chapter_id").withColumn("cosine", F.round("cosine", 6))


@query()
def token_alignment(spark, folder):
    """Token edit alignment of retellings with summaries (dynamic programming in each chapter)."""
    c = table(spark, folder, "chapter_info", "chapter_id", "retell", "summary").distinct().where("retell is not null and summary is not null")
    words = lambda x: c.select("chapter_id", F.posexplode(F.regexp_extract_all(F.lower(x), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("place", "word"))
    return alignment.aligned_tokens(words("retell"), words("summary"), "chapter_id")


@query("""with recursive c as (select distinct chapter_id, retell, summary from chapter_info where retell is not null and summary is not null and chapter_id is not null),
w as (select chapter_id, regexp_extract_all(lower(retell), '[\\p{L}\\p{N}]+') as a, regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+') as b from c),
r as (select chapter_id, a, b, 0 as i, list_transform(range(0, len(b) + 1), lambda j: 3 * j) as d from w where len(a) + len(b) > 0
 union all select chapter_id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(t[1:j], lambda x, k: x - 3 * k)) + 3 * j)
 from (select *, list_transform(range(1, len(b) + 2), lambda j: case when j = 1 then i + 1 else least(d[j] + 1, d[j - 1] + case when a[i + 1] = b[j - 1] then 0 else 2 end) end) as t from r where i < len(a)))
select chapter_id, cast(d[len(b) + 1] as bigint) as cost from r where i = len(a)""")
def alignment_costs(spark, folder):
    """What the cheapest token alignment of each retelling with its summary costs."""
    path = token_alignment(spark, folder)
    cost = F.when(F.col("place_a") < 0, 3).when(F.col("place_b") < 0, 1).when(F.col("status") == "Transited", 2).otherwise(0)
    return path.where("chapter_id is not null").groupBy("chapter_id").agg(F.sum(cost).alias("cost"))


@query()
def monotone_matching(spark, folder):
    """Monotone matching of all vectors of two labels, by place."""
    v = table(spark, folder, "embeddings", "vec_id", "embedding", "label").where("embedding is not null")
    own = R.ordering(v, ["label"], ["vec_id"], "place").select(F.expr("label div 2").alias("pair"), F.col("label"), F.col("place").cast("int"), F.col("embedding").alias("vec"))
    return alignment.matched_vectors(own.where("label % 2 = 0").drop("label"), own.where("label % 2 = 1").drop("label"), "pair")


@query("""with t as (select distinct file_id, word_id, sentence_id, word, word_type from src where sentence_id is not null and word is not null and word_type <> 'punct'),
d as (select distinct file_id, sentence_id, lower(word) as word from t), o as (select *, count(*) over (partition by file_id, word) - 1 as o from d),
s as (select file_id, sentence_id, sum(o) as score from o group by all)
select file_id, sentence_id, score from (select *, row_number() over (partition by file_id order by score desc, sentence_id) as n from s) where n <= 3""")
def extractive_summary(spark, folder):
    t = TK.clean(table(spark, folder, "src", "file_id", "word_id", "sentence_id", "word", "word_type")).where("sentence_id is not null and word is not null and word_type != 'punct'")
    return alignment.summary(t.withColumn("word", F.lower("word")), "file_id", 3)


@query("""with q as (select vec_id as query, embedding as a from embeddings where vec_id % 20 = 0), v as (select vec_id as other, embedding as b from embeddings),
s as (select query, other, list_cosine_similarity(a::double[], b::double[]) as c from q join v on query <> other),
r as (select *, row_number() over (partition by query order by c desc, other) as n from s)
select query, other, round(c, 5) as cosine from r where n <= 5""")
def nearest_vectors(spark, folder):
    """The five nearest vectors to every vector whose id is divisible by 20: a stated query set, in blocks, against all."""
    v = table(spark, folder, "embeddings", "vec_id", "embedding")
    return alignment.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 5))


@query("""select a.vec_id as a, b.vec_id as b, round(list_distance(a.embedding::double[], b.embedding::double[]) ** 2, 4) as d from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def vector_distances(spark, folder):
    v = table(spark, folder, "embeddings", "vec_id", "embedding")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return v.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(X.squared_distance(F.col("embedding"), F.col("other")), 4).alias("d"))


@query("""with c as (select distinct chapter_id, retell from chapter_info where retell is not null)
select chapter_id, trim(regexp_replace(regexp_replace(retell, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), '[ \\t]{2,}', ' ', 'g')) as text from c""")
def retell_clean(spark, folder):
    return table(spark, folder, "chapter_info", "chapter_id", "retell").distinct().where("retell is not null").select("chapter_id", formats.without_brackets(F.col("retell")).alias("text"))


@query("""with c as (select distinct chapter_id, retell from chapter_info where retell is not null),
l as (select chapter_id, list_transform(list_filter(string_split(retell, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(substr(x, 4))) as l from c)
select chapter_id, array_to_string(list_transform(l, lambda x: case when regexp_matches(x, '[.!?…]$') then x else x || '.' end), ' ') as text from l""")
def retell_pretty(spark, folder):
    return table(spark, folder, "chapter_info", "chapter_id", "retell").distinct().where("retell is not null").select("chapter_id", alignment.pretty_retell(F.col("retell")).alias("text"))


@query()
def fragment_json(spark, folder):
    """Dialogue and narrative fragments of each book as JSON."""
    books = table(spark, folder, "book", "file_id", "content").where("file_id is not null").distinct()
    # Read by three that follow.
    s = cut(TK.sentence_rows(spread(books), "content", ["file_id"], features.DASHES))
    return alignment.fragments_json(alignment.fragments(s, "file_id", 500), "file_id", "Retell:")


@query()
def markdown_blocks(spark, folder):
    """Documents read as pseudo-markdown: blocks with the headers over them."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("string").alias("filename"), "text")
    return formats.parse_markdown(d, ["doc"])


@query("""with recursive d as (select doc_id, coalesce(lang, '?') as lang, length(text) as len, row_number() over (partition by coalesce(lang, '?') order by doc_id) as n from documents where text is not null),
f as (select lang, n, len, len as held, 0 as pack from d where n = 1
 union all select d.lang, d.n, d.len, case when f.held >= 5000 then d.len else f.held + d.len end, case when f.held >= 5000 then f.pack + 1 else f.pack end from f join d on d.lang = f.lang and d.n = f.n + 1)
select lang, pack, sum(len) + 2 * (count(*) - 1) as size from f group by lang, pack""")
def packed_documents(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "lang", "text").where("text is not null").withColumn("lang", F.coalesce("lang", F.lit("?")))
    return formats.packed_texts(d, ["lang"], "doc_id", "text", 5000).select("lang", "pack", F.length("text").cast("long").alias("size"))


@query("""with d as (select doc_id, n_chars, lang from documents), m as (select avg(n_chars) as m, stddev_samp(n_chars) as s, lang from d group by lang)
select doc_id, round((n_chars - m) / nullif(s, 0), 6) as z from d join m on d.lang = m.lang""")
def scaled_lengths(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "n_chars", "lang")
    return context.scaled(d.withColumn("z", F.col("n_chars").cast("double")), "z", ["lang"]).select("doc_id", F.round("z", 6).alias("z"))
