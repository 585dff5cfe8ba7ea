"""The pN_ queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, align, glyphs, groups, leaks, mixing, plain, sentences, terms
from ..session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of all books and of all token files that were never cut: (record, start_at)."""
    books = sentences.text_sentences(table(spark, folder, "book", "file_id", "content"), "file_id", "content")
    files = sentences.token_sentences(table(spark, folder, "src", "file_id", "word_id", "sentence_id", "paragraph_id", "word_tail", "word"))
    return books.unionByName(files)


@_query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each token that differs from its plain form: (word_id, plain_word)."""
    return plain.plain_words(table(spark, folder, "src", "word_id", "word"), "word_id", "word")


def _p4_sql() -> str:
    """The same forms by joining every character of every word, with the composition left to the database."""
    quote = lambda x: x.replace("'", "''")
    one = ", ".join(f"('{quote(c)}', '{quote(d)}')" for c, d in glyphs.single().items() if c != "\0")
    look = glyphs.scripts()
    shows = lambda script: "".join(c for c, (s, _, _) in look.items() if s == script)
    as_ = lambda k: f"translate(piece, '{''.join(c for c in look if look[c][k] != c)}', '{''.join(x[k] for c, x in look.items() if x[k] != c)}')"
    return f"""
with one(c, d) as (values {one}), w as (select distinct word from src where word is not null),
 ch as (select word, substr(word, i, 1) as c, i from (select word, unnest(range(1, length(word) + 1)) as i from w)),
 f as (select word, string_agg(coalesce(d, ch.c), '' order by i) as flat from ch left join one on one.c = ch.c group by word),
 p as (select word, unnest(string_split(flat, '-')) as piece, generate_subscripts(string_split(flat, '-'), 1) as k from f),
 s as (select *, regexp_matches(piece, '[{shows("L")}]') as l, regexp_matches(piece, '[{shows("R")}]') as r from p),
 t as (select word, k, case when l and not r then {as_(1)} when r and not l then {as_(2)} else piece end as piece from s),
 u as (select word, trim(nfc_normalize(string_agg(piece, '-' order by k)), ' ') as plain_word from t group by word)
select distinct word_id, plain_word from src join u using (word) where plain_word <> word
"""


SQL["p4_found"] = _p4_sql()


def _leaks(spark: SparkSession, folder: str, max_edits: int) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "eval_item", "item_id", "text"), "item_id", "text", max_edits)


@_query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least ten consecutive words of a test item: (doc_id, item_id)."""
    return _leaks(spark, folder, 0).select("doc_id", "item_id")


def _p6_sql() -> str:
    """The same by an equality join of all windows: words of folded texts, folding as one translation of single characters."""
    table_, several = glyphs.folding()
    one = {c: d for c, d in table_.items() if len(d) == 1}
    gone = "".join(c for c, d in table_.items() if not d)
    quote = lambda x: x.replace("'", "''")
    folded = f"translate(text, '{quote(''.join(one) + gone)}', '{quote(''.join(one.values()))}')"
    for c, d in several.items():
        folded = f"replace({folded}, '{quote(c)}', '{quote(d)}')"
    small = glyphs.small()
    joined = r"regexp_replace(text, '([\p{L}\p{N}_])[-\x{2010}\x{2011}\x{ad}][ \t]*\r?\n[\s>]*', '\1', 'g')"
    words = f"regexp_extract_all(translate(lower(folded), '{''.join(small)}', '{''.join(small.values())}'), '[\\p{{L}}\\p{{N}}]+')"
    windows = lambda name, key: f"""{name}1 as (select distinct {key} as id, {joined} as text from {name} where {key} is not null and text is not null),
 {name}2 as (select id, {folded} as folded from {name}1), {name}3 as (select id, {words} as w from {name}2),
 {name}4 as (select distinct id, array_to_string(w[k : k + 9], ' ') as g from (select id, w, unnest(range(1, len(w) - 8)) as k from {name}3 where len(w) >= 10))"""  # noqa: E731
    return f"with {windows('documents', 'doc_id')}, {windows('eval_item', 'item_id')} select distinct d.id as doc_id, i.id as item_id from documents4 d join eval_item4 i using (g)"


SQL["p6_found"] = _p6_sql()


@_query
def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same with slightly changed windows: how many windows are shared and how close the closest is."""
    return _leaks(spark, folder, 2)


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    src = table(spark, folder, "src", "word_id", "file_id", "word")
    files = src.select("file_id").distinct().count()
    return terms.marked(terms.corpus_terms(src, table(spark, folder, "pymorphy", "word_id", "normal_form")), files)


@_query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that are too rare or too common: (field, term, mark)."""
    return _terms(spark, folder).where("mark is not null").select("field", "term", "mark")


@_query
def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct word and normal form with its occurrences, the files that hold it and its mark."""
    return _terms(spark, folder)


SQL["p5_terms"] = """
with w as (select distinct word_id, file_id, word from src),
 n as (select distinct p.word_id, s.file_id, p.normal_form from (select distinct word_id, normal_form from pymorphy) p
   left join (select distinct word_id, file_id from src) s on s.word_id = p.word_id),
 t as (select 'word' as field, word as term, file_id from w where word is not null
   union all select 'normal_form', normal_form, file_id from n where normal_form is not null),
 c as (select field, term, count(*) as occurrences, count(distinct file_id) as records from t group by field, term)
select field, term, occurrences, records,
 case when occurrences <= 2 or records <= 1 then 'rare'
  when records > 0.5 * (select count(distinct file_id) from src) then 'common' end as mark
from c
"""
SQL["p5_found"] = f"select field, term, mark from ({SQL['p5_terms']}) where mark is not null"


#: Words of the longest n-gram that p5_ngrams counts.
NGRAM = 3


@_query
def p5_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """All n-grams of up to NGRAM words of the files, with occurrences, files and mark: (size, term, occurrences, records, mark)."""
    src = table(spark, folder, "src", "word_id", "file_id", "word")
    files = src.select("file_id").distinct().count()
    return terms.marked(terms.corpus_ngrams(src, NGRAM), files)


SQL["p5_ngrams"] = """
with w as (select word_id, max(file_id) as file_id, max(word) as word from src where word_id is not null and file_id is not null group by word_id),
 t as (select file_id, word as a, lead(word, 1) over o as b, lead(word, 2) over o as c from w where word is not null
   window o as (partition by file_id order by word_id)),
 g as (select 1 as size, a as term, file_id from t union all select 2, a || ' ' || b, file_id from t where b is not null
   union all select 3, a || ' ' || b || ' ' || c, file_id from t where c is not null),
 k as (select cast(size as integer) as size, term, count(*) as occurrences, count(distinct file_id) as records from g group by size, term)
select size, term, occurrences, records,
 case when occurrences <= 2 or records <= 1 then 'rare'
  when records > 0.5 * (select count(distinct file_id) from src) then 'common' end as mark
from k
"""


@_query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of files that belong together, by group: (sentence_id, group_id)."""
    return groups.grouped_sentences(
        table(spark, folder, "src", "file_id", "sentence_id"), table(spark, folder, "toc", "file_id", "tags"), table(spark, folder, "relation", "file_1", "file_2")
    )


def _p3_sql() -> str:
    """The same groups by following edges from every file until nothing new is reached."""
    quoted = lambda words: ", ".join("'" + w + "'" for w in words)
    nothing, sections = quoted(groups.PLACEHOLDERS), quoted(groups.SECTIONS)
    blanks = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200d}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]+"
    squeezed = f"""trim(regexp_replace(lower(regexp_replace(x, '[«»"“”„‟''‘’‹›`]', '', 'g')), '{blanks}', ' ', 'g'))"""
    return f"""
with recursive named as (
  select file_id, 'author_url' as tag, tags['author_url'] as x from toc union all select file_id, 'collection_url', tags['collection_url'] from toc
  union all select file_id, 'fandom', tags['fandom'] from toc),
 squeezed as (select file_id, tag, {squeezed} as k from named where x is not null),
 bare as (select file_id, tag, case when tag = 'fandom' then k else regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
   k, '[?#].*$', ''), '^([a-z][a-z0-9+.-]*:)?//[^/]*', ''), '^[a-z0-9-]+(\\.[a-z0-9-]+)+(:\\d+)?/', ''), '/+', '/', 'g'), '^[/ ]+|[/ ]+$', '', 'g') end as k from squeezed),
 valued as (select file_id, tag || ':' || k as v from bare where k not in ({nothing}) and (tag = 'fandom' or k not in ({sections}) and split_part(k, '/', -1) not in ({nothing}))),
 files as (select distinct file_id from toc where file_id is not null),
 edges as (select a.file_id as a, b.file_id as b from valued a join valued b using (v) union select file_1, file_2 from relation union select file_2, file_1 from relation),
 own as (select distinct a, b from edges where a in (select file_id from files) and b in (select file_id from files)),
 reached as (select file_id as a, file_id as b from files union select r.a, o.b from reached r join own o on o.a = r.b),
 sentences as (select distinct file_id, sentence_id from src where sentence_id is not null),
 firsts as (select file_id, min(sentence_id) as first from sentences group by file_id),
 grouped as (select r.a as file_id, count(*) as files, min(f.first) as group_id from reached r left join firsts f on f.file_id = r.b group by r.a)
select distinct sentence_id, group_id from sentences join grouped using (file_id) where files > 1
"""


SQL["p3_found"] = _p3_sql()


@_query
def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every sentence: (sentence_id, split)."""
    return groups.sentence_splits(
        table(spark, folder, "src", "file_id", "sentence_id"),
        table(spark, folder, "toc", "file_id", "tags"),
        table(spark, folder, "relation", "file_1", "file_2"),
        table(spark, folder, "split_target", "split", "target_share"),
    )


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scored(
        table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "abuse_term", "term", "category"), table(spark, folder, "review_label", "doc_id", "rater", "toxic")
    )


@_query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexual sentence: (doc_id)."""
    return _scores(spark, folder).where("score >= 0.5").select("doc_id")


@_query
def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's scores."""
    return _scores(spark, folder)


@_query
def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The share of flagged documents by clean source."""
    return abuse.rates(table(spark, folder, "documents", "doc_id", "source"), _scores(spark, folder), "doc_id", "source")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = mixing.stored_sizes(table(spark, folder, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")
    targets = table(spark, folder, "mix_target", "source", "target_share", "max_repeats")
    return mixing.mixture(cut(mixing.blocks(sizes)), targets), sizes, targets


@_query
def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What each slot of the mixed output holds: (shard, slot, source, repetition, block, doc_id, from_token, to_token)."""
    return _mixed(spark, folder)[0]


@_query
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source has, should have and reaches."""
    return mixing.shares(*_mixed(spark, folder))


@_query
def p7_full(spark: SparkSession, folder: str) -> DataFrame:
    """The same for a mix as large as the corpus: sources that their repeats don't let reach their share stay at their limit, the
    others share out the rest."""
    sizes = mixing.stored_sizes(table(spark, folder, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")
    targets = table(spark, folder, "mix_target", "source", "target_share", "max_repeats")
    slots = -(-(sizes.agg(F.sum("tokens")).first()[0] or 0) // mixing.BLOCK)
    return mixing.shares(mixing.mixture(cut(mixing.blocks(sizes)), targets, slots), sizes, targets)


@_query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of the Russian and the English edition of a chapter that translate each other."""
    found = align.aligned(
        table(spark, folder, "book", "book_id", "file_id", "lang", "content", "collection_url", "name"),
        table(spark, folder, "relation", "file_1", "file_2", "relation_name"),
        table(spark, folder, "chapter_info", "book_id", "name"),
        table(spark, folder, "glossary", "ru_word", "en_word"),
    )
    return align.ordered(found)
