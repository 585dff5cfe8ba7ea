"""Queries over text formats: files of a format are made of the tables' texts and read back."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..session import shared_folder, table
from ..sources import formats
from .registry import query

#: Books with text: their lines that show anything.
BOOKS = r"""b as (select file_id, coalesce(min(name), '?') as name, min(content) as content from book where content is not null group by file_id),
 l as (select file_id, name, content, list_filter(string_split(regexp_replace(content, '[\x{00}-\x{08}\x{0b}-\x{1f}]', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) as lines from b)"""
BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


def _books(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "book", "file_id", "name", "content").where("content is not null").groupBy("file_id").agg(F.coalesce(F.min("name"), F.lit("?")).alias("name"), F.min("content").alias("content"))
    flat = F.regexp_replace("content", "[\\x00-\\x08\\x0b-\\x1f]", "")
    shown = lambda x: x.rlike("[^\\s\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
    return b.withColumn("lines", F.filter(F.split(flat, "\n"), shown))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _fb2(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): each book as an FB2 file, with a mark inside a line, a note, and what is to be ignored."""
    lines = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), "")
    xml = F.concat(
        F.lit("<FictionBook><description>x</description><body><title><p>"), _escaped(F.col("name")), F.lit("</p></title><section>"), lines,
        F.lit('<p>Слово <emphasis>важное</emphasis> тут.</p></section></body><body name="notes"><p>note</p></body></FictionBook>'),
    )
    return _books(spark, folder).select(F.concat("file_id", F.lit(".fb2")).alias("path"), F.encode(xml, "UTF-8").alias("content"))


@query(f"with {BOOKS} select file_id || '.fb2' as filename, '## ' || name || chr(10) || chr(10) || array_to_string(list_append(lines, 'Слово важное тут.'), chr(10) || chr(10)) as markdown from l")
def fb2_markdown(spark, folder):
    """FB2 files as pseudo-markdown."""
    return formats.fb2_markdown(formats.read_fb2(_fb2(spark, folder)))


@query(f"""with {BOOKS}, n as (select count(*) as f, sum(len(lines)) as k from l),
 x as (select 'ignore' as command, true as is_empty, 2 * f as n from n union all select 'ignore', false, f from n union all select null, true, 8 * f from n union all select 'header', false, f from n
  union all select 'sameline', true, 3 * f + k from n union all select 'newline', false, k + 2 * f from n union all select 'sameline', false, 2 * f from n)
select command, is_empty, cast(n as bigint) as n from x""")
def fb2_commands(spark, folder):
    """What the paths of FB2 files mean."""
    return formats.fb2_summary(formats.read_fb2(_fb2(spark, folder))).groupBy("command", "is_empty").agg(F.sum("n").alias("n"))


@query("select 0 as uncovered, 2 as other")
def fb2_coverage(spark, folder):
    """Paths with text that aren't understood: none of the books', two of a strange file's."""
    own = formats.fb2_uncovered(formats.read_fb2(_fb2(spark, folder))).agg(F.count(F.lit(1)).cast("int").alias("uncovered"))
    strange = spark.createDataFrame([("s.fb2", bytearray(b"<FictionBook><body><table><tr>x</tr></table><section><code>y</code><empty-line/></section></body></FictionBook>"))], "path string, content binary")
    other = formats.fb2_uncovered(formats.read_fb2(strange)).agg(F.count(F.lit(1)).cast("int").alias("other"))
    return own.withColumn("k", F.lit(1)).join(other.withColumn("k", F.lit(1)), "k").drop("k")


@query(f"""with {BOOKS}, s as (select file_id || '.fb2' as filename, name, length(name) + coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) + 17 as size from l),
 x as (select filename, 1 as body, name as title, size as length, size >= 4 as first from s union all select filename, 2, null, 4, size >= 4 from s)
select filename, body, title, cast(length as bigint) as length, body - 1 as place, case when first then body - 1 else 2 - body end as size_place, not first as suspicious from x""")
def fb2_bodies(spark, folder):
    """The bodies of FB2 files."""
    return formats.fb2_bodies(formats.read_fb2(_fb2(spark, folder)))


@query(f"with {BOOKS} select file_id || '.md' as file, md5('## ' || name || chr(10) || chr(10) || array_to_string(list_append(lines, 'Слово важное тут.'), chr(10) || chr(10))) as digest from l")
def fb2_converted(spark, folder):
    """FB2 files written as a tree of text files and read back."""
    path = f"{shared_folder(spark)}/converted-{hashlib.md5(folder.encode()).hexdigest()[:8]}"
    formats.write_markdown(formats.fb2_markdown(formats.read_fb2(_fb2(spark, folder))), path)
    return formats.read_written(spark, path).select("file", F.md5("text").alias("digest"))


@query(f"""with {BOOKS}, s as (select file_id, '## ' || regexp_replace(name, '{BLANKS}', ' ', 'g') as head, list_transform(lines, lambda x: trim(regexp_replace(x, '{BLANKS}', ' ', 'g'))) as lines from l)
select file_id, array_to_string(list_concat([head], lines, ['end']), chr(10) || chr(10)) as markdown from s""")
def html_markdown(spark, folder):
    """HTML pages as pseudo-markdown."""
    lines = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), "\n")
    page = F.concat(F.lit("<html><head><script>var x;</script></head><body><h1>"), _escaped(F.col("name")), F.lit("</h1>"), lines, F.lit("<p>end</p><h2>footer</h2></body></html>"))
    return formats.pages_markdown(_books(spark, folder).select("file_id", page.alias("html")), "file_id", "html")


PAGE = """concat('<a href="', coalesce(rel_url, '/none'), '">x</a><a class="w" href="', coalesce(author_url, '/none'), '">y</a><h1 class="title"> ', coalesce(name, '?'), ' </h1>')"""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "book", "book_id", "rel_url", "author_url", "name").where("book_id is not null").groupBy("book_id").agg(F.min("rel_url").alias("rel_url"), F.min("author_url").alias("author_url"), F.min("name").alias("name"))
    return b.select("book_id", F.expr(PAGE).alias("html"))


@query("""with b as (select book_id, coalesce(min(rel_url), '/none') as rel_url, coalesce(min(author_url), '/none') as author_url from book where book_id is not null group by book_id)
select book_id, rel_url as link from b where rel_url like '/%' union select book_id, author_url from b where author_url like '/%'""")
def page_links(spark, folder):
    """The links of pages that lead to the site itself."""
    return _pages(spark, folder).select("book_id", F.explode(formats.links(F.col("html"), "^/")).alias("link"))


@query("""with b as (select book_id, coalesce(min(name), '?') as name from book where book_id is not null group by book_id)
select book_id, '$ {"title":"t","n":"1"}' || chr(10) || chr(10) || trim(name) as markdown from b where name not like '%<%'""")
def page_tags(spark, folder):
    """A page's title, with tags in front."""
    p = _pages(spark, folder).select("book_id", *formats.page_fields(F.col("html"), {"title": 'class="title"'})).where("title != ''")
    tags = F.create_map(F.lit("title"), F.lit("t"), F.lit("n"), F.lit("1"))
    return p.select("book_id", formats.tagged_markdown(tags, F.col("title")).alias("markdown"))


@query("""with b as (select distinct book_id, author_url, length(content) as n from book where content is not null and author_url is not null)
select author_url, count(*) as works, cast(sum(n) as bigint) as size from b group by author_url having sum(n) >= 3000""")
def authors_of_size(spark, folder):
    """Authors with enough text."""
    b = table(spark, folder, "book", "book_id", "author_url", "content").where("content is not null and author_url is not null")
    works = b.select("book_id", "author_url", F.length("content").alias("n")).distinct()
    return formats.authors_of_size(works, "author_url", "n", 3000)


@query("select distinct book_id, sha256(rel_url) as key from book where rel_url is not null")
def cache_keys(spark, folder):
    return table(spark, folder, "book", "book_id", "rel_url").where("rel_url is not null").distinct().select("book_id", formats.cache_key(F.col("rel_url")).alias("key"))


@query(f"""with recursive b as (select distinct doc_id, text from documents where text is not null),
 r as (select doc_id, 0 as k, text as rest, cast(null as varchar) as part from b
  union all select doc_id, k + 1, case when length(rest) > 600 then substr(rest, 301 + cut) end, case when length(rest) > 600 then substr(rest, 1, 300 + cut) else rest end
  from (select *,
   case when contains(substr(rest, 301, 300), chr(10) || chr(10)) then 300 - length(list_extract(string_split(substr(rest, 301, 300), chr(10) || chr(10)), -1)) - 2
    when contains(substr(rest, 301, 300), chr(10)) then 300 - length(list_extract(string_split(substr(rest, 301, 300), chr(10)), -1)) - 1
    when contains(substr(rest, 301, 300), ' ') then 300 - length(list_extract(string_split(substr(rest, 301, 300), ' '), -1)) - 1 else 299 end as cut from r where rest is not null)),
 t as (select doc_id, k, regexp_replace(regexp_replace(part, '^{BLANKS}', ''), '{BLANKS}$', '') as part from r where part is not null)
select doc_id, count(*) as parts, cast(sum(length(part)) as bigint) as size from t where length(part) >= 11 group by doc_id""")
def mini_parts(spark, folder):
    """Documents in parts of 300 to 600 characters, cut at blank lines, line breaks or blanks."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").distinct()
    return formats.split_texts(d, "doc_id", "text", 300).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("text")).alias("size"))


@query("""with recursive d as (select doc_id, length(text) as len, row_number() over (order by doc_id) as n from (select distinct doc_id, text from documents where text is not null)),
f as (select n, len, len as held, 0 as pack from d where n = 1
 union all select d.n, d.len, case when f.held >= 20000 then d.len else f.held + d.len end, case when f.held >= 20000 then f.pack + 1 else f.pack end from f join d on d.n = f.n + 1)
select pack, cast(sum(len) + 2 * (count(*) - 1) as bigint) as size from f group by pack""")
def csv_packed(spark, folder):
    """A .csv.gz file of texts, packed greedily to texts of 20000 characters."""
    path = f"{shared_folder(spark)}/csv-{hashlib.md5(folder.encode()).hexdigest()[:8]}"
    table(spark, folder, "documents", "doc_id", "text").where("text is not null").distinct().write.mode("overwrite").csv(path, header=True, compression="gzip", escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = formats.read_csv_texts(spark, path, "doc_id long, text string").withColumn("all", F.lit(0))
    return formats.packed_texts(read, ["all"], "doc_id", "text", 20000).select("pack", F.length("text").cast("long").alias("size"))


@query("select distinct doc_id, text, source from documents")
def json_lines(spark, folder):
    """Documents written as JSON lines and read with their schema."""
    path = f"{shared_folder(spark)}/json-{hashlib.md5(folder.encode()).hexdigest()[:8]}"
    table(spark, folder, "documents", "doc_id", "text", "source").distinct().write.mode("overwrite").json(path)
    return formats.read_json_lines(spark, path, "doc_id long, text string, source string")


@query("""with b as (select distinct book_id, name, author_url, review_cnt from book)
select book_id, name as book_title, author_url as book_by_url, review_cnt as book_reviews from b""")
def flattened_fields(spark, folder):
    """Nested objects as columns named by their paths."""
    b = table(spark, folder, "book", "book_id", "name", "author_url", "review_cnt").distinct()
    return nested.flattened(b.select("book_id", F.struct(F.col("name").alias("title"), F.struct(F.col("author_url").alias("url")).alias("by"), F.col("review_cnt").alias("reviews")).alias("book")))


@query("""with b as (select distinct book_id, name, author_url from book) select 'x' || book_id as x_id, name as x_title, author_url as x_url from b""")
def selected_fields(spark, folder):
    """Fields of nested objects by path, under a prefix."""
    b = table(spark, folder, "book", "book_id", "name", "author_url").distinct()
    objects = b.select(F.concat(F.lit("x"), "book_id").alias("id"), F.struct(F.col("name").alias("title"), F.struct(F.col("author_url").alias("url")).alias("by")).alias("book"))
    return nested.prefixed(nested.by_path(objects, {"title": "book.title", "url": "book.by.url"}, ["id"]), "x_")


@query("""with s as (select sentence_id, list(word_length) as l from (select distinct word_id, sentence_id, word_length from src where sentence_id is not null and word_length is not null) group by sentence_id)
select sentence_id, len(l) as n_count, list_min(l) as n_min, list_max(l) as n_max, round(list_avg(l), 6) as n_mean from s""")
def list_statistics(spark, folder):
    """Statistics of lists of numbers."""
    s = table(spark, folder, "src", "word_id", "sentence_id", "word_length").where("sentence_id is not null").distinct()
    lists = s.groupBy("sentence_id").agg(F.collect_list("word_length").alias("l"))
    return lists.select("sentence_id", *nested.list_stats(F.col("l"), "n")).withColumn("n_mean", F.round("n_mean", 6)).where("n_count > 0")


@query(f"""with {BOOKS} select file_id || '.md' as filename, unnest([0, 1]) as part_index, md5(name) as header_0, unnest(['Начало', 'Конец']) as header_1, unnest([md5(content) || chr(10) || md5(file_id), 'последняя']) as text from l""")
def markdown_headers(spark, folder):
    """Pseudo-markdown with headers of two levels: blocks with the headers over them."""
    text = F.concat(F.lit("# "), F.md5("name"), F.lit("\n## Начало\n\n"), F.md5("content"), F.lit("\n"), F.md5("file_id"), F.lit("\n## Конец\n\nпоследняя"))
    files = _books(spark, folder).select(F.concat("file_id", F.lit(".md")).alias("filename"), text.alias("text"))
    # A dash in a name would part it into tags.
    parsed = formats.parse_markdown(files.withColumn("filename", F.translate("filename", "-", "_")), ["name"])
    return parsed.select(F.translate("filename", "_", "-").alias("filename"), "part_index", F.col("tags")["header_0"].alias("header_0"), F.col("tags")["header_1"].alias("header_1"), F.regexp_replace("text", "\\s+$", "").alias("text"))


@query(r"""with d as (select distinct doc_id, text, regexp_extract(text, '^[\p{L}\p{N}]+') as w from documents where text is not null)
select doc_id, 0 as word_id, w as word, 0 as start, length(w) as "end", 1 as starts, 1 as ends from d where w <> '' and not regexp_matches(text, '^[\p{L}\p{N}]+[-′][\p{L}\p{N}]')""")
def entity_spans(spark, folder):
    """Tokens that annotated spans begin and end with: the first word of each document is annotated."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").distinct().withColumn("w", F.regexp_extract("text", "^[\\p{L}\\p{N}]+", 0))
    d = d.where("w != '' and not text rlike '^[\\\\p{L}\\\\p{N}]+[-′][\\\\p{L}\\\\p{N}]'")
    spans = d.select("doc_id", F.lit(0).alias("start"), F.length("w").alias("end"))
    return formats.entity_spans(d.select("doc_id", "text"), spans, "doc_id").where("starts > 0 or ends > 0")


@query(r"""with d as (select distinct doc_id, text from documents where text is not null) select count(*) as texts, cast(count(*) as bigint) as inside from d where regexp_matches(text, '^[\p{L}\p{N}]')""")
def entity_span_sums(spark, folder):
    """How many tokens stand in annotated spans: one of each document that begins with a word."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null").distinct().where("text rlike '^[\\\\p{L}\\\\p{N}]'")
    first = F.length(F.regexp_extract("text", "^[\\p{L}\\p{N}]+(?:[-′][\\p{L}\\p{N}]+)*", 0))
    sums = formats.span_sums(formats.entity_spans(d, d.select("doc_id", F.lit(0).alias("start"), first.alias("end")), "doc_id"), "doc_id")
    return sums.agg(F.count(F.lit(1)).alias("texts"), F.sum("inside").alias("inside"))
