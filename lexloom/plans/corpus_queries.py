"""Queries over corpora: written to the shared folder from the tables, and read back in all ways there are."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, sampling
from ..operators import tokens as TK
from ..session import shared_folder, table
from ..sources import corpus as C
from ..sources import formats
from .registry import query

#: The files that stand in both tables, and the tokens, in SQL.
OWN = """f as (select file_id, min(filename) as filename from toc where file_id is not null group by file_id),
 t as (select distinct file_id, word_id, sentence_id, word_index, paragraph_id, word_tail, word, word_type, word_length from src where file_id in (select file_id from f)),
 few as (select file_id from t group by file_id order by file_id limit 3)"""
TOKENS = ("file_id", "word_id", "sentence_id", "word_index", "paragraph_id", "word_tail", "word", "word_type", "word_length")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "toc", "file_id", "filename").where("file_id is not null").groupBy("file_id").agg(F.min("filename").alias("filename"))


def _tokens(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """The tokens of the files of the table of contents, each once. Rows move once, into ranges of word ids inside files: filenames meet
    them there, and repeated rows (word_id is the key) one another."""
    src = table(spark, folder, "src", *TOKENS)
    src = (src.where(where) if where is not None else src).withColumn("_block", TK.word_block())
    names = src.select("file_id", "_block").distinct().join(_files(spark, folder), "file_id")
    # Before the first one stands what is no word's id.
    before = F.lag("word_id", 1, TK.NO_BLOCK).over(TK.Window.partitionBy("file_id", "_block").orderBy("word_id"))
    return src.join(names, ["file_id", "_block"]).withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("word_id"))).drop("_block", "_before")


def _forms(spark: SparkSession, folder: str, own: C.Corpus) -> DataFrame:
    """Morphology of the words that a corpus holds."""
    forms = table(spark, folder, "pymorphy", "word_id", "normal_form", "pos").groupBy("word_id").agg(F.min("normal_form").alias("normal_form"), F.min("pos").alias("pos"))
    return forms.join(own.src().select("file_id", F.col("original_word_id").alias("word_id")), "word_id")


def _at(spark: SparkSession, folder: str, name: str) -> C.Corpus:
    return C.Corpus(spark, f"{shared_folder(spark)}/corpora-{hashlib.md5(folder.encode()).hexdigest()[:8]}/{name}")


def _made(spark: SparkSession, folder: str, name: str, make) -> C.Corpus:
    """A corpus in the shared folder, written the first time it is asked for."""
    own = _at(spark, folder, name)
    if not own._has("_made/_SUCCESS"):
        make(own)
        spark.range(1).write.mode("overwrite").parquet(f"{own.path}/_made")
    return own


def _whole(spark: SparkSession, folder: str) -> C.Corpus:
    """All files, a frame of morphology, relations and a mapping."""

    def make(own: C.Corpus) -> None:
        tags = table(spark, folder, "toc", "file_id", "tags").where("file_id is not null").groupBy("file_id").agg(F.min_by("tags", F.coalesce(F.col("tags")["author_url"], F.lit("~"))).alias("tags"))
        own.write(_tokens(spark, folder), tags, "overwrite")
        own.write_frame("forms", _forms(spark, folder, own), rows=table(spark, folder, "pymorphy", "word_id").count())
        relation = table(spark, folder, "relation", "file_1", "file_2", "relation_name").distinct()
        relation.limit(0).write.mode("overwrite").parquet(f"{own.path}/relation")
        own.add_relation(relation)
        own.write_mapping(table(spark, folder, "chapter_info", "chapter_id", "book_id").distinct(), "mapping_chapters")

    return _made(spark, folder, "whole", make)


def _some(spark: SparkSession, folder: str) -> list[str]:
    """The ids of the first three files."""
    return [r.file_id for r in _tokens(spark, folder).select("file_id").distinct().orderBy("file_id").limit(3).collect()]


@query(f"""with {OWN}, s as (select file_id, filename, count(*) as token_count, sum(word_length) as character_count, min(word_id) as w from t join f using (file_id) group by file_id, filename)
select file_id, filename, token_count, character_count, cast(row_number() over (partition by filename order by w, file_id) - 1 as int) as part_index from s""")
def corpus_toc(spark, folder):
    """The table of contents of a written corpus. Parts are numbered in the order of the new ids, which is that of the files' hashes."""
    own = _whole(spark, folder)
    first = own.src().groupBy("file_id").agg(F.min("original_word_id").alias("w"))
    part = F.row_number().over(TK.Window.partitionBy("filename").orderBy("w", "file_id")) - 1
    return own.toc().join(first, "file_id").select("file_id", "filename", "token_count", "character_count", part.cast("int").alias("part_index"))


@query(f"""with {OWN} select file_id, word_id as original_word_id, word, dense_rank() over (partition by file_id order by sentence_id nulls first) as sentence from t where file_id in (select file_id from few)""")
def corpus_files(spark, folder):
    """src of the files asked for; one that isn't there is left out."""
    own = _whole(spark, folder)
    src = own.src(own.requested([*_some(spark, folder), "no such file"]))
    return src.select("file_id", "original_word_id", "word", F.dense_rank().over(TK.Window.partitionBy("file_id").orderBy("sentence_id")).alias("sentence"))


@query(f"""with {OWN}, p as (select word_id, min(normal_form) as normal_form, min(pos) as pos from pymorphy group by word_id)
select t.file_id, word_id, normal_form, pos from p join t using (word_id) where t.file_id in (select file_id from few)""")
def corpus_frame(spark, folder):
    """A feature frame of the files asked for: no further columns."""
    return _whole(spark, folder).frame("forms", _some(spark, folder)).drop("bucket")


@query(f"""with {OWN} select 'src' as frame, count(*) as rows, count(distinct file_id) as files from t where file_id in (select file_id from few)
union all select 'forms', count(*), count(distinct file_id) from (select distinct p.word_id, t.file_id from pymorphy p join t using (word_id)) where file_id in (select file_id from few)
union all select 'toc', count(*), count(distinct file_id) from few""")
def corpus_bundle(spark, folder):
    """All frames of the files asked for, and their rows of the table of contents."""
    b = _whole(spark, folder).bundle(_some(spark, folder))
    out = None
    for name, df in [*b.frames.items(), ("toc", b.info["toc"])]:
        own = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("file_id").alias("files")).select(F.lit(name).alias("frame"), "rows", "files")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""with {OWN}, n as (select file_id, row_number() over (order by file_id) as k from few),
r as (select 0 as request_no, cast(k - 1 as varchar) as name, file_id from n union all select 1, 'other', file_id from n where k = 1)
select request_no, name, file_id, count(*) as tokens from r join t using (file_id) group by all""")
def corpus_requests(spark, folder):
    """Several requests for files at once, a list and a dict."""
    own = _some(spark, folder)
    found = _whole(spark, folder).grouped_src([own, {"other": own[0], "lost": "no such file"}])
    return found.groupBy("request_no", "name", "file_id").agg(F.count(F.lit(1)).alias("tokens"))


@query("select distinct file_1, file_2, relation_name from relation")
def corpus_relations(spark, folder):
    return _whole(spark, folder).relations()


@query("select distinct chapter_id, book_id from chapter_info")
def corpus_mapping(spark, folder):
    """The first mapping of a corpus."""
    return _whole(spark, folder).mapping()


@query(f"""with {OWN}, e as (select file_1, relation_name, min(file_2) as file_id from relation where relation_name is not null group by all),
w as (select * from e where file_id in (select file_id from t) order by file_1, relation_name limit 2)
select file_1 as request, relation_name, w.file_id, count(*) as tokens from w join t using (file_id) group by all""")
def corpus_mapped(spark, folder):
    """src of the first related file of a file, for two relations that there are."""
    own = _whole(spark, folder)
    first = own.relations().where("relation_name is not null and file_1 is not null").groupBy("file_1", "relation_name").agg(F.min("file_2").alias("file_id"))
    there = first.join(own.toc().select("file_id"), "file_id", "left_semi").orderBy("file_1", "relation_name").limit(2).collect()
    mapped = None
    for r in there:
        got = own.mapped([r.file_1], [r.relation_name])
        mapped = got if mapped is None else mapped.unionByName(got)
    return mapped.groupBy("request", "relation_name", "file_id").agg(F.count(F.lit(1)).alias("tokens"))


def _halves(spark: SparkSession, folder: str) -> tuple[C.Corpus, C.Corpus]:
    """Two corpora: the files whose id begins with a digit up to 7, and the rest."""
    low = F.substring("file_id", 1, 1).between("0", "7")
    a = _made(spark, folder, "low", lambda own: own.write(_tokens(spark, folder, low), mode="overwrite"))
    b = _made(spark, folder, "high", lambda own: own.write(_tokens(spark, folder, ~low), mode="overwrite"))
    return a, b


@query(f"""with {OWN} select case when substr(file_id, 1, 1) between '0' and '7' then 'low' else 'high' end as corpus_id, count(*) as tokens, count(distinct file_id) as files from t group by 1""")
def corpus_several(spark, folder):
    """src of several corpora, told apart."""
    return C.read_several(_halves(spark, folder)).groupBy("corpus_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("file_id").alias("files"))


def _parallel(spark: SparkSession, folder: str) -> C.Corpus:
    def make(own: C.Corpus) -> None:
        a, b = _halves(spark, folder)
        own.add_parallel(a, "low")
        own.add_parallel(b, "high", table(spark, folder, "relation", "file_1", "file_2", "relation_name").distinct())

    return _made(spark, folder, "parallel", make)


@query(f"""with {OWN} select file_id, count(*) as tokens, count(*) as ids from t where substr(file_id, 1, 1) not between '0' and '7' group by file_id""")
def corpus_subcorpus(spark, folder):
    """src of the files of one subcorpus."""
    return _parallel(spark, folder).subcorpus("high").groupBy("file_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("word_id").alias("ids"))


@query(f"""with {OWN} select count(*) as tokens, count(*) as ids, count(distinct file_id) as files, count(distinct file_id) as ordinals, true as apart, (select count(*) from (select distinct file_1, file_2, relation_name from relation)) as relations from t""")
def corpus_parallel(spark, folder):
    """Two corpora appended to one: ids stay unique over both, ordinals go on, the files' ranges of ids don't meet."""
    own = _parallel(spark, folder)
    spans = own.src().groupBy("file_id").agg(F.min("word_id").alias("lo"), F.max("word_id").alias("hi"))
    before = F.lag("hi").over(TK.Window.partitionBy(F.lit(0)).orderBy("lo"))
    # A row per file.
    apart = spans.withColumn("before", before).agg(F.coalesce(F.min(F.col("before").isNull() | (F.col("lo") > F.col("before"))), F.lit(True)).alias("apart"))
    n = own.src().agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("word_id").alias("ids"), F.count_distinct("file_id").alias("files"))
    o = own.toc().agg(F.count_distinct("ordinal").alias("ordinals"))
    r = own.relations().agg(F.count(F.lit(1)).alias("relations"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(n).join(one(o), "k").join(one(apart), "k").join(one(r), "k").drop("k")


@query("""with f as (select file_id, min(filename) as filename from toc where file_id is not null and file_id in (select file_id from src) and substr(file_id, 1, 1) between '0' and '7' group by file_id)
select file_id, upper(filename) as filename from f""")
def corpus_replaced_toc(spark, folder):
    """Another table of contents, made from the present one."""

    def make(own: C.Corpus) -> None:
        a, _ = _halves(spark, folder)
        own.write(a.src().drop("corpus_id", "bucket"), mode="overwrite")
        own.replace_toc(own.toc().withColumn("filename", F.upper("filename")))

    return _made(spark, folder, "replaced", make).toc().select("file_id", "filename")


@query(f"""with {OWN}, long as (select file_id from t group by file_id having count(*) >= 200)
select file_id, word_id as original_word_id, word is not null and lower(substr(word, 1, 1)) <> substr(word, 1, 1) as cap from t where file_id in (select file_id from long)""")
def corpus_featurized(spark, folder):
    """A featurizer and a filter of files run over a corpus; what comes out is written as another."""

    def make(own: C.Corpus) -> None:
        caps = features.simple("caps", lambda b: b["src"].select("file_id", "word_id", F.coalesce(F.lower(F.substring("word", 1, 1)) != F.substring("word", 1, 1), F.lit(False)).alias("cap")))
        long = lambda b: b.src.groupBy("file_id").agg((F.count(F.lit(1)) >= 200).alias("keep"))
        C.featurized(_whole(spark, folder), own, [long, caps], append=False)

    own = _made(spark, folder, "featurized", make)
    return own.frame("caps").join(own.src().select("file_id", "word_id", "original_word_id"), ["file_id", "word_id"]).select("file_id", "original_word_id", "cap")


@query(f"""with {OWN}, c as (select file_id from t group by file_id order by md5('5:' || file_id), file_id limit 4) select file_id, count(*) as tokens from t where file_id in (select file_id from c) group by file_id""")
def corpus_assembled(spark, folder):
    """A bundle of four files chosen by a seed."""
    return C.assembled(_whole(spark, folder), 4, 5).src.groupBy("file_id").agg(F.count(F.lit(1)).alias("tokens"))


@query(f"""with recursive {OWN}, x as (select file_id, sentence_id, count(*) as len from t where word is not null and sentence_id is not null group by all),
l as (select *, row_number() over (partition by file_id order by sentence_id) as n from x),
g as (select file_id, n, len, len as words, 0 as frame from l where n = 1
 union all select l.file_id, l.n, l.len, case when g.words + l.len >= 300 then l.len else g.words + l.len end, case when g.words + l.len >= 300 then g.frame + 1 else g.frame end from g join l on l.file_id = g.file_id and l.n = g.n + 1)
select file_id, frame, count(*) as sentences, sum(len) as words from g group by file_id, frame""")
def corpus_transfused(spark, folder):
    """The words of two corpora, in frames of fewer than 300 words inside each file."""
    out = C.transfused(_halves(spark, folder), lambda rows: rows.where("word is not null and sentence_id is not null"), 300)
    return out.groupBy("file_id", "frame").agg(F.count_distinct("sentence_id").alias("sentences"), F.count(F.lit(1)).alias("words"))


@query(f"""with {OWN}, p as (select distinct p.word_id, t.file_id from pymorphy p join t using (word_id))
select 'src' as part, file_id, count(*) as rows from t group by file_id union all select 'forms', file_id, count(*) from p group by file_id""")
def corpus_zip(spark, folder):
    """A corpus as a zip archive, read again."""
    own = _whole(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(f"{own.path.rpartition('/')[0]}/zip.zip")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, False)
    # Written straight to the shared folder, where all executors can read it, if that is on this machine; else brought there.
    if fs.getScheme() == "file":
        C.write_zip(own, target.toUri().getPath())
    else:
        with tempfile.TemporaryDirectory() as local:
            made = os.path.join(local, "whole.zip")
            C.write_zip(own, made)
            fs.copyFromLocalFile(True, True, path("file://" + made), target)
    out = None
    for part, df in (("src", own.src()), ("forms", own.frame("forms"))):
        rows = C.read_zip(spark, target.toString(), part, df.drop("bucket").schema).groupBy("file_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""with b as (select file_id, min(content) as content, coalesce(min(name), '?') as name from book where content is not null group by file_id)
select file_id || '-0' as file_id, md5(name) as header, 3 as token_count, cast(65 as bigint) as character_count from b""")
def folder_corpus(spark, folder):
    """A folder of text files read, parsed, tokenized and written as a corpus, with ids of a factory's making."""
    b = table(spark, folder, "book", "file_id", "name", "content").where("content is not null").groupBy("file_id").agg(F.min("content").alias("content"), F.coalesce(F.min("name"), F.lit("?")).alias("name"))
    text = F.concat(F.lit("# "), F.md5("name"), F.lit("\n\n"), F.md5("content"), F.lit("\n"), F.md5("file_id"), F.lit("."))
    own = _at(spark, folder, "from_folder")
    formats.write_markdown(b.select(F.concat("file_id", F.lit(".txt")).alias("filename"), text.alias("markdown")), f"{own.path}_texts")
    # Spark names the files in each folder; their parts are tags as well.
    names = ["file", *(f"part_{k}" for k in range(7))]
    made = F.concat_ws("-", F.regexp_replace(F.col("tags")["file"], "^file=|[.]md$", ""), "part_index")
    parsed = formats.read_markdown(spark, f"{own.path}_texts", names, ids=made)
    own.write(formats.markdown_tokens(parsed), parsed.select("file_id", "tags"), "overwrite")
    return own.toc().select("file_id", F.col("tags")["header_0"].alias("header"), F.col("token_count").cast("int").alias("token_count"), "character_count")


@query("""with w as (select unnest(['Была', 'весна', '.']) as word, unnest([0, 1, 2]) as word_id)
select 'text' as kind, word_id, word, word <> '.' as is_word from w union all select 'words', word_id, word, word <> '.' from w union all select 'frame', word_id, word, word <> '.' from w union all select 'bundle', word_id, word, word <> '.' from w""")
def bundles_of_anything(spark, folder):
    """A bundle of a text, of words, of a frame of texts, of a bundle; with a featurizer."""
    step = features.simple("kinds", lambda b: b["src"].select("file_id", "word_id", (F.col("word_type") != "punct").alias("is_word")))
    text = "Была весна."
    frame = spark.createDataFrame([("text", text)], "file_id string, text string")
    sources = {"text": text, "words": ["Была", "весна", "."], "frame": frame, "bundle": C.build_bundle(spark, frame)}
    out = None
    for kind, source in sources.items():
        b = C.build_bundle(spark, source, [step])
        own = b.src.join(b.kinds, ["file_id", "word_id"]).select(F.lit(kind).alias("kind"), "word_id", "word", "is_word")
        out = own if out is None else out.unionByName(own)
    return out


@query("""with f as (select file_id, min_by(tags, coalesce(tags['author_url'], '~')) as tags from toc where file_id is not null group by file_id), t as (select distinct file_id, word_id from src)
select file_id, count(*) as tokens from t join f using (file_id) where tags['author_url'] in (select distinct tags['author_url'] from f where tags['author_url'] is not null order by 1 limit 2) group by file_id""")
def files_by_tag(spark, folder):
    """Tokens of the files of two authors."""
    from ..operators import research

    own = _whole(spark, folder)
    values = [r.v for r in own.toc().select(F.col("tags")["author_url"].alias("v")).where("v is not null").distinct().orderBy("v").limit(2).collect()]
    return research.by_tag(own.src(), own.toc(), "author_url", *values).groupBy("file_id").agg(F.count(F.lit(1)).alias("tokens"))


@query("""with t as (select distinct word_id, file_id, word from src), k as (select distinct word_id from src where word is not null and length(word) > 7)
select 'src' as frame, count(*) as rows from t where word_id in (select word_id from k) union all select 'forms', count(*) from (select distinct word_id from pymorphy where word_id in (select word_id from k))""")
def restricted_bundle(spark, folder):
    """A bundle cut down to its long words, in each frame."""
    src = TK.clean(table(spark, folder, "src", "word_id", "file_id", "word"))
    forms = table(spark, folder, "pymorphy", "word_id", "pos").dropDuplicates(["word_id"])
    cut = sampling.restricted({"src": src, "forms": forms}, src.where("length(word) > 7"))
    out = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("frame"), "rows") for n, df in cut.items()]
    return out[0].unionByName(out[1])
