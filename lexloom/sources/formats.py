"""Text formats: pseudo-markdown with headers and tags, FB2, HTML pages, annotations, long plain texts."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import APOSTROPHES
from ..operators.packing import packs
from ..operators.tokens import tokenize

_APOSTROPHE = re.compile(f"(?<=[а-яА-ЯёЁ])[{APOSTROPHES}](?=[а-яА-ЯёЁ])")


class Headers:
    """The header state: a line is New (starts a block of text), Continue or Ignore.

    `#` x n sets the header of level n and drops deeper ones; headers of one level that follow one another are joined by
    ' / '; `$ {json}` replaces the tags. Blank lines between headers are ignored."""

    def __init__(self):
        self.stack: list[tuple[int, str]] = []
        self.tags: dict[str, object] = {}
        self.in_text = False

    def observe(self, line: str) -> str:
        s = line.strip()
        if m := re.match(r"(#+)\s*(.*)", s):
            level, text = len(m[1]), m[2].strip()
            if not self.in_text and self.stack and self.stack[-1][0] == level:
                self.stack[-1] = (level, self.stack[-1][1] + " / " + text)
            else:
                self.stack = [x for x in self.stack if x[0] < level] + [(level, text)]
            self.in_text = False
            return "Ignore"
        if s.startswith("$"):
            try:
                self.tags = dict(json.loads(s[1:]))
                self.in_text = False
                return "Ignore"
            except ValueError:
                pass
        if not s and not self.in_text:
            return "Ignore"
        new, self.in_text = not self.in_text, True
        return "New" if new else "Continue"

    def header_tags(self) -> dict[str, str]:
        """header_<place> and tag_<name>, as text."""
        out = {f"header_{i}": t for i, (_, t) in enumerate(self.stack)}
        return out | {f"tag_{k}": v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in self.tags.items()}


def clean_line(line: str) -> str:
    return _APOSTROPHE.sub("′", line.replace("\u00ad", ""))


def blocks(text: str) -> Iterator[tuple[list[str], dict[str, str]]]:
    """The blocks of text of a pseudo-markdown file with the headers and tags that stand over them."""
    h, lines, tags = Headers(), None, {}
    for line in text.split("\n"):
        line = clean_line(line)
        said = h.observe(line)
        if said == "Ignore":
            continue
        if said == "New":
            if lines is not None:
                yield lines, tags
            lines, tags = [], h.header_tags()
        lines.append(line)
    if lines is not None:
        yield lines, tags


def name_tags(path: str, schema: Sequence[str]) -> dict[str, str]:
    """Tags from a relative path: its folders, then the file's name up to the first dot, split at '-'."""
    *folders, name = path.split("/")
    tags = [*folders, *name.split(".")[0].split("-")]
    if len(tags) != len(schema):
        raise ValueError(f"the path {path} has {len(tags)} parts, the naming schema {len(schema)}")
    return dict(zip(schema, tags))


def parse_markdown(files: DataFrame, schema: Sequence[str], ids: Column | None = None) -> DataFrame:
    """(filename, part_index, file_id, tags map, text) of files (filename, text): one row per block. ids: how a block's id is made
    of the other columns, a hash of name and number if none is given."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, text in zip(part.filename, part.text):
                for k, (lines, tags) in enumerate(blocks(text or "")):
                    rows.append((name, k, tags | name_tags(name, schema), "\n".join(lines)))
            yield pd.DataFrame(rows, columns=["filename", "part_index", "tags", "text"])

    out = files.select("filename", "text").mapInPandas(run, "filename string, part_index int, tags map<string,string>, text string")
    return out.withColumn("file_id", ids if ids is not None else F.sha2(F.concat_ws("#", "filename", "part_index"), 256))


def read_markdown(spark: SparkSession, folder: str, schema: Sequence[str], take: int | None = None, ids: Column | None = None) -> DataFrame:
    """All text files under a folder, parsed; `take` limits the number of files (the first by name)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(folder)
    rel = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/")) + "/", "")
    files = raw.select(rel.alias("filename"), F.decode("content", "UTF-8").alias("text"))
    return parse_markdown(files.orderBy("filename").limit(take) if take else files, schema, ids)


def markdown_tokens(parsed: DataFrame, language: str = "ru") -> DataFrame:
    """The token table of parsed blocks, with file_id and filename."""
    return tokenize(parsed, "text", ["file_id", "filename"], language)


# FB2

# Elements that may nest around a block of text, what blocks there are, marks inside a block, and what is left out.
OUTER, CITED, INLINE, LEFT_OUT = ("section",), ("cite",), ("emphasis", "strong", "sup", "tail"), ("epigraph", "text-author")
BLOCKS = {"p": "newline", "poem/stanza/v": "newline", "title/p": "header", "subtitle": "header"}


def command(path: Column) -> Column:
    """What the path of an element means: newline, sameline, header, ignore or null.

    A block of text stands in the body, in any number of sections and perhaps a quotation. It begins a line or a header; marks
    inside it go on with its line. What stands outside the body, in a link, in an epigraph or is an author's name is left out."""
    steps = F.split(path, "/")
    body = (F.element_at(steps, 1) == "FictionBook") & F.coalesce(F.try_element_at(steps, F.lit(2)) == "body", F.lit(False))
    inner = _without_first(F.slice(steps, 3, F.size(steps)), OUTER, None)
    inner = _without_first(inner, CITED, 1)
    block = F.reverse(_without_first(F.reverse(inner), INLINE, None))
    marked = F.size(block) < F.size(inner)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in BLOCKS.items() for x in kv]), F.array_join(block, "/"))
    out = F.exists(steps, lambda x: x.startswith("a") | F.coalesce(x.startswith(LEFT_OUT[0]) | x.startswith(LEFT_OUT[1]), F.lit(False)))
    return F.when(body & kind.isNotNull(), F.when(marked, "sameline").otherwise(kind)).when(~body | out, "ignore")


def _without_first(steps: Column, names: Sequence[str], most: int | None) -> Column:
    """An array without the names it begins with, `most` of them at most."""
    other = F.array_position(F.transform(steps, lambda x: ~x.isin(*names)), True)
    count = F.when(other == 0, F.size(steps)).otherwise(other - 1).cast("int")
    count = count if most is None else F.least(count, F.lit(most))
    return F.slice(steps, count + 1, F.size(steps))


def _linear(element, path: str) -> Iterator[tuple[str, str | None]]:
    tag = element.tag.rpartition("}")[2] if isinstance(element.tag, str) else "comment"
    own = f"{path}/{tag}" if path else tag
    yield own, element.text
    for child in element:
        yield from _linear(child, own)
        name = child.tag.rpartition("}")[2] if isinstance(child.tag, str) else "comment"
        yield f"{own}/{name}/tail", child.tail


def read_fb2(files: DataFrame) -> DataFrame:
    """(filename, no, path, text) of FB2 files (path, content: the XML, or a zip with one .fb2): elements in order, the
    text behind an element as <element>/tail."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part.path, part.content):
                if content[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner = [n for n in z.namelist() if n.lower().endswith(".fb2")]
                        if len(inner) != 1:
                            raise ValueError(f"{name} holds {len(inner)} fb2 files")
                        content = z.read(inner[0])
                rows = list(_linear(ElementTree.fromstring(content), ""))
                yield pd.DataFrame({"filename": name, "no": range(len(rows)), "path": [r[0] for r in rows], "text": [r[1] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "filename string, no long, path string, text string")


def fb2_summary(records: DataFrame) -> DataFrame:
    """(path, command, is_empty, n): what paths there are; those with no command and text are not understood."""
    empty = ~F.coalesce("text", F.lit("")).rlike("\\S")
    return records.groupBy("path", command(F.col("path")).alias("command"), empty.alias("is_empty")).agg(F.count(F.lit(1)).alias("n"))


def fb2_uncovered(records: DataFrame) -> DataFrame:
    return fb2_summary(records).where("command is null and not is_empty")


def fb2_bodies(records: DataFrame) -> DataFrame:
    """(filename, body, title, length, place, size_place, suspicious): bodies by file; suspicious if there are more than
    two or the first isn't the longest."""
    body = F.sum((F.col("path") == "FictionBook/body").cast("int")).over(Window.partitionBy("filename").orderBy("no"))
    b = records.withColumn("body", body).where("body > 0").groupBy("filename", "body").agg(
        F.min_by("text", F.when(F.col("path").rlike("^FictionBook/body/title/p$"), F.col("no"))).alias("title"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("length")
    )
    f = Window.partitionBy("filename")
    b = b.withColumn("place", F.col("body") - 1).withColumn("size_place", F.row_number().over(f.orderBy(F.desc("length"), "body")) - 1).withColumn("bodies", F.count(F.lit(1)).over(f))
    return b.withColumn("suspicious", F.max((F.col("bodies") > 2) | (F.col("place") != F.col("size_place"))).over(f)).drop("bodies")


def fb2_markdown(records: DataFrame) -> DataFrame:
    """(filename, markdown): the first body as pseudo-markdown. Headers: one # more than the section's depth, at most
    four, one more for a subtitle. An error where text stands under a path that isn't understood."""
    r = records.withColumn("command", command(F.col("path"))).withColumn("body", F.sum((F.col("path") == "FictionBook/body").cast("int")).over(Window.partitionBy("filename").orderBy("no"))).where("body = 1")
    text = F.coalesce("text", F.lit(""))
    depth = F.least(F.size(F.regexp_extract_all("path", F.lit("/section"), F.lit(0))) + 1, F.lit(3))
    mark = F.concat(F.repeat(F.lit("#"), (depth + F.col("path").contains("/subtitle").cast("int") + 1).cast("int")), F.lit(" "))
    bad = F.col("command").isNull() & text.rlike("\\S")
    starts = F.col("command").isin("newline", "header")
    line = F.sum(starts.cast("int")).over(Window.partitionBy("filename").orderBy("no"))
    piece = F.when(bad, F.raise_error(F.concat(F.lit("not understood: "), "path"))).when(F.col("command") == "header", F.concat(mark, text)).when(F.col("command").isin("newline", "sameline"), text)
    lines = r.select("filename", "no", line.alias("line"), piece.alias("piece")).where("piece is not null")
    joined = lines.groupBy("filename", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "piece"))), lambda x: x["piece"]), "").alias("t")).where("t != ''")
    return joined.groupBy("filename").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n\n").alias("markdown"))


# HTML


class _Page(HTMLParser):
    """Paragraphs, headings (one level deeper) and quotations of a page as pseudo-markdown lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str]] = []
        self.tag, self.text, self.skip = None, "", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in ("p", "blockquote") or re.fullmatch("h[1-6]", tag):
            self._flush()
            self.tag = tag
        elif tag == "br" and self.tag:
            self.text += "\n"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == self.tag:
            self._flush()

    def handle_data(self, data):
        if self.tag and not self.skip:
            self.text += data

    def _flush(self):
        t = " ".join(self.text.split())
        if self.tag and t:
            self.lines.append((self.tag, "#" * (int(self.tag[1]) + 1) + " " + t if self.tag[0] == "h" else t))
        self.tag, self.text = None, ""


def html_markdown(page: str | None) -> str:
    p = _Page()
    p.feed(page or "")
    p._flush()
    while p.lines and p.lines[-1][0] != "p":
        p.lines.pop()
    return "\n\n".join(t for _, t in p.lines)


def pages_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    convert = F.pandas_udf(lambda s: s.map(html_markdown), "string")
    return pages.select(key, convert(html).alias("markdown"))


def links(html: Column, pattern: str = ".*") -> Column:
    """The targets of a page's links that match, in order, once each."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit("""href\\s*=\\s*["']([^"']*)["']"""), F.lit(1)), lambda u: u.rlike(pattern)))


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def mini_parts(text: str, size: int, delimiter: str | None = None, least: int = 11) -> list[str]:
    """A long text in parts: at chapter lines if a pattern is given, then at the last blank line (or line break) between
    `size` and twice that; parts of fewer than `least` characters are dropped."""
    chapters = re.split(delimiter, text, flags=re.M) if delimiter else [text]
    out = []
    for c in chapters:
        while len(c) > 2 * size:
            window = c[size : 2 * size]
            at = next((i for i in (window.rfind("\n\n"), window.rfind("\n"), window.rfind(" ")) if i >= 0), size - 1)
            out.append(c[: size + at])
            c = c[size + at :]
        out.append(c)
    return [p.strip() for p in out if len(p.strip()) >= least]


def split_texts(df: DataFrame, key: str, text: str, size: int, delimiter: str | None = None) -> DataFrame:
    """(key, part, text) in mini parts."""
    cut = F.pandas_udf(lambda s: s.map(lambda t: mini_parts(t or "", size, delimiter)), "array<string>")
    return df.select(key, F.posexplode(cut(text)).alias("part", "text"))


def without_brackets(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\([^()]*\\)|\\[[^\\[\\]]*\\]", ""), "[ \\t]{2,}", " "))


def packed_texts(df: DataFrame, group: Sequence[str], order: str, text: str, size: int) -> DataFrame:
    """(group, pack, text): texts joined greedily to packs; a pack closes with the text that takes it to `size` characters. The
    last, partial one is kept. `order` is unique; a group is packed in parallel (see packing)."""
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    held = df.select(*group, order, text, key.alias("_key"), F.length(text).alias("_n"))
    placed = packs(held, "_key", order, "_n", size, over=True)
    return held.join(placed, ["_key", order]).groupBy(*group, "pack").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("_t")))), lambda x: x["_t"]), "\n\n").alias(text))


def entity_spans(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, word_id, word, start, end, starts, ends): tokens with their places in the text and the number of annotated
    spans (key, start, end) that start or end with them."""
    t = tokenize(texts, "text", [key])
    w = Window.partitionBy(key).orderBy("word_id")
    # Line breaks count one character each between paragraphs; blanks follow words.
    size = F.col("word_length") + F.col("word_tail")
    breaks = F.col("paragraph_id")
    end = F.sum(size).over(w) - F.col("word_tail") + breaks
    t = t.withColumn("end", end).withColumn("start", F.col("end") - F.col("word_length"))
    s = spans.groupBy(key, "start").agg(F.count(F.lit(1)).alias("starts"))
    e = spans.groupBy(key, "end").agg(F.count(F.lit(1)).alias("ends"))
    return t.join(s, [key, "start"], "left").join(e, [key, "end"], "left").select(key, "word_id", "word", "start", "end", F.coalesce("starts", F.lit(0)).alias("starts"), F.coalesce("ends", F.lit(0)).alias("ends"))


# Text sinks and sources


def write_markdown(docs: DataFrame, path: str, name: str = "filename", text: str = "markdown") -> None:
    """Writes each text to a folder of its own under `path`, named like the file it comes from with .md for its ending; the
    tree of the sources is kept in the name."""
    target = F.concat(F.regexp_replace(name, "[.][^./]*$", ""), F.lit(".md"))
    docs.select(F.col(text).alias("value"), target.alias("file")).write.partitionBy("file").mode("overwrite").text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of what write_markdown wrote."""
    return spark.read.text(path, wholetext=True).select("file", F.regexp_replace("value", "\n$", "").alias("text"))


def read_csv_texts(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of CSV files (also .gz), with a header, quoted fields over several lines; `columns` is their schema. A .gz file is
    one task, as it can't be cut."""
    return spark.read.csv(path, schema=columns, header=True, multiLine=True, escape='"')


def read_json_lines(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of files with a JSON object per line; the schema is given, so no pass looks for it."""
    return spark.read.json(path, schema=columns)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): text files as a whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def span_sums(aligned: DataFrame, key: str) -> DataFrame:
    """(key, tokens, starts, ends, inside): of entity_spans, how many tokens begin, end and stand in annotated spans."""
    w = Window.partitionBy(key).orderBy("word_id")
    open_ = F.sum(F.col("starts") - F.coalesce(F.lag("ends").over(w), F.lit(0))).over(w)
    return aligned.withColumn("_open", open_).groupBy(key).agg(F.count(F.lit(1)).alias("tokens"), F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.count_if(F.col("_open") > 0).alias("inside"))


def page_fields(html: Column, marks: dict[str, str]) -> list[Column]:
    """Columns of a page: for each name the text of the first element whose opening tag holds the mark (an attribute)."""
    return [F.trim(F.regexp_extract(html, f"<[a-z0-9]+[^>]*{re.escape(mark)}[^>]*>([^<]*)<", 1)).alias(name) for name, mark in marks.items()]


def tagged_markdown(tags: Column, markdown: Column) -> Column:
    """A page's text with its tags (a map) in front as a line `$ {json}`."""
    return F.concat(F.lit("$ "), F.to_json(tags), F.lit("\n\n"), markdown)


def authors_of_size(works: DataFrame, author: str, size: str, least: int) -> DataFrame:
    """(author, works, size): authors whose works have at least so many characters together."""
    return works.groupBy(author).agg(F.count(F.lit(1)).alias("works"), F.sum(size).alias("size")).where(F.col("size") >= least)
