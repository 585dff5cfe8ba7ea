"""Corpora: a folder of Parquet datasets (toc, src, frame=<name>, relation, mapping) and zip exchange.

A corpus is read lazily as whole DataFrames with file_id; there is no loop over files. src and frames are written in
buckets of file_id, so that reading some files skips the rest.
"""

from __future__ import annotations

import io
import itertools
import shutil
import struct
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import tokens as TK
from ..operators.relational import numbered
from ..session import shuffles_dropped

RELATION = "file_1 string, file_2 string, relation_name string"
#: Rows of a bucket, and buckets at least; their number is a power of 2, so that it can be told from a file's hash whatever it is.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 5_000_000, 64, 1 << 20
#: Columns that a token table must have to be read as one.
NEEDED = {"file_id": "string", "word_id": "bigint", "sentence_id": "bigint", "paragraph_id": "bigint", "word": "string", "word_tail": "int", "word_type": "string"}


@dataclass(frozen=True)
class Bundle:
    """Frames about the same texts, and whatever is known about them besides."""

    frames: dict[str, DataFrame]
    info: dict[str, object] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.frames[name]
        except KeyError:
            raise AttributeError(f"no frame {name!r}; there are {', '.join(sorted(self.frames))}") from None

    def with_frames(self, **frames: DataFrame) -> Bundle:
        return Bundle(self.frames | frames, self.info)


def bucket_name(count: Column | str) -> Column:
    """The bucket of a file among so many: <count>-<number>."""
    n = F.col(count) if isinstance(count, str) else count
    return F.concat(n.cast("string"), F.lit("-"), F.pmod(F.xxhash64("file_id"), n).cast("string"))


def toc_of(src: DataFrame, timestamp: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row per file of a token table (file_id, filename), or of its `files` only: counts, part_index within the filename, ordinal, max_id."""
    stats = src.groupBy("file_id", "filename").agg(
        F.count(F.lit(1)).alias("token_count"), F.sum("word_length").cast("long").alias("character_count"), (F.greatest(*[F.max(c) for c in TK.ID_COLUMNS]) + 2).alias("max_id"), F.min("word_id").alias("_at")
    )
    stats = stats.join(files, "file_id", "left_semi") if files is not None else stats
    part = (F.row_number().over(Window.partitionBy("filename").orderBy("_at", "file_id")) - 1).cast("int")
    return stats.select("file_id", "filename", (timestamp if timestamp is not None else F.current_timestamp()).alias("written_at"), part.alias("part_index"), "token_count", "character_count", "max_id")


class Corpus:
    """A corpus folder. `name` is what its rows carry as corpus_id."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = name or self.path.rpartition("/")[2]

    # Reading

    def _has(self, part: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def toc(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/toc")

    def requested(self, uids: Sequence[str]) -> list[str]:
        """Those of the wanted files that there are, in the order they were asked for; an error if none is."""
        ids = self.spark.createDataFrame([(u,) for u in dict.fromkeys(uids)], "file_id string")
        have = {r.file_id for r in self.toc().join(ids, "file_id", "left_semi").select("file_id").collect()}
        out = [u for u in uids if u in have]
        if not out:
            raise ValueError("none of the requested files is in the corpus")
        return out

    def src(self, uids: Sequence[str] | DataFrame | None = None) -> DataFrame:
        """The tokens of the files, with corpus_id; an error if what is there is no token table. Files without tokens have no rows."""
        df = self.spark.read.parquet(f"{self.path}/src")
        kinds = dict(df.dtypes)
        wrong = [c for c, t in NEEDED.items() if kinds.get(c) != t]
        if wrong:
            raise ValueError(f"{self.path} holds no token table: {', '.join(wrong)} missing or of another type")
        return self._filtered(df, uids).withColumn("corpus_id", F.lit(self.name))

    def frame(self, name: str, uids: Sequence[str] | DataFrame | None = None) -> DataFrame:
        return self._filtered(self.spark.read.parquet(f"{self.path}/frame={name}"), uids)

    def _filtered(self, df: DataFrame, uids) -> DataFrame:
        if uids is None:
            return df
        if isinstance(uids, DataFrame):
            return df.join(uids.select("file_id").distinct(), "file_id", "left_semi")
        # The buckets that can hold the files, whatever their number was when they were written: others are not read.
        ids = self.spark.createDataFrame([(u,) for u in dict.fromkeys(uids)], "file_id string")
        if "bucket" not in df.columns:
            return df.where(F.col("file_id").isin(list(uids)))
        counts = F.expr(f"filter(transform(sequence(0, 20), k -> {LEAST_BUCKETS} * cast(pow(2, k) as int)), n -> n <= {MOST_BUCKETS})")
        names = ids.select(F.explode(counts).alias("n"), "file_id").select(bucket_name("n").alias("b")).distinct().collect()
        return df.where(F.col("bucket").isin([r.b for r in names]) & F.col("file_id").isin(list(uids)))

    def _parts(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return sorted(s.getPath().getName() for s in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root))

    def frame_names(self) -> list[str]:
        return [n[6:] for n in self._parts() if n.startswith("frame=")]

    def bundle(self, uids: Sequence[str] | None = None) -> Bundle:
        """src and all frames of the files, with their rows of the table of contents."""
        frames = {"src": self.src(uids)} | {n: self.frame(n, uids) for n in self.frame_names()}
        return Bundle(frames, {"toc": self._filtered(self.toc(), uids)})

    def grouped_src(self, requests: Sequence[Sequence[str]] | Sequence[dict[str, str]]) -> DataFrame:
        """The rows of several requests at once: request_no, name (of a dict's entries, else the place), and src.

        A file may be in several requests; files that don't exist are left out and shift nothing."""
        rows = []
        for no, r in enumerate(requests):
            if isinstance(r, dict):
                rows += [(no, k, v) for k, v in r.items()]
            elif isinstance(r, (list, tuple)):
                rows += [(no, str(k), v) for k, v in enumerate(r)]
            else:
                raise TypeError("a request is a list or a dict of file ids")
        wanted = self.spark.createDataFrame(rows, "request_no int, name string, file_id string")
        return wanted.join(self.src(wanted), "file_id")

    def relations(self) -> DataFrame:
        if not self._has("relation"):
            return self.spark.createDataFrame([], RELATION)
        return self.spark.read.parquet(f"{self.path}/relation")

    def mapping(self) -> DataFrame:
        """The first dataset whose name begins with mapping."""
        names = [n for n in self._parts() if n.startswith("mapping")]
        if not names:
            raise ValueError(f"{self.path} holds no mapping")
        return self.spark.read.parquet(f"{self.path}/{names[0]}")

    def subcorpus(self, name: str) -> DataFrame:
        """src of the files whose subcorpus_name is this; an error that lists the names if there are none."""
        files = self.toc().where(F.col("subcorpus_name") == name)
        if files.isEmpty():
            names = [r[0] for r in self.toc().select("subcorpus_name").where("subcorpus_name is not null").distinct().collect()]
            raise AttributeError(f"no subcorpus {name!r}; there are {', '.join(sorted(names))}")
        return self.src(files)

    def mapped(self, uids: Sequence[str], names: Sequence[str]) -> DataFrame:
        """For each file and relation name, src of the first related file (by id): request, relation_name and src.

        An error if one has no such relation."""
        wanted = self.spark.createDataFrame([(u, n) for u in uids for n in names], "file_1 string, relation_name string")
        edges = wanted.join(self.relations(), ["file_1", "relation_name"], "left").groupBy("file_1", "relation_name").agg(F.min("file_2").alias("file_id"))
        lost = edges.where("file_id is null").first()
        if lost:
            raise IndexError(f"{lost.file_1} has no relation {lost.relation_name}")
        return edges.withColumnRenamed("file_1", "request").join(self.src(edges), "file_id")

    # Writing

    def _staged(self, df: DataFrame) -> DataFrame:
        """df, written once beside the corpus as it comes, so that what follows doesn't work it out again; see _unstaged."""
        path = f"{self.path}/_staged/{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def _unstaged(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_staged")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _write(self, df: DataFrame, part: str, mode: str, buckets: int | None = None, rows: int | None = None) -> None:
        """With buckets: by bucket, each spread by its rows' place over as many tasks as it has shares of BUCKET_ROWS, so that
        neither a large bucket nor a large file is one task. buckets = 0: as many as the rows ask for. Rows are sorted, which makes
        the files smaller. rows: how many there are, if that is known; else df is written once to be counted."""
        if buckets is None:
            return df.write.mode(mode).parquet(f"{self.path}/{part}")
        staged = rows is None
        if staged:
            df = self._staged(df)
            rows = df.count()
        while buckets < LEAST_BUCKETS or buckets * BUCKET_ROWS < rows and buckets < MOST_BUCKETS:
            buckets = max(LEAST_BUCKETS, 2 * buckets)
        place = [c for c in ("word_id", "paragraph_id") if c in df.columns][:1]
        salt = F.pmod(F.xxhash64(*place), F.lit(max(1, rows // BUCKET_ROWS))) if place else F.lit(0)
        spread = df.withColumn("bucket", bucket_name(F.lit(buckets))).repartition("bucket", salt).sortWithinPartitions("bucket", "file_id", *place)
        with shuffles_dropped(self.spark):
            spread.write.partitionBy("bucket").mode(mode).option("compression", "zstd").parquet(f"{self.path}/{part}")
        if staged:
            self._unstaged()

    def write(self, src: DataFrame, tags: DataFrame | None = None, mode: str = "errorifexists", span: int = 10_000, buckets: int = 0, subcorpus: str | None = None) -> None:
        """Writes a token table (file_id, filename and tokens, ids as in each file) with fresh ids and its contents.

        mode: overwrite, append or errorifexists. New ids start `span` above the largest so far. tags: file_id, tags map.
        Files without tokens are not written."""
        if mode == "errorifexists" and self._has("src"):
            raise FileExistsError(f"{self.path} holds a corpus")
        old = self.toc().agg(F.max("max_id")).first()[0] if mode == "append" and self._has("toc") else None
        raw = self._staged(src)
        own = TK.fresh_ids(raw, "file_id", span, 0 if old is None else old + span, self._staged)
        self._write(own, "src", mode, buckets, raw.count())
        toc = toc_of(self.spark.read.parquet(f"{self.path}/src"), files=raw.select("file_id").distinct() if mode == "append" else None)
        toc = toc.join(tags.select("file_id", "tags"), "file_id", "left") if tags is not None else toc.withColumn("tags", F.lit(None).cast("map<string,string>"))
        first = self.toc().count() if old is not None else 0
        toc = numbered(toc.withColumn("subcorpus_name", F.lit(subcorpus).cast("string")), ["max_id", "file_id"], "ordinal")
        toc = toc.withColumn("ordinal", (F.col("ordinal") + first).cast("int"))
        self._write(toc, "toc", mode)
        self._unstaged()

    def write_frame(self, name: str, df: DataFrame, mode: str = "overwrite", buckets: int = 0, rows: int | None = None) -> None:
        """rows: how many there are, or at most, if that is known; else df is written once to be counted."""
        self._write(df, f"frame={name}", mode, buckets, rows)

    def replace_toc(self, toc: DataFrame) -> None:
        """Writes another table of contents; it may be made from the present one."""
        kept = f"{self.path}/_toc_new"
        toc.write.mode("overwrite").parquet(kept)
        self.spark.read.parquet(kept).write.mode("overwrite").parquet(f"{self.path}/toc")

    def write_mapping(self, mapping: DataFrame, name: str = "mapping") -> None:
        mapping.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def add_relation(self, relation: DataFrame) -> None:
        missing = {"file_1", "file_2", "relation_name"} - set(relation.columns)
        if missing:
            raise ValueError(f"a relation needs {', '.join(sorted(missing))}")
        relation.select("file_1", "file_2", "relation_name").write.mode("append").parquet(f"{self.path}/relation")

    def add_parallel(self, other: Corpus, subcorpus: str, relation: DataFrame | None = None) -> None:
        """Appends all files of another corpus as a subcorpus, with their tags, and relations to them."""
        toc = other.toc()
        src = other.src().drop("corpus_id", "bucket", "filename").join(toc.select("file_id", "filename"), "file_id")
        self.write(src, toc.select("file_id", "tags"), "append" if self._has("toc") else "errorifexists", subcorpus=subcorpus)
        if relation is not None:
            self.add_relation(relation)


def read_several(corpora: Sequence[Corpus]) -> DataFrame:
    """src of several corpora, told apart by corpus_id."""
    out = corpora[0].src()
    for c in corpora[1:]:
        out = out.unionByName(c.src(), allowMissingColumns=True)
    return out


def featurized(source: Corpus, target: Corpus, steps: Sequence, append: bool = True, black_list: Sequence[str] = ()) -> None:
    """Runs featurizers and predicates over a corpus and writes what comes out.

    A step is a featurizer (frames(bundle)) or a function of the bundle that gives a boolean per file (file_id, keep):
    files without keep are dropped. Files already in the target are skipped, so a broken run goes on where it ended."""
    bundle = source.bundle()
    src = bundle.src.where(~F.col("file_id").isin(list(black_list))) if black_list else bundle.src
    if append and target._has("src"):
        src = src.join(target.spark.read.parquet(f"{target.path}/src").select("file_id").distinct(), "file_id", "left_anti")
    bundle = bundle.with_frames(src=src)
    made: dict[str, DataFrame] = {}
    for step in steps:
        if hasattr(step, "frames"):
            new = step.frames(bundle.frames)
            made |= new
            bundle = bundle.with_frames(**new)
        else:
            keep = step(bundle).where("keep").select("file_id")
            bundle = bundle.with_frames(src=bundle.src.join(keep, "file_id", "left_semi"))
    files = bundle.src.select("file_id").distinct()
    mode = "append" if append else "overwrite"
    target._write(bundle.src.drop("corpus_id", "bucket"), "src", mode, 0)
    for name, df in made.items():
        own = df if "file_id" in df.columns else df.join(bundle.src.select("file_id", "word_id"), "word_id")
        target._write(own.join(files, "file_id", "left_semi"), f"frame={name}", mode, 0)
    target._write(source.toc().join(files, "file_id", "left_semi"), "toc", mode)


def assembled(corpus: Corpus, limit: int | None = None, seed: int | None = None) -> Bundle:
    """A bundle of the first (by ordinal) or, with a seed, of randomly chosen files."""
    if limit is None:
        return corpus.bundle()
    order = F.md5(F.concat(F.lit(f"{seed}:"), "file_id")) if seed is not None else F.col("ordinal")
    files = corpus.toc().orderBy(order, "file_id").limit(limit).select("file_id")
    return Bundle({"src": corpus.src(files)} | {n: corpus.frame(n, files) for n in corpus.frame_names()})


def transfused(sources: Sequence[Corpus], select: Callable[[DataFrame], DataFrame], words_per_frame: int = 50_000, words_limit: int | None = None) -> DataFrame:
    """Rows of all sources after `select` (a DataFrame to a DataFrame, with variant_no if it makes several of one), in
    frames of fewer than words_per_frame words inside each file; only the first files up to words_limit words in all."""
    rows = select(read_several(sources))
    if "variant_no" not in rows.columns:
        rows = rows.withColumn("variant_no", F.lit(0))
    record = F.concat_ws("/", "corpus_id", "file_id", F.col("variant_no").cast("string"))
    rows = rows.withColumn("record", record)
    if words_limit is not None:
        sizes = rows.groupBy("record").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.pmod(F.xxhash64("record"), F.lit(4096)))
        ranges = sizes.groupBy("range").agg(F.sum("n").alias("sum"))
        before = ranges.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))
        w = Window.partitionBy("range").orderBy("record")
        # 4096 rows.
        upto = sizes.join(F.broadcast(before), "range").withColumn("upto", F.col("before") + F.sum("n").over(w)).where(F.col("upto") <= words_limit)
        rows = rows.join(upto.select("record"), "record", "left_semi")
    return rows.join(TK.packed(rows, "record", words_per_frame), ["record", "sentence_id"])


# Zip exchange

#: Bytes of an archive that a reading task gets at least, those of a member that stay in memory, and rows that are decoded at once.
ZIP_SHARE, ZIP_MEMORY, ZIP_ROWS = 4 << 20, 32 << 20, 1 << 14
#: Rows of a row group of a member.
ZIP_GROUP = 1 << 17


def _ranged(path: str, mode: str = "rb"):
    """A file that can be read from any place, or a new one; on this machine's folders or any file system that Arrow knows."""
    if path.startswith(("/", "file:")):
        return open("/" + path.removeprefix("file:").lstrip("/"), mode)
    fs, own = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(own) if mode == "rb" else fs.open_output_stream(own)


def _reachable(path: str) -> bool:
    """Whether _ranged can open what lies on the file system of a path."""
    if path.startswith(("/", "file:")):
        return True
    try:
        return bool(pafs.FileSystem.from_uri(path))
    except (pa.ArrowException, OSError, ValueError):
        return False


def _member(f, info: dict) -> tempfile.SpooledTemporaryFile:
    """The content of a member, by its entry in the directory; an error if its checksum differs."""
    out = tempfile.SpooledTemporaryFile(ZIP_MEMORY)
    if info["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info["flags"] & 1:
        with zipfile.ZipFile(f) as z, z.open(info["name"]) as m:
            shutil.copyfileobj(m, out)
    else:
        f.seek(info["at"])
        head = f.read(30)
        f.seek(info["at"] + 30 + sum(struct.unpack("<HH", head[26:30])))
        d = zlib.decompressobj(-15) if info["method"] == zipfile.ZIP_DEFLATED else None
        left, crc = info["packed"], 0
        while left:
            b = f.read(min(left, 1 << 20))
            if not b:
                raise zipfile.BadZipFile(f"{info['name']} is cut off")
            left -= len(b)
            b = d.decompress(b) if d else b
            crc = zlib.crc32(b, crc)
            out.write(b)
        rest = d.flush() if d else b""
        out.write(rest)
        if head[:4] != b"PK\3\4" or zlib.crc32(rest, crc) != info["crc"]:
            raise zipfile.BadZipFile(f"{info['name']} is damaged")
    out.seek(0)
    return out


def _as_json(t: pa.Table, before: int) -> pa.Array:
    """Rows as JSON, with the index of a pandas frame if it was one; before: rows of the frame before these."""
    df = t.to_pandas(integer_object_nulls=True)
    if isinstance(df.index, pd.RangeIndex):
        df.index = pd.RangeIndex(before, before + len(df))
    text = df.reset_index().to_json(orient="records", lines=True, force_ascii=False, date_format="iso")
    return pa.array([r for r in text.split("\n") if r], pa.string())


def _directory(f, part: str) -> list[dict]:
    with zipfile.ZipFile(f) as z:
        own = [i for i in z.infolist() if i.filename.startswith(f"{part}/") or i.filename == f"{part}.parquet"]
    return [{"name": i.filename, "at": i.header_offset, "packed": i.compress_size, "method": i.compress_type, "flags": i.flag_bits, "crc": i.CRC} for i in own]


def read_zip(spark: SparkSession, paths: str, part: str = "src", schema: StructType | None = None) -> DataFrame:
    """The frames `part` of zipped corpora (members <part>/<uid>, or <part>.parquet) as one DataFrame of corpus_id, file_id and the
    rows: as JSON text, or, if a schema is given, its columns.

    Members are dealt out to tasks by their bytes, however few archives there are; a member is one task, which decodes it some
    rows at a time. Only where Arrow can't read a file system in places, each archive goes through one task's memory."""
    columns = [c for c in schema if c.name not in ("corpus_id", "file_id")] if schema is not None else [StructField("row", StringType())]
    own = StructType([StructField("corpus_id", StringType()), StructField("file_id", StringType()), *columns])
    arrow = to_arrow_schema(own)

    def rows(f, path: str, info: dict) -> Iterator[pa.RecordBatch]:
        name, before = info["name"], 0
        uid = name.partition("/")[2].rpartition(".")[0] or name.partition("/")[2]
        with _member(f, info) as m:
            p = pq.ParquetFile(m)
            for b in p.iter_batches(ZIP_ROWS):
                t = pa.Table.from_batches([b], p.schema_arrow)
                got = [t[c.name].combine_chunks().cast(arrow.field(c.name).type) for c in columns] if schema is not None else [_as_json(t, before)]
                before += len(b)
                yield pa.RecordBatch.from_arrays([pa.repeat(path.rpartition("/")[2], len(b)), pa.repeat(uid, len(b)), *got], schema=arrow)

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path in pdf.path:
                with _ranged(path) as f:
                    out = pd.DataFrame(_directory(f, part), columns=["name", "at", "packed", "method", "flags", "crc"])
                yield out.assign(path=path, share=out["packed"].cumsum() // ZIP_SHARE)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            for info in b.to_pylist():
                if info["path"] != path:
                    if f:
                        f.close()
                    path = info["path"]
                    f = _ranged(path)
                yield from rows(f, path, info)
        if f:
            f.close()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                f = io.BytesIO(r["content"])
                for info in _directory(f, part):
                    yield from rows(io.BytesIO(r["content"]), r["path"], info)

    files = spark.read.format("binaryFile").load(paths)
    sizes = files.select("path", "length").collect()
    if not all(_reachable(r.path) for r in sizes):
        return files.select("path", "content").mapInArrow(whole, own)
    tasks = max(1, min(sum(r.length for r in sizes) // ZIP_SHARE, 1 << 15))
    members = files.select("path").mapInPandas(listed, "path string, name string, at long, packed long, method int, flags int, crc long, share long")
    return members.repartition(tasks, "path", "share").sortWithinPartitions("path", "at").mapInArrow(some, own)


def write_zip(corpus: Corpus, path: str) -> None:
    """A zip archive of a corpus for exchange, in a file of the driver's: toc.parquet, relations.parquet and mapping.parquet if there
    are any, and for each file src/<file_id>.parquet and <frame>/<file_id>.parquet.

    Each task writes the members of its files to an archive of its own beside the corpus, some rows at a time; the driver appends their
    bytes as they are and notes where they are now. Only where Arrow can't write to the corpus' file system they come with the rows."""
    hadoop = corpus.spark._jvm.org.apache.hadoop.fs.Path(f"{corpus.path}/_zip_{uuid.uuid4().hex}")
    fs = hadoop.getFileSystem(corpus.spark._jsc.hadoopConfiguration())
    beside = fs.makeQualified(hadoop).toString()
    reachable = _reachable(beside)

    def packer(folder: str, constants: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with tempfile.SpooledTemporaryFile(ZIP_MEMORY) as f:
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    for uid, rows in itertools.groupby(_runs(batches), lambda x: x[0]):
                        _put(z, f"{folder}/{uid}.parquet", (b for _, b in rows), constants)
                    some = bool(z.namelist())
                if not some:
                    return
                f.seek(0)
                target = f"{beside}/{uuid.uuid4().hex}"
                if reachable:
                    with _ranged(target, "wb") as out:
                        shutil.copyfileobj(f, out, 1 << 20)
                yield pa.RecordBatch.from_pydict({"path": [target], "content": [None if reachable else f.read()]}, pa.schema({"path": pa.string(), "content": pa.binary()}))

        return run

    fs.mkdirs(hadoop)
    try:
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:

            def put(name: str, df: DataFrame) -> None:
                b = io.BytesIO()
                df.toPandas().to_parquet(b)
                z.writestr(name, b.getvalue())

            put("toc.parquet", corpus.toc())
            if corpus._has("relation"):
                put("relations.parquet", corpus.relations())
            if any(n.startswith("mapping") for n in corpus._parts()):
                put("mapping.parquet", corpus.mapping())
            for folder, df in [("src", corpus.src()), *((n, corpus.frame(n)) for n in corpus.frame_names())]:
                own = {"corpus_id": corpus.name} if folder == "src" else {}
                place = [c for c in ("word_id", "paragraph_id") if c in df.columns][:1]
                sorted_ = df.drop("bucket", *own).repartition("file_id").sortWithinPartitions("file_id", *place)
                with shuffles_dropped(corpus.spark):
                    made = sorted_.mapInArrow(packer(folder, own), "path string, content binary")
                    for r in made.collect() if reachable else made.toLocalIterator():
                        with _ranged(r.path) if reachable else io.BytesIO(r.content) as f:
                            _append(z, f)
                        if reachable:
                            fs.delete(corpus.spark._jvm.org.apache.hadoop.fs.Path(r.path), False)
    finally:
        fs.delete(hadoop, True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows that are sorted by file_id, cut where it changes."""
    for b in batches:
        if len(b):
            runs = pc.run_end_encode(b.column("file_id"))
            at = 0
            for uid, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                yield uid, b.slice(at, end - at)
                at = end


def _put(z: zipfile.ZipFile, name: str, batches: Iterator[pa.RecordBatch], constants: dict[str, str]) -> None:
    """A member that holds the rows, written in groups."""

    def group(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        for c, value in constants.items():
            t = t.append_column(c, pa.repeat(value, len(t)))
        return t

    with z.open(name, "w", force_zip64=True) as m:
        writer, held, n = None, [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                n += len(b)
            if held and (b is None or n >= ZIP_GROUP):
                t = group(held)
                writer = writer or pq.ParquetWriter(m, t.schema, compression="zstd")
                writer.write_table(t)
                held, n = [], 0
        writer.close()


def _append(z: zipfile.ZipFile, f) -> None:
    """Appends the members of an archive to one that is being written, as the bytes they are."""
    with zipfile.ZipFile(f) as other:
        own, left = other.infolist(), other.start_dir
    f.seek(0)
    z.fp.seek(z.start_dir)
    while left:
        b = f.read(min(left, 1 << 20))
        left -= z.fp.write(b)
    for i in own:
        i.header_offset += z.start_dir
        z.NameToInfo[i.filename] = i
    z.filelist.extend(own)
    z.start_dir = z.fp.tell()


# From texts to bundles


def build_bundle(spark: SparkSession, source: object, featurizers: Sequence = (), language: str = "ru") -> Bundle:
    """A bundle of whatever there is: a text, a list of words, a token table or frame of texts (file_id, text), or a bundle;
    with the frames of the featurizers, each of which sees those of the ones before."""
    if isinstance(source, Bundle):
        bundle = source
    elif isinstance(source, str):
        bundle = Bundle({"src": TK.tokenize(spark.createDataFrame([("text", source)], "file_id string, text string"), "text", ["file_id"], language)})
    elif isinstance(source, (list, tuple)):
        bundle = Bundle({"src": TK.from_words(spark.createDataFrame([("text", list(source))], "file_id string, words array<string>"), "words", ["file_id"], language)})
    elif isinstance(source, DataFrame):
        bundle = Bundle({"src": source if "word_id" in source.columns else TK.tokenize(source, "text", ["file_id"], language)})
    else:
        raise TypeError("a bundle is built of a text, a list of words, a DataFrame or a bundle")
    for f in featurizers:
        bundle = bundle.with_frames(**f.frames(bundle.frames))
    return bundle
