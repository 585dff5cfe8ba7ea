"""Groups of records that share an author, a source or another entity, and splits that keep them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# What stands in a field that names nothing.
PLACEHOLDERS = (
    "", "-", "--", "—", "–", ".", "?", "0", "нет", "none", "null", "nan", "n/a", "na", "no", "unknown", "anonymous", "anon", "undefined", "empty", "other",
    "неизвестно", "неизвестен", "неизвестный", "не указано", "не указан", "аноним", "анонимно", "без автора", "без названия", "отсутствует", "другое",
    "ориджинал", "ориджиналы", "original", "originals", "original work",
)
SECTIONS = ("avtor", "author", "authors", "book", "books", "collection", "collections", "user", "users", "fandom", "fandoms")

#: One in SEED_SHARE nodes seeds a search; ROUNDS hops are searched before what is left seeds itself.
SEED_SHARE, ROUNDS = 4, 2
#: A key is hot if it holds more than HOT rows and more than one in SHARES of all; so there are at most SHARES hot keys.
HOT, SHARES = 50_000, 4096


def _squeezed(c: Column) -> Column:
    """Lower case, no quotation marks, one ordinary blank between words."""
    bare = F.regexp_replace(c, "[«»\"“”„‟'‘’‹›`]", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[\\s\\u00a0\\u1680\\u2000-\\u200d\\u202f\\u205f\\u2060\\u3000\\ufeff]+", " "))


def name_key(c: Column) -> Column:
    """What a name stands for, however it is written; null if it names nothing."""
    k = _squeezed(c)
    return F.when(~k.isin(*PLACEHOLDERS), k)


def link_key(c: Column) -> Column:
    """The page a link leads to, however it is dressed (scheme, host, slashes, query, anchor, case); null if none."""
    k = F.regexp_replace(_squeezed(c), "[?#].*$", "")
    k = F.regexp_replace(k, "^([a-z][a-z0-9+.-]*:)?//[^/]*", "")
    k = F.regexp_replace(k, "^[a-z0-9-]+(\\.[a-z0-9-]+)+(:\\d+)?/", "")
    k = F.regexp_replace(F.regexp_replace(k, "/+", "/"), "^[/ ]+|[/ ]+$", "")
    last = F.element_at(F.split(k, "/"), -1)
    return F.when(~k.isin(*PLACEHOLDERS, *SECTIONS) & ~last.isin(*PLACEHOLDERS), k)


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key): the hot ones of counts (key, n), at most SHARES; None if there can be none among so many rows."""
    return cut(counts.where(F.col("n") > max(HOT, total // SHARES)).select(key)) if total > HOT else None


def meet(rows: DataFrame, key: str, side: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows joined with side by key (side has one row for each): the rows of hot keys stay where they are and are sent the
    side's rows of those keys, at most SHARES; all others meet by the key's hash."""
    if hot is None:
        return rows.join(side, key)
    # SHARES rows at most in each broadcast.
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(side, key)
    return rest.unionByName(rows.join(F.broadcast(side.join(F.broadcast(hot), key, "left_semi")), key).select(*rest.columns))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the connected components of an undirected graph; component = smallest seed label in it.

    nodes (node), edges (a, b), both strings; repeated rows, edges to oneself and edges to what is no node don't
    matter; a node without edges is its own component; null nodes are left out. Frontier search from many seeds at
    once over adjacency lists hash-partitioned by (node, neighbour), so that those of a hub are many: each reached node
    keeps the smallest label that reached it; what no seed reaches in ROUNDS hops seeds itself. Edges whose ends have
    different labels make the small graph of labels, which is merged by stars (each label's neighbours move to its
    smallest neighbour), a number of rounds in the order of the logarithm of its size. No list of neighbours and no
    component is ever held in one place: hubs meet their labels as `meet` says."""
    own = nodes.select("node").where("node is not null").distinct()
    both = edges.select("a", "b").where("a != b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    # Ends that are no nodes fall out where labels meet.
    both = cut(both)
    hubs = hot_keys(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", both.count())
    seeded = F.pmod(F.xxhash64("node"), F.lit(SEED_SHARE)) == 0
    labels = own.select("node", F.when(seeded, F.col("node")).alias("label"))
    frontier = labels.where("label is not null")
    for _ in range(ROUNDS):
        reached = meet(both, "a", frontier.withColumnRenamed("node", "a"), hubs).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("reached"))
        met = labels.join(reached, "node", "left")
        frontier = met.where("label is null and reached is not null").select("node", F.col("reached").alias("label"))
        labels = met.select("node", F.coalesce("label", "reached").alias("label"))
    labels = cut(labels.select("node", F.coalesce("label", "node").alias("label")))
    ends = meet(both.where("a > b"), "a", labels.toDF("a", "la"), hubs)
    ends = meet(ends, "b", labels.toDF("b", "lb"), hubs.toDF("b") if hubs is not None else None)
    small = ends.where("la != lb").select(F.greatest("la", "lb").alias("u"), F.least("la", "lb").alias("v")).distinct()
    roots = _stars(small)
    return labels.join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("component"))


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u -> (u, root): alternates large and small stars until nothing moves."""
    edges = cut(edges)
    mark = _mark(edges)
    while True:
        total = 2 * mark[0]
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        large = meet(sym, "u", least.select("u", F.least("u", "m").alias("m")), hot_keys(least, "u", total))
        large = large.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every edge now goes down, to a smaller label.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = meet(large, "u", low.select("u", "m"), hot_keys(low, "u", total))
        down = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(down)
        last, mark = mark, _mark(edges)
        if mark == last:
            return edges.groupBy("u").agg(F.min("v").alias("v"))


def _mark(edges: DataFrame) -> tuple:
    """Number and sum of hashes of the edges: two numbers that stay the same once nothing moves."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def file_edges(toc: DataFrame, relation: DataFrame) -> DataFrame:
    """(a, b): files and the pages, collections and fandoms their tags name, and related files.

    toc: file_id, tags; relation: file_1, file_2. Missing tags name nothing."""
    tag = lambda name, key: F.concat(F.lit(name + ":"), key(F.col("tags")[name]))
    named = toc.select("file_id", F.explode(F.array(tag("author_url", link_key), tag("collection_url", link_key), tag("fandom", name_key))).alias("value"))
    tagged = named.where("value is not null").select(F.concat(F.lit("file:"), "file_id").alias("a"), F.col("value").alias("b"))
    related = relation.select(F.concat(F.lit("file:"), "file_1").alias("a"), F.concat(F.lit("file:"), "file_2").alias("b"))
    return tagged.unionByName(related).where("a is not null and b is not null")


def file_groups(toc: DataFrame, relation: DataFrame) -> DataFrame:
    """(file_id, component, files): each file of toc, its group and the number of files in it."""
    edges = file_edges(toc, relation)
    files = toc.select(F.concat(F.lit("file:"), "file_id").alias("node"))
    values = edges.where("b not like 'file:%'").select(F.col("b").alias("node"))
    found = components(files.unionByName(values), edges).where("node like 'file:%'")
    found = cut(found.select(F.expr("substring(node, 6)").alias("file_id"), "component"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("files"))
    return found.join(sizes, "component").select("file_id", "component", "files")


def file_sentences(tokens: DataFrame) -> DataFrame:
    """(file_id, sentence_id), each once, null sentences left out; written once, as it is read several times."""
    return cut(tokens.select("file_id", "sentence_id").where("sentence_id is not null").distinct())


def grouped_sentences(tokens: DataFrame, toc: DataFrame, relation: DataFrame) -> DataFrame:
    """(sentence_id, group_id) of every sentence in a file that belongs with another one; group_id = the group's
    smallest sentence_id. Null sentence ids and files that toc doesn't list are left out."""
    groups = file_groups(toc, relation).where("files > 1")
    sentences = file_sentences(tokens)
    files = cut(sentences.groupBy("file_id").agg(F.min("sentence_id").alias("first"), F.count(F.lit(1)).alias("n")))
    held = groups.join(files, "file_id")
    ids = held.groupBy("component").agg(F.min("first").alias("group_id"))
    by_file = held.select("file_id", "component").join(ids, "component").select("file_id", "group_id")
    return meet(sentences, "file_id", by_file, hot_keys(files, "file_id", sentences.count())).select("sentence_id", "group_id").distinct()


def split_groups(groups: DataFrame, targets: list[tuple[str, float]], large: float = 0.01) -> DataFrame:
    """(component, split) for groups (component, weight), whole groups only, in the shares of `targets`.

    Groups of more than `large` of the weight (1 / large of them at most) go first, each to the split that misses most;
    the rest follow in the order of their hash, cut where the remaining shares are used up. The running sum is taken in
    two levels, over 4096 ranges of the hash and inside each, so no task sees all groups. Same input, same result."""
    total = groups.agg(F.sum("weight")).first()[0] or 0
    whole = sum(max(0.0, share or 0.0) for _, share in targets) or 1.0
    missing = {name: max(0.0, share or 0.0) / whole * total for name, share in sorted(targets)}
    big = groups.where(F.col("weight") > large * total).orderBy(F.desc("weight"), "component").collect()
    placed = []
    for row in big:
        name = max(missing, key=lambda k: (missing[k], k))
        missing[name] -= row.weight
        placed.append((row.component, name))
    spark = groups.sparkSession
    fixed = spark.createDataFrame(placed, "component string, split string")
    rest = groups.where(F.col("weight") <= large * total).withColumn("h", F.xxhash64("component"))
    rest = rest.withColumn("range", F.shiftrightunsigned("h", 52))
    ranges = rest.groupBy("range").agg(F.sum("weight").alias("sum"))
    before = ranges.withColumn("before", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("range").orderBy("h", "component")
    # 4096 rows at most.
    at = rest.join(F.broadcast(before.select("range", "before")), "range").withColumn("middle", F.col("before") + F.sum("weight").over(w) - F.col("weight") / 2)
    left = {k: max(0.0, v) for k, v in missing.items()}
    room, upto, pick = sum(left.values()) or 1.0, 0.0, None
    size = max(0.0, total - sum(r.weight for r in big))
    for name in left:
        upto += left[name] / room * size
        pick = F.when(F.col("middle") <= upto, name) if pick is None else pick.when(F.col("middle") <= upto, name)
    last = max(left, key=lambda k: (left[k], k)) if left else None
    return at.select("component", (pick.otherwise(last) if pick is not None else F.lit(None).cast("string")).alias("split")).unionByName(fixed)


def sentence_splits(tokens: DataFrame, toc: DataFrame, relation: DataFrame, targets: DataFrame) -> DataFrame:
    """(sentence_id, split): every sentence, its group's split. A file that toc doesn't list is a group of its own.

    targets: split, target_share; a handful of rows (they come to the driver), repeated rows count once."""
    sentences = file_sentences(tokens)
    groups = file_groups(toc, relation)
    sizes = sentences.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    files = cut(sizes.join(groups, "file_id", "left").select("file_id", "n", F.coalesce("component", F.concat(F.lit("file:"), "file_id")).alias("component")))
    shares = [(r.split, r.target_share) for r in targets.select("split", "target_share").where("split is not null").distinct().collect()]
    splits = split_groups(files.groupBy("component").agg(F.sum("n").alias("weight")), shares)
    by_file = files.select("file_id", "component").join(splits, "component").select("file_id", "split")
    return meet(sentences, "file_id", by_file, hot_keys(files, "file_id", sentences.count())).groupBy("sentence_id").agg(F.min("split").alias("split"))
