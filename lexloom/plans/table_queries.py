"""Queries over plain tables: the relational idioms, logs, model evaluation, streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context
from ..operators import relational as R
from ..session import table
from ..streaming import ingest
from .registry import query


def _events(spark, folder):
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")


@query("select event_id, row_number() over (partition by user_id order by ts desc, event_id) - 1 as order_ from events")
def ordering(spark, folder):
    return R.ordering(_events(spark, folder), ["user_id"], [F.desc("ts"), "event_id"], "order_").select("event_id", "order_")


@query("with n as (select user_id, event_type, count(*) as n from events group by all) select user_id, event_type, round(n / sum(n) over (partition by user_id), 6) as fraction from n")
def fractions(spark, folder):
    return R.fractions(_events(spark, folder), ["user_id"], "event_type").withColumn("fraction", F.round("fraction", 6))


@query("select kind, lang, count(*) as count from documents group by all")
def count_by(spark, folder):
    return R.count_by(table(spark, folder, "documents", "kind", "lang"), "kind", "lang")


@query("select event_id, cast((row_number() over (partition by user_id order by event_id) - 1) // 7 as int) as chunk from events")
def chunk_numbers(spark, folder):
    return R.chunk_numbers(_events(spark, folder), ["user_id"], ["event_id"], 7).select("event_id", "chunk")


@query("select doc_id from documents where doc_id in (select doc_id from review_label)")
def semi_join(spark, folder):
    return R.keep(table(spark, folder, "documents", "doc_id"), table(spark, folder, "review_label", "doc_id"), ["doc_id"])


@query("select doc_id from documents where doc_id not in (select doc_id from review_label where doc_id is not null)")
def anti_join(spark, folder):
    return R.drop(table(spark, folder, "documents", "doc_id"), table(spark, folder, "review_label", "doc_id"), ["doc_id"])


@query("select d.doc_id, coalesce(l.n, 0) as n from documents d left join (select doc_id, count(*) as n from review_label group by 1) l on l.doc_id = d.doc_id")
def left_fill(spark, folder):
    l = table(spark, folder, "review_label", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return R.left_fill(table(spark, folder, "documents", "doc_id"), l, ["doc_id"], {"n": 0})


@query("""with a as (select distinct source from documents where source is not null), b as (select distinct source from mix_target)
select coalesce(a.source, b.source) as source, case when a.source is not null and b.source is not null then 'both' when a.source is not null then 'left' else 'right' end as side from a full join b on a.source = b.source""")
def outer_provenance(spark, folder):
    return R.outer_provenance(table(spark, folder, "documents", "source").where("source is not null").distinct(), table(spark, folder, "mix_target", "source").distinct(), ["source"])


@query("select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events")
def as_of(spark, folder):
    return R.as_of(_events(spark, folder), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "last_purchase")


@query("select event_id, case when event_id - b <= 500 then b end as reference from (select event_id, lag(event_id) over (partition by user_id, event_type order by event_id) as b from events)")
def previous_equal(spark, folder):
    return R.previous_equal(_events(spark, folder), ["user_id", "event_type"], "event_id", 500).select("event_id", "reference")


@query("select event_id, round(sum(value) over (partition by user_id order by event_id rows unbounded preceding), 4) as total from events")
def prefix_sum(spark, folder):
    return R.prefix_sum(_events(spark, folder), ["user_id"], ["event_id"], "value", "total").select("event_id", F.round("total", 4).alias("total"))


@query("select event_type, dense_rank() over (partition by event_type order by user_id) - 1 + 10 as user_id, event_id from events")
def dense_ids(spark, folder):
    return R.dense_ids(_events(spark, folder), ["event_type"], ["user_id"], 10).select("event_type", "user_id", "event_id")


@query("select doc_id as id, title, null as name from documents union all select book_id, null, name from book")
def concat_frames(spark, folder):
    return R.concat_frames(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "title"), table(spark, folder, "book").select(F.col("book_id").alias("id"), "name"))


@query("""select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'purchase') as purchase from events group by user_id""")
def wide_table(spark, folder):
    return R.wide(_events(spark, folder), ["user_id"], "event_type", ["click", "view", "purchase"], F.count(F.lit(1))).na.fill(0)


@query("""select doc_id, 'n_chars' as variable, n_chars::double as value from documents union all select doc_id, 'title_chars', length(title)::double from documents""")
def narrow_table(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "n_chars", "title").select("doc_id", F.col("n_chars").cast("double"), F.length("title").cast("double").alias("title_chars"))
    return R.narrow(d, ["doc_id"], ["n_chars", "title_chars"])


@query("select user_id, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events) where n = 1")
def arg_max(spark, folder):
    return R.arg_max(_events(spark, folder), ["user_id"], [F.desc("value"), "event_id"]).select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("""with w as (select user_id, count(*) filter (event_type = 'click')::double as click, count(*) filter (event_type = 'view')::double as view, count(*) filter (event_type = 'purchase')::double as purchase from events group by user_id)
select user_id, case greatest(click, view, purchase) when click then 'click' when view then 'view' else 'purchase' end as best, greatest(click, view, purchase) as best_value, click + view + purchase as best_sum from w""")
def row_best(spark, folder):
    w = R.wide(_events(spark, folder), ["user_id"], "event_type", ["click", "view", "purchase"], F.count(F.lit(1))).na.fill(0)
    return R.row_best(w, ["click", "view", "purchase"]).drop("click", "view", "purchase")


@query("""with x as (select event_id, event_type, array_to_string(list(event_type) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following), ',') as vicinity,
 count(*) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following) as n from events) select event_id, vicinity from x where event_type = 'purchase' and n = 5""")
def vicinity(spark, folder):
    return R.vicinity(_events(spark, folder), ["user_id"], ["ts", "event_id"], "event_type", 2, 2, F.col("event_type") == "purchase").select("event_id", F.array_join("vicinity", ",").alias("vicinity"))


@query("""select event_id, round(case when count(*) over w = 5 then avg(value) over w end, 5) as mean from events window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row)""")
def rolling_mean(spark, folder):
    return R.rolling_mean(_events(spark, folder), ["user_id"], ["ts", "event_id"], "value", 5, "mean").select("event_id", F.round("mean", 5).alias("mean"))


@query("select event_id, round((epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1e6, 3) as seconds from events")
def seconds_to_next(spark, folder):
    return R.seconds_to_next(_events(spark, folder), ["user_id"], ["ts", "event_id"], "ts", "seconds").select("event_id", F.round("seconds", 3).alias("seconds"))


@query("select user_id, arg_max(event_type, event_id) as event_type, round(arg_max(value, event_id), 6) as value from events group by user_id")
def latest(spark, folder):
    return R.latest(_events(spark, folder), ["user_id"], "event_id", "event_type", "value").withColumn("value", F.round("value", 6))


@query("select doc_id from documents order by md5('7:' || doc_id), doc_id limit 100")
def hashed_sample(spark, folder):
    return R.sampled(table(spark, folder, "documents", "doc_id"), "doc_id", 100, 7)


@query("""with a as (select distinct word_id from src), b as (select distinct word_id from pymorphy)
select 'without parse' as what, count(*) as n from (select * from a except select * from b) union all select 'both', count(*) from (select * from a intersect select * from b) union all select 'either', count(*) from (select * from a union select * from b)""")
def set_algebra(spark, folder):
    a, b = table(spark, folder, "src", "word_id").distinct(), table(spark, folder, "pymorphy", "word_id").distinct()
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one("without parse", a.subtract(b)).unionByName(one("both", a.intersect(b))).unionByName(one("either", a.union(b).distinct()))


# Logs and evaluation


@query("""with l as (select user_id, event_id, ts, value, cast(event_type = 'click' as int)::double as clicked from events), u as (select user_id, event_id, ts, 'value' as metric, value as v from l union all select user_id, event_id, ts, 'clicked', clicked from l)
select user_id, metric, round(arg_max(v, event_id), 5) as last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as seconds from u group by all""")
def log_table(spark, folder):
    e = _events(spark, folder).withColumn("clicked", (F.col("event_type") == "click").cast("double"))
    return context.log_table(e, "user_id", "event_id", "ts", ["value", "clicked"]).select("user_id", "metric", F.round("last", 5).alias("last"), F.round("seconds", 3).alias("seconds"))


LABELS = "l as (select doc_id, max(toxic) = 1 as toxic from review_label group by doc_id), d as (select doc_id, lang, kind, n_chars, toxic from documents join l using (doc_id))"


def _labelled(spark, folder):
    l = table(spark, folder, "review_label", "doc_id", "toxic").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    return table(spark, folder, "documents", "doc_id", "lang", "kind", "n_chars").join(l, "doc_id")


@query(f"""with {LABELS}, r as (select lang, toxic, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as r from d where n_chars is not null and toxic is not null),
s as (select lang, sum(r) filter (toxic) as rp, count(*) filter (toxic) as p, count(*) as n from r group by lang)
select lang, round((coalesce(rp, 0) - p * (p + 1) / 2.0) / nullif(p * (n - p), 0), 6) as auc from s""")
def auc_by_language(spark, folder):
    return context.auc(_labelled(spark, folder), ["lang"], "n_chars", "toxic").withColumn("auc", F.round("auc", 6))


@query(f"with {LABELS}, n as (select kind, count(*) as n from d group by kind) select kind, n, round(n / sum(n) over () * count(*) over (), 6) as weight from n")
def class_weights(spark, folder):
    return context.class_weights(_labelled(spark, folder), "kind").withColumn("weight", F.round("weight", 6))


REPORT = "c as (select coalesce(kind, '?') as truth, case when source = 'vestnik' then 'news' when source = 'forum' then 'post' when source = 'retell' then 'retell' else 'chapter' end as said from documents)"


def _report(spark, folder):
    s = F.col("source")
    return table(spark, folder, "documents", "kind", "source").select(F.coalesce("kind", F.lit("?")).alias("truth"), F.when(s == "vestnik", "news").when(s == "forum", "post").when(s == "retell", "retell").otherwise("chapter").alias("said"))


@query(f"""with {REPORT}, t as (select truth as label, count(*) as support, count(*) filter (truth = said) as hit from c group by 1), p as (select said as label, count(*) as said from c group by 1)
select label, support, round(hit / nullif(coalesce(said, 0), 0), 6) as precision, round(hit / support, 6) as recall, round(2 * hit / (coalesce(said, 0) + support), 6) as f1 from t left join p using (label)""")
def class_report(spark, folder):
    return context.class_report(_report(spark, folder), "truth", "said").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"with {REPORT} select truth, count(*) filter (said = 'chapter') as chapter, count(*) filter (said = 'news') as news, count(*) filter (said = 'post') as post, count(*) filter (said = 'retell') as retell from c group by truth")
def confusion_matrix(spark, folder):
    return context.confusion(_report(spark, folder), "truth", "said", ["chapter", "news", "post", "retell"])


@query(f"""with {REPORT}, s as (select truth, count(*) as rows, count(*) filter (truth <> said) as bad, count(*) filter (truth <> said) / count(*) as share from c group by truth)
select truth, rows, bad, round(share, 6) as share from s where share >= (select min(share) from (select share from s order by share desc limit 3))""")
def worst_classes(spark, folder):
    r = _report(spark, folder).withColumn("wrong", F.col("truth") != F.col("said"))
    return context.worst(r, "truth", "wrong", 3).withColumn("share", F.round("share", 6))


@query("""with w as (select user_id, max(event_type) as truth, count(*) filter (event_type = 'click')::double as click, count(*) filter (event_type = 'view')::double as view, count(*) filter (event_type = 'purchase')::double as purchase from events where event_type in ('click', 'view', 'purchase') group by user_id)
select user_id, case truth when 'click' then (view > click)::int + (purchase > click)::int when 'view' then (click >= view)::int + (purchase > view)::int else (click >= purchase)::int + (view >= purchase)::int end as rank from w""")
def true_class_rank(spark, folder):
    e = _events(spark, folder).where("event_type in ('click', 'view', 'purchase')")
    w = e.groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1)).cast("double")).na.fill(0.0).join(e.groupBy("user_id").agg(F.max("event_type").alias("truth")), "user_id")
    return context.true_class_rank(w, "user_id", "truth", ["click", "view", "purchase"])


@query("""with t as (select source from documents where source is not null group by source order by count(*) desc, source limit 5)
select doc_id, case when source in (select source from t) then source else 'OTHER' end as source from documents""")
def top_categories(spark, folder):
    return context.top_categories(table(spark, folder, "documents", "doc_id", "source"), "source", 5).select("doc_id", "source")


@query("select doc_id, (coalesce(kind, '') = 'news')::int as kind_news, (coalesce(kind, '') = 'post')::int as kind_post, round(ln(n_chars + 1), 6) as n_chars_log from documents")
def feature_columns(spark, folder):
    d = context.one_hot(table(spark, folder, "documents", "doc_id", "kind", "n_chars"), "kind", ["news", "post"])
    f = context.feature_columns(d, "doc_id", logs=["n_chars"], flags=["kind_news", "kind_post"])
    return f.withColumn("n_chars_log", F.round("n_chars_log", 6))


@query("select event_id, value is null as value_missing, round(coalesce(value, avg(value) over (partition by event_type)), 5) as value from events")
def imputed_values(spark, folder):
    return context.imputed(_events(spark, folder), "value", ["event_type"]).select("event_id", "value_missing", F.round("value", 5).alias("value"))


@query("select bin, count(*) as n from (select case when n_chars < 0 then 0 when n_chars >= 4000 then 9 else cast(floor(n_chars / 500.0) as bigint) + 1 end as bin from documents where n_chars is not null) group by bin")
def length_histogram(spark, folder):
    return context.histogram(table(spark, folder, "documents", "n_chars").where("n_chars is not null"), F.col("n_chars").cast("double"), 0.0, 4000.0, 8)


# Extension: what the streams compute, over a table


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, folder):
    return ingest.event_windows(_events(spark, folder), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("""with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from a)
select user_id, min(ts) as start, max(ts) + interval '30 minutes' as end_, count(*) as n from s group by user_id, s""")
def user_sessions(spark, folder):
    return ingest.sessions(_events(spark, folder), "ts", "user_id").withColumnRenamed("end", "end_")
