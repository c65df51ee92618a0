"""Streaming queries, run over what is there now, and the batch queries that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlark.plans.registry import query
from planlark.plans.reports import cents
from planlark.sources.io import table
from planlark.streaming import leases, limiter
from planlark.streaming import streams as T


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="planlark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.event_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)


@query("""
    SELECT event_type, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type""")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage kept by a stream; each batch replaces the whole small result (complete mode)."""
    out, marks = scratch(spark, "usage"), scratch(spark, "marks")
    g = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(cents("value")).alias("cents"))
    put = lambda df, _: df.write.mode("overwrite").parquet(out)
    T.drain(lambda: g.writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start())
    return spark.read.parquet(out)


@query("""
    SELECT user_id, event_type, 1 AS kept FROM events GROUP BY user_id, event_type""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key although events repeat and batches may run again: watermarked dedup, then an anti join on
    what the sink already has."""
    out, marks = scratch(spark, "dedup"), scratch(spark, "marks")
    keyed = events(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    put = lambda df, n: T.append_new(df.drop("at"), out, ["user_id", "event_type"], n)
    T.drain(lambda: T.once(keyed, ["user_id", "event_type"], "at", "2 days").writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start())
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count("*").alias("kept"))


@query("""
    SELECT user_id, count(*) AS n, arg_max(event_type, (epoch_us(ts), event_type)) AS state FROM events GROUP BY user_id""")
def stream_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom state per key (events so far, and the last state); the newest row of each key is the answer."""
    out, marks = scratch(spark, "live"), scratch(spark, "marks")
    e = events(spark, sf_dir).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("state"))
    put = lambda df, _: df.write.mode("append").parquet(out)
    T.drain(lambda: T.live_counts(e, "user_id").writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start())
    return spark.read.parquet(out).groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("state", "n").alias("state"))


@query("""
    SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS day_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows with a watermark, kept whole in complete mode, each batch over the last."""
    out, marks = scratch(spark, "windows"), scratch(spark, "marks")
    e = events(spark, sf_dir).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    put = lambda df, _: df.write.mode("overwrite").parquet(out)
    g = T.windowed_usage(e, "ts", "1 day", ["event_type"], "1 hour", F.count("*").alias("n"))
    T.drain(lambda: g.writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start())
    return spark.read.parquet(out).select(F.unix_seconds("window.start").alias("day_start"), "event_type", "n")


LIMITS = limiter.Limits(at_once=16, requests=8, tokens=60_000, window_us=6 * 3_600_000_000, grow_after=5)


@query("""
    WITH RECURSIVE c AS (SELECT event_type AS model, event_id AS id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS tokens, value > 80 AS busy, user_id % 4 <> 0 AS answered, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT *, count(*) OVER r - count(*) OVER p AS requests, CAST(sum(tokens) OVER r - sum(tokens) OVER p AS BIGINT) AS used, min(t) OVER r AS oldest FROM c
        WINDOW r AS (PARTITION BY model ORDER BY t RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW), p AS (PARTITION BY model, t ORDER BY id DESC)),
    f AS (SELECT model, CAST(0 AS BIGINT) AS k, 16 AS lim, 0 AS good FROM c GROUP BY model
        UNION ALL SELECT f.model, c.k, CASE WHEN c.busy THEN greatest(1, f.lim // 2) WHEN c.answered AND f.good >= 4 AND f.lim < 16 THEN f.lim + 1 ELSE f.lim END,
            CASE WHEN c.busy THEN 0 WHEN NOT c.answered THEN f.good WHEN f.good >= 4 AND f.lim < 16 THEN 0 ELSE f.good + 1 END FROM f JOIN c ON c.model = f.model AND c.k = f.k + 1)
    SELECT w.model, w.id, w.t AS at, w.requests, w.used AS tokens, w.requests >= 8 OR w.used >= 60000 AS full, CASE WHEN w.requests > 0 AND (w.requests >= 8 OR w.used >= 60000) THEN greatest(10000, 21600000000 - (w.t - w.oldest)) ELSE 0 END AS wait_us, CAST(f.lim AS INTEGER) AS limit
    FROM w JOIN f ON f.model = w.model AND f.k = w.k""")
def stream_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call's window and the adaptive limit after it, by a stream whose calls come in two files, out of order; a
    last mark for each model moves the watermark past all calls."""
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("model"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), cents("value").alias("tokens"), (F.col("value") > 80).alias("busy"), (F.col("user_id") % 4 != 0).alias("answered"))
    folder, out, marks = scratch(spark, "calls"), scratch(spark, "limits"), scratch(spark, "marks")
    first = F.xxhash64("id") % 2 == 0
    calls.filter(first).coalesce(1).write.parquet(folder)
    calls.filter(~first).coalesce(1).write.mode("append").parquet(folder)
    ends = calls.groupBy("model").agg(F.max("ts").alias("ts")).select("model", F.lit(-1).cast("long").alias("id"), (F.col("ts") + F.expr("INTERVAL 80 DAYS")).alias("ts"), F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("busy"), F.lit(False).alias("answered"))
    ends.coalesce(1).write.mode("append").parquet(folder)
    stream = T.event_stream(spark, folder, calls.schema)
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    with limiter.rocksdb(spark):
        T.drain(lambda: limiter.limited(stream, "model", LIMITS, "40 days").writeStream.outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start())
    return spark.read.parquet(out).filter("id >= 0").drop("batch")


TERMS = leases.Terms(batch=4, lease_us=36 * 3_600_000_000, most_refusals=2)


@query("""
    WITH RECURSIVE k AS (SELECT user_id, event_id AS id, ts, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'put' WHEN 'click' THEN 'done' WHEN 'error' THEN 'refused' ELSE 'poll' END AS kind FROM events),
    p AS (SELECT *, CASE WHEN kind = 'put' THEN id ELSE last_value(CASE WHEN kind = 'put' THEN id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, id) END AS entry FROM k),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM p WHERE kind = 'poll' OR entry IS NOT NULL),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(e BIGINT, a INTEGER, r INTEGER, u BIGINT)[]) AS q, CAST([] AS STRUCT(what VARCHAR, e BIGINT, a INTEGER)[]) AS o FROM c GROUP BY user_id
        UNION ALL SELECT user_id, n,
            CASE WHEN kind = 'put' THEN CASE WHEN has THEN q ELSE list_append(q, {'e': entry, 'a': 0, 'r': 0, 'u': t}) END
                WHEN kind = 'poll' THEN list_transform(q, lambda x: CASE WHEN list_contains(free, x.e) THEN {'e': x.e, 'a': x.a + 1, 'r': x.r, 'u': t + 129600000000} ELSE x END)
                WHEN len(hit) = 0 THEN q WHEN kind = 'done' OR hit[1].r >= 1 THEN list_filter(q, lambda x: x.e <> entry)
                ELSE list_transform(q, lambda x: CASE WHEN x.e = entry THEN {'e': x.e, 'a': x.a, 'r': x.r + 1, 'u': t} ELSE x END) END,
            CASE WHEN kind = 'put' THEN [] WHEN kind = 'poll' THEN list_transform(list_filter(q, lambda x: list_contains(free, x.e)), lambda x: {'what': 'claimed', 'e': x.e, 'a': x.a + 1})
                WHEN len(hit) = 0 THEN [{'what': 'late', 'e': entry, 'a': 0}]
                ELSE [{'what': CASE WHEN kind = 'done' THEN 'done' WHEN hit[1].r >= 1 THEN 'abandoned' ELSE 'refused' END, 'e': entry, 'a': hit[1].a}] END
        FROM (SELECT f.user_id, c.n, c.t, c.kind, c.entry, f.q, list_transform(list_filter(f.q, lambda x: x.u <= c.t)[1:4], lambda x: x.e) AS free, len(list_filter(f.q, lambda x: x.e = c.entry)) > 0 AS has,
            list_filter(f.q, lambda x: x.e = c.entry AND x.a > 0 AND (c.kind = 'done' OR x.u > c.t)) AS hit FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1)),
    rows AS (SELECT user_id, n, unnest(o) AS x FROM f)
    SELECT r.user_id, c.id, c.t AS at, r.x.what AS what, r.x.e AS entry, CASE WHEN r.x.what = 'late' THEN NULL ELSE r.x.a END AS attempt FROM rows r JOIN c ON c.user_id = r.user_id AND c.n = r.n""")
def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's entries (signups) claimed by polls (views and purchases), done (clicks) or refused (errors), by a stream whose
    events come in two halves, out of order, each of as many files as tasks wrote; a mark of a user that no one has moves the watermark past
    all events."""
    kind = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "click", "done").when(F.col("event_type") == "error", "refused").otherwise("poll")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    before = Window.partitionBy("user_id").orderBy("ts", "id")
    put = F.last(F.when(F.col("kind") == "put", F.col("id")), ignorenulls=True).over(before)
    asked = e.withColumn("entry", F.when(F.col("kind") != "poll", put))
    folder, out, marks = scratch(spark, "queue"), scratch(spark, "leases"), scratch(spark, "marks")
    first = F.xxhash64("id") % 2 == 0
    asked.filter(first).write.parquet(folder)
    files = len(spark.read.schema(asked.schema).option("recursiveFileLookup", True).parquet(folder).inputFiles())
    asked.filter(~first).write.mode("append").parquet(folder)
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("id"), (F.col("ts") + F.expr("INTERVAL 80 DAYS")).alias("ts"), F.lit("poll").alias("kind"), F.lit(None).cast("long").alias("entry"))
    end.coalesce(1).write.mode("append").parquet(folder)
    stream = T.event_stream(spark, folder, asked.schema, max(1, files))
    put_batch = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    with limiter.rocksdb(spark):
        T.drain(lambda: leases.leased(stream, "user_id", TERMS, "40 days").writeStream.outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put_batch).start())
    return spark.read.parquet(out).drop("batch").withColumn("attempt", F.when(F.col("what") != "late", F.col("attempt")))
