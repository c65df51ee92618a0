"""Queues, state machines, windows and retention: batch forms, and Structured Streaming forms that agree with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Days that each class of record is kept.
KEEP_DAYS = {"original": 7 * 365, "render": 180, "crop": 365, "log": 90, "trace": 30}


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table (a file or a folder of parts) as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("recursiveFileLookup", True).parquet(path)


def drain(query_of: Callable[[], object], limit_s: int | None = None) -> None:
    """Run a stream over what is there now, and end."""
    q = query_of()
    if limit_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(limit_s):
        q.stop()
        raise TimeoutError("the stream has not ended")
    if q.exception():
        raise q.exception()


def oldest_first(outbox: DataFrame, batch: int) -> DataFrame:
    """The next rows of a queue. T1."""
    return outbox.filter("dispatched_at IS NULL AND abandoned_at IS NULL").orderBy("created_at", "id").limit(batch)


def attempt_state(attempts: DataFrame, key: str, most_refusals: int = 20) -> DataFrame:
    """(key, attempts, refusals, state): done, abandoned after too many refusals, else waiting. T2."""
    found = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if(F.col("result") == "refused").alias("refusals"), F.bool_or(F.col("result") == "done").alias("__done"))
    return found.select(key, "attempts", "refusals", F.when(F.col("__done"), "done").when(F.col("refusals") >= most_refusals, "abandoned").otherwise("waiting").alias("state"))


def once(stream: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Each key once, while its duplicates come within the watermark. T3."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def append_new(batch: DataFrame, sink: str, key: list[str], number: int) -> None:
    """foreachBatch sink with an exactly-once effect: each batch has its own folder, which a retry writes anew, and keys
    that other batches have put are left out. T3."""
    from pyspark.errors import AnalysisException
    from pyspark.sql.types import LongType, StructField, StructType

    try:
        known = batch.sparkSession.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(sink)
        batch = batch.join(known.filter(F.col("batch") != number).select(*key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # the first batch has no sink yet
            raise
    batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{sink}/batch={number}")


def stuck(rows: DataFrame, at: str, now: Column, minutes: int, done: Column) -> DataFrame:
    """Older than an interval and not done. T4."""
    return rows.filter(~done & (F.col(at) < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def stale_jobs(beats: DataFrame, job: str, at: str, now: Column, seconds: int) -> DataFrame:
    """Jobs whose last heartbeat is too old. T5."""
    last = beats.groupBy(job).agg(F.max(at).alias("last"))
    return last.withColumn("stale", F.col("last") < now - F.expr(f"INTERVAL {seconds} SECONDS"))


def tail(log: DataFrame, sequence: str, after: int, n: int) -> DataFrame:
    """T6."""
    return log.filter(F.col(sequence) > after).orderBy(sequence).limit(n)


def transitions(events: DataFrame, key: str, order: list[str], state: str, legal: set[tuple[str | None, str]]) -> DataFrame:
    """Each event with the state before it, and whether that step is legal. T7."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(state).over(w)
    name = F.concat_ws(">", F.coalesce(before, F.lit("-")), F.col(state))
    return events.withColumns({"before": before, "legal": name.isin(*[f"{a or '-'}>{b}" for a, b in sorted(legal, key=str)])})


def reading_times(events: DataFrame, key: str, order: list[str], at: str, state: str, start: str, handovers: tuple[str, ...], stops: tuple[str, ...], retryable: str) -> DataFrame:
    """(key, started_at, finished_at, outcome, duration_ms): from the first start to the handover or final stop; a
    retryable failure ends it unless work goes on. T8, W4.

    A final stop right after a retryable failure failed at that failure. One shuffle on the key: windows, then a fold of
    the last row that counts.
    """
    w = Window.partitionBy(key).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    final = F.col(state).isin(*handovers, *stops).cast("int")
    begun = events.withColumn("__on", F.max((F.col(state) == start).cast("int")).over(upto)).filter("__on = 1")
    live = begun.withColumn("__ended", F.coalesce(F.max(final).over(before), F.lit(0))).filter("__ended = 0")
    rows = live.withColumns({"__was": F.lag(state).over(w), "__then": F.lag(at).over(w)})
    place = F.struct(*order)
    last = rows.groupBy(key).agg(F.min_by(at, place).alias("started_at"), *[F.max_by(c, place).alias(f"__{k}") for k, c in enumerate((state, at, "__was", "__then"))])
    outcome = F.when(F.col("__0").isin(*handovers), "finished").when(F.col("__0").isin(retryable, *stops), "failed").otherwise("reading")
    stopped = F.col("__0").isin(*stops) & F.coalesce(F.col("__2") == retryable, F.lit(False))
    end = F.when(outcome != "reading", F.when(stopped, F.col("__3")).otherwise(F.col("__1")))
    took = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("long")
    return last.select(key, "started_at", end.alias("finished_at"), outcome.alias("outcome"), took.alias("duration_ms"))


def rate_window(events: DataFrame, key: list[str], at: str, seconds: int, *sums: str) -> DataFrame:
    """Requests and sums of the seconds up to each event. T9."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumns({"requests": F.count("*").over(w), **{f"{c}_in_window": F.sum(c).over(w) for c in sums}})


def concurrency(calls: DataFrame, key: str, order: list[str], busy: str, start: int = 8, most: int = 16) -> DataFrame:
    """(key, limit): halved when busy, one more after twenty good calls in a row. A fold over each key's ordered calls. T9."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, busy)))
    state = F.struct(F.lit(start).alias("limit"), F.lit(0).alias("good"))
    step = lambda s, c: F.when(c[busy], F.struct(F.greatest(F.lit(1), F.floor(s["limit"] / 2).cast("int")).alias("limit"), F.lit(0).alias("good"))).when(s["good"] >= 19, F.struct(F.least(F.lit(most), s["limit"] + 1).alias("limit"), F.lit(0).alias("good"))).otherwise(F.struct(s["limit"].alias("limit"), (s["good"] + 1).alias("good")))
    return calls.groupBy(key).agg(ordered.alias("__c")).select(key, F.aggregate("__c", state, step, lambda s: s["limit"]).alias("limit"))


def latest_states(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """How many keys are in each state now: max_by with partial sums, then a count. T10."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state)).groupBy(state).count()


def retention_due(rows: DataFrame, holds: DataFrame, key: str, kind: str, at: str, now: Column) -> DataFrame:
    """Rows past their class's age that no hold covers. T11."""
    days = F.element_at(F.create_map(*[F.lit(x) for kv in KEEP_DAYS.items() for x in kv]), F.col(kind))
    due = rows.filter(days.isNotNull() & (F.date_diff(F.to_date(now), F.to_date(at)) > days))
    return due.join(holds.select(key).distinct(), key, "left_anti")


def budget_state(spend: Column, ceiling: Column, near_percent: int = 80) -> Column:
    """T12."""
    return F.when(ceiling.isNull(), "UNLIMITED").when(spend >= ceiling, "EXHAUSTED").when(spend * 100 >= ceiling * near_percent, "APPROACHING").otherwise("AVAILABLE")


def nearest_ceiling(run: Column, project: Column, everyone: Column) -> Column:
    return F.coalesce(run, project, everyone)


def carried_forward(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Old answers for keys whose content has the same hash now. T14."""
    return new.join(old.withColumnRenamed(content, "__old"), key).filter(F.col("__old") == F.col(content)).drop("__old")


def live_counts(stream: DataFrame, key: str) -> DataFrame:
    """Events so far and the last state of each key, kept as state in Python per key. T5, T10."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, last = state.get if state.exists else (0, -1, "")
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["at", "state"]).iloc[-1]
            if (int(top["at"]), str(top["state"])) >= (at, last):
                at, last = int(top["at"]), str(top["state"])
        state.update((n, at, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "at": [at], "state": [last]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, at long, state string", "n long, at long, last string", "update", GroupStateTimeout.NoTimeout)


def windowed_usage(stream: DataFrame, at: str, window: str, keys: list[str], late: str, *aggs: Column) -> DataFrame:
    """Event-time windows with a watermark (an extension; the reports use days)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(*aggs)


def age(seconds: float) -> timedelta:
    if seconds <= 0:
        raise ValueError("a window must be positive")
    return timedelta(seconds=seconds)
