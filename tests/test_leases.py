"""The polling queue: its fold by hand, and a stream of several batches, one of which fails and runs again, against the fold."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from planlark.streaming import leases, limiter, streams

SCHEMA = "box string, id long, ts timestamp, kind string, entry long"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_fold_by_hand():
    q = leases.Queue(leases.Terms(batch=2, lease_us=100, most_refusals=2))
    assert [q.event(t, "put", e) for t, e in ((0, 7), (1, 5), (2, 6), (3, 7))] == [[]] * 4
    assert q.event(10, "poll", None) == [("claimed", 7, 1), ("claimed", 5, 1)]
    assert q.event(11, "poll", None) == [("claimed", 6, 1)]  # claimed ones are stepped over
    assert q.event(12, "poll", None) == []
    assert q.event(20, "done", 5) == [("done", 5, 1)]
    assert q.event(21, "done", 5) == [("late", 5, 0)]
    assert q.event(30, "refused", 6) == [("refused", 6, 1)]
    assert q.event(30, "poll", None) == [("claimed", 6, 2)]  # a refusal frees at once
    assert q.event(110, "refused", 7) == [("late", 7, 1)]  # its lease has ended
    assert q.event(110, "poll", None) == [("claimed", 7, 2)]
    assert q.event(129, "refused", 6) == [("abandoned", 6, 2)]
    assert q.event(500, "done", 7) == [("done", 7, 2)]  # done work is done, lease or not
    q.event(501, "put", 9)
    assert q.event(502, "done", 9) == [("late", 9, 0)] and list(q.waiting) == [9]  # never claimed


def run(df, out, marks, fail_at=None):
    def put(rows, n):
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if n == fail_at:
            raise RuntimeError("lost after the write, before the commit")

    with limiter.rocksdb(df.sparkSession):
        streams.drain(lambda: df.writeStream.outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start())


def test_a_batch_that_runs_again_loses_and_repeats_nothing(spark, tmp_path):
    rng, made = random.Random(2), []
    for i in range(400):
        kind = rng.choice(("put", "poll", "poll", "done", "refused", "refused", "other", None))
        made.append((rng.choice(("a", "b", None)), i, BEGIN + timedelta(seconds=rng.randint(0, 900)), kind, rng.choice((None, *range(6)))))
    folder = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame([e for e in made if e[1] % 3 == part], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for days in (3, 9):  # the first mark's batch folds, and the one after it
        spark.createDataFrame([("end", -days, BEGIN + timedelta(days=days), "poll", None)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    terms = leases.Terms(batch=2, lease_us=200_000_000, most_refusals=2)
    stream = streams.event_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    with pytest.raises(Exception, match="lost after the write"):
        run(leases.leased(stream, "box", terms, "1 day"), out, marks, fail_at=4)
    run(leases.leased(stream, "box", terms, "1 day"), out, marks)
    got = [(r.box, r.at, r.id, r.what, r.entry, r.attempt) for r in spark.read.parquet(out).collect() if r.box != "end"]
    want = []
    for box in ("a", "b", None):
        queue = leases.Queue(terms)
        for _, i, ts, kind, entry in sorted((e for e in made if e[0] == box), key=lambda e: (e[2], e[1])):
            if kind in leases.KINDS and (kind == "poll" or entry is not None):
                at = round((ts - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)
                want += [(box, at, i, *x) for x in queue.event(at, kind, entry)]
    assert {x[3] for x in want} == {"claimed", "done", "refused", "abandoned", "late"}
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    df = leases.leased(streams.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema), "box", leases.Terms(1, 1), "1 day")
    run(df, str(tmp_path / "out"), str(tmp_path / "marks"))
    assert not (tmp_path / "out").exists() or spark.read.parquet(str(tmp_path / "out")).count() == 0
