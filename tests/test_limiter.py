"""The adaptive limiter: its fold by hand and against a plain window, and a stream of several batches against the fold."""

import random
from datetime import datetime, timedelta, timezone

from planlark.streaming import limiter, streams


def test_fold_by_hand():
    f = limiter.Fold(limiter.Limits(at_once=4, requests=3, tokens=100, window_us=60_000_000, grow_after=2))
    s = 1_000_000
    assert f.call(0, 10, False, True) == (0, 0, False, 0, 4)
    assert f.call(10 * s, 20, True, True) == (1, 10, False, 0, 2)
    assert f.call(20 * s, 80, True, True) == (2, 30, False, 0, 1)
    assert f.call(30 * s, 0, True, True) == (3, 110, True, 30 * s, 1)  # never below one
    assert f.call(60 * s, 0, False, True) == (3, 100, True, 10 * s, 1)  # the first call has left the window
    assert f.call(61 * s, 0, False, False) == (4, 100, True, 9 * s, 1)  # not answered: does not count
    assert f.call(200 * s, 0, False, True) == (0, 0, False, 0, 2)
    assert [f.call(300 * s + i, 0, False, True)[-1] for i in range(6)] == [2, 3, 3, 4, 4, 4]


def test_stream_of_several_batches_equals_the_fold(spark, tmp_path):
    rng, begin = random.Random(1), datetime(2024, 1, 1, tzinfo=timezone.utc)
    calls = [(rng.choice("ab"), i, begin + timedelta(seconds=rng.randint(0, 900)), rng.choice((None, rng.randint(0, 50))), rng.choice((None, False, False, True)), rng.choice((None, True, False))) for i in range(300)]
    schema = "model string, id long, ts timestamp, tokens long, busy boolean, answered boolean"
    limits = limiter.Limits(at_once=8, requests=10, tokens=300, window_us=60_000_000, grow_after=3)
    for part in range(3):
        spark.createDataFrame([c for c in calls if c[1] % 3 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(m, -1, begin + timedelta(days=9), 0, False, False) for m in "ab"], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = limiter.limited(streams.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "model", limits, "1 day")
    put = lambda out, n: out.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))
    with limiter.rocksdb(spark):
        streams.drain(lambda: df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).foreachBatch(put).start())
    got = sorted((r.model, r.at, r.id, r.requests, r.tokens, r.full, r.wait_us, r.limit) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.id >= 0)
    want = []
    for m in "ab":
        fold = limiter.Fold(limits)
        for _, i, ts, tokens, busy, answered in sorted((c for c in calls if c[0] == m), key=lambda c: (c[2], c[1])):
            at = round((ts - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)
            want.append((m, at, i, *fold.call(at, tokens or 0, bool(busy), answered is not False)))
    assert got == sorted(want)
