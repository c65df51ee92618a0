"""A model's adaptive limit as a stateful stream: a sliding window of requests and tokens, and calls at once that halve on a
busy answer and grow by one after enough good ones. T9.

Calls may come in any order inside the watermark: they wait in state until a timer says that the watermark has passed the
first of them; all that it has passed are then folded in the order of time and id, so the stream equals the fold over the whole table whatever the batches.
A model's state is its window, its waiting calls and two numbers. Calls wait as packed pieces by slots of time, and one slot is
read, folded and given out after the other, so a task's Python holds the calls of a slot and never a model's. The order of a model's calls decides its limit, so one
model is folded by one task at a time; a call costs constant time there, and models are dealt over all tasks.

Cases: a null answer is one that was given; null tokens are 0; a call that is later than the watermark is left out, as
Structured Streaming does; calls equal in time go by id; the last calls come out when a later one has moved the watermark.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that transformWithState asks for.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "id long, at long, requests long, tokens long, full boolean, wait_us long, limit int"


#: A waiting call; the time that a slot of them spans; and the calls that are packed at once.
CALL = np.dtype([("at", "<i8"), ("id", "<i8"), ("tokens", "<i8"), ("busy", "?"), ("answered", "?")])
SLOT_US = 6 * 3_600_000_000
PACKED = 100_000


@dataclass(frozen=True)
class Limits:
    at_once: int
    requests: int
    tokens: int
    window_us: int = 60_000_000
    grow_after: int = 20


class Fold:
    """The limiter's state, call by call."""

    def __init__(self, limits: Limits, limit: int | None = None, good: int = 0, window: list[tuple[int, int]] = ()):
        self.limits, self.limit, self.good = limits, limits.at_once if limit is None else limit, good
        self.window, self.tokens = deque(window), sum(t for _, t in window)

    def call(self, at: int, tokens: int, busy: bool, answered: bool) -> tuple[int, int, bool, int, int]:
        """What the call found (requests and tokens of the window, whether it is full, and how long until its oldest
        leaves), and the limit after it."""
        while self.window and at - self.window[0][0] >= self.limits.window_us:
            self.tokens -= self.window.popleft()[1]
        found = len(self.window), self.tokens
        full = found[0] >= self.limits.requests or found[1] >= self.limits.tokens
        wait = max(10_000, self.limits.window_us - (at - self.window[0][0])) if full and self.window else 0
        self.window.append((at, tokens))
        self.tokens += tokens
        if busy:
            self.limit, self.good = max(1, self.limit // 2), 0
        elif answered:
            self.good += 1
            if self.good >= self.limits.grow_after and self.limit < self.limits.at_once:
                self.limit, self.good = self.limit + 1, 0
        return *found, full, wait, self.limit


class Limiter(StatefulProcessor):
    """Keeps calls until the watermark has passed them, then folds them in order."""

    def __init__(self, limits: Limits, key: str):
        self.limits, self.key = limits, key

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "limit int, good int")
        self.window = handle.getListState("window", "at long, tokens long")
        self.waiting = handle.getMapState("waiting", "slot long, piece int", "calls binary")
        self.slots = handle.getMapState("slots", "slot long", "pieces int, first long")

    def wait(self, calls: np.ndarray) -> None:
        """Put calls into their slots, a piece each."""
        calls = calls[np.argsort(calls["at"], kind="stable")]
        slots, firsts = np.unique(calls["at"] // SLOT_US, return_index=True)
        for slot, some in zip(slots.tolist(), np.split(calls, firsts[1:]), strict=True):
            n, first = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else (0, int(some["at"][0]))
            self.waiting.updateValue((slot, n), (some.tobytes(),))
            self.slots.updateValue((slot,), (n + 1, min(first, int(some["at"][0]))))

    def taken(self, slot: int, pieces: int) -> np.ndarray:
        """The calls of a slot in order, which wait no longer."""
        calls = np.concatenate([np.frombuffer(self.waiting.getValue((slot, n))[0], dtype=CALL) for n in range(pieces)])
        for n in range(pieces):
            self.waiting.removeKey((slot, n))
        self.slots.removeKey((slot,))
        return calls[np.lexsort((calls["id"], calls["at"]))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, n, first = [], 0, None
        for batch in rows:
            calls = np.empty(len(batch), dtype=CALL)
            for c in CALL.names:
                calls[c] = batch[c].to_numpy()
            held, n = [*held, calls], n + len(calls)
            first = int(calls["at"].min()) if first is None else min(first, int(calls["at"].min()))
            if n >= PACKED:
                self.wait(np.concatenate(held))
                held, n = [], 0
        if held:
            self.wait(np.concatenate(held))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000  # all that the watermark has passed, whichever timer came first
        known = sorted((slot, *found) for (slot,), found in self.slots.iterator())
        due = [(slot, pieces) for slot, pieces, first in known if first < upto]
        if not due:
            return
        limit, good = tuple(self.now.get()) if self.now.exists() else (None, 0)
        fold = Fold(self.limits, limit, good, [tuple(w) for w in self.window.get()])
        later = [first for _, _, first in known if first >= upto]
        for slot, pieces in due:
            calls = self.taken(slot, pieces)
            here, rest = calls[calls["at"] < upto], calls[calls["at"] >= upto]
            if len(rest):
                self.wait(rest)
                later.append(int(rest["at"][0]))
            out = [(key[0], i, at, *fold.call(at, tokens, busy, answered)) for at, i, tokens, busy, answered in here.tolist()]
            yield pd.DataFrame(out, columns=[self.key, "id", "at", "requests", "tokens", "full", "wait_us", "limit"])
        self.now.update((fold.limit, fold.good))
        self.window.put(list(fold.window))
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which transformWithState asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def limited(calls: DataFrame, key: str, limits: Limits, late: str) -> DataFrame:
    """(key, id, at, requests, tokens, full, wait_us, limit) of a stream of calls: key, id, ts, tokens, busy, answered."""
    given = {"tokens": F.greatest(F.coalesce(F.col("tokens"), F.lit(0)), F.lit(0)).cast("long"), "busy": F.coalesce("busy", F.lit(False)), "answered": F.coalesce("answered", F.lit(True))}
    rows = calls.withWatermark("ts", late).select(key, "id", "ts", F.unix_micros("ts").alias("at"), *[v.alias(k) for k, v in given.items()])
    kind = calls.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Limiter(limits, key), f"{key} {kind}, {OUT}", "Append", "EventTime")
