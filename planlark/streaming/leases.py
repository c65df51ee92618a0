"""A polling queue as a stateful stream: polls claim the oldest free entries of their key for the time of a lease. T1.

Entries are put, claimed by polls, and answered. A claim that is not answered before its lease ends frees the entry, so the next
poll claims it again: every entry is handed out at least once, and its number of the attempt tells a repeat. ``done`` ends
an entry, ``refused`` frees it at once, and the last refusal that is allowed abandons it.

Events may come in any order inside the watermark: they wait in state until the watermark has passed them, and are then
folded in the order of time and id, so the stream equals the fold over the whole table whatever the batches. State and
watermark are committed with the batch, so a batch that runs again hands out the same entries under the same numbers. The
order holds inside a key (a package, say), never across keys. Keys are dealt by hash into BUCKETS, a state each, and buckets over all
tasks: a call of the processor costs some milliseconds, so it folds a bucket's keys, one after the other, and not one key. A bucket's
state is its keys' backlogs and its events that wait, as packed Arrow; both are read and written when some of its events are due.

Cases: an entry put again while it waits is one entry, and after its end a new one; an answer to an entry that is not
there or was never claimed is ``late`` and changes nothing, as is a refusal after the lease; ``done`` counts after it too,
since the work is; events without time, id or kind, of another kind, or without an entry where one is needed are left
out; events equal in time go by id; an event later than the watermark is left out, as Structured Streaming does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

KINDS = ("done", "poll", "put", "refused")
OUT = "id long, at long, what string, entry long, attempt int"

#: States that keys are dealt into, and the events that are packed at once.
BUCKETS, PACKED = 1024, 100_000
EVENTS = pa.schema([("key", pa.string()), ("at", pa.int64()), ("id", pa.int64()), ("kind", pa.int8()), ("entry", pa.int64())])
ENTRIES = pa.schema([("key", pa.string()), ("entry", pa.int64()), ("attempts", pa.int32()), ("refusals", pa.int32()), ("until", pa.int64())])


def packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def rows_of(table: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in table.columns), strict=True)


@dataclass(frozen=True)
class Terms:
    """Entries that a poll claims at most, how long it holds them, and the refusals that end an entry."""

    batch: int
    lease_us: int
    most_refusals: int = 20


class Queue:
    """Waiting entries in the order in which they were put: entry -> [attempts, refusals, end of the lease]."""

    def __init__(self, terms: Terms, waiting: list[tuple[int, int, int, int]] = ()):
        self.terms, self.waiting = terms, {entry: list(rest) for entry, *rest in waiting}

    def event(self, at: int, kind: str, entry: int | None) -> list[tuple[str, int, int]]:
        """What the event does, as (what, entry, attempt)."""
        if kind == "put":
            self.waiting.setdefault(entry, [0, 0, at])
            return []
        return self.poll(at) if kind == "poll" else [self.answer(at, kind, entry)]

    def poll(self, at: int) -> list[tuple[str, int, int]]:
        claimed = []
        for entry, found in self.waiting.items():
            if len(claimed) == self.terms.batch:
                break
            if found[2] <= at:
                found[0], found[2] = found[0] + 1, at + self.terms.lease_us
                claimed.append(("claimed", entry, found[0]))
        return claimed

    def answer(self, at: int, kind: str, entry: int) -> tuple[str, int, int]:
        found = self.waiting.get(entry)
        if found is None or not found[0] or (kind == "refused" and found[2] <= at):
            return "late", entry, found[0] if found else 0
        if kind == "refused":
            found[1], found[2] = found[1] + 1, at
            kind = "abandoned" if found[1] >= self.terms.most_refusals else kind
        if kind != "refused":
            del self.waiting[entry]
        return kind, entry, found[0]


class Leases(StatefulProcessor):
    """Keeps a bucket's events until the watermark has passed them, then folds them in order, key by key."""

    def __init__(self, terms: Terms, key: str):
        self.terms, self.key = terms, key

    def init(self, handle) -> None:
        self.handle = handle
        self.queues = handle.getValueState("queues", "entries binary")
        self.coming = handle.getListState("coming", "events binary")
        self.first = handle.getValueState("first", "at long")

    def wait(self, pieces: list[pa.Table]) -> None:
        """Put events to those that wait; the first of all has a timer."""
        events = pa.concat_tables(pieces)
        self.coming.appendList([(packed(events),)])
        at = pc.min(events["at"]).as_py()
        if not self.first.exists() or at < self.first.get()[0]:
            self.first.update((at,))
            self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in rows:
            held, n = [*held, pa.Table.from_pandas(batch[EVENTS.names], EVENTS, preserve_index=False)], n + len(batch)
            if n >= PACKED:
                self.wait(held)
                held, n = [], 0
        if held:
            self.wait(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000  # all that the watermark has passed, whichever timer came first
        if not self.first.exists() or self.first.get()[0] >= upto:
            return iter(())
        events = pa.concat_tables([unpacked(e[0]) for e in self.coming.get()])
        due, later = events.filter(pc.less(events["at"], upto)), events.filter(pc.greater_equal(events["at"], upto))
        queues: dict[str | None, Queue] = {}
        for name, *rest in rows_of(unpacked(self.queues.get()[0])) if self.queues.exists() else ():
            queues.setdefault(name, Queue(self.terms)).waiting[rest[0]] = rest[1:]
        out = []
        for name, at, i, kind, entry in rows_of(due.sort_by([(c, "ascending") for c in EVENTS.names])):
            queue = queues.get(name)
            if queue is None:
                queue = queues[name] = Queue(self.terms)
            out += [(name, i, at, *done) for done in queue.event(at, KINDS[kind], entry)]
        left = [(name, entry, *found) for name, queue in queues.items() for entry, found in queue.waiting.items()]
        if left:
            self.queues.update((packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*left), ENTRIES, strict=True)], schema=ENTRIES)),))  # noqa: B905
        else:
            self.queues.clear()
        self.coming.clear()
        self.first.clear()
        if len(later):
            self.wait([later])
        return iter((pd.DataFrame(out, columns=[self.key, "id", "at", "what", "entry", "attempt"]),) if out else ())

    def close(self) -> None:
        pass


def leased(events: DataFrame, key: str, terms: Terms, late: str) -> DataFrame:
    """(key, id, at, what, entry, attempt) of a stream of key, id, ts, kind, entry: a row for each claim and answer. A key is text, or
    of a type that text gives back (a number, a date). Start it inside limiter.rocksdb()."""
    whole = F.col("kind").isin(*KINDS) & F.col("id").isNotNull() & F.col("ts").isNotNull() & ((F.col("kind") == "poll") | F.col("entry").isNotNull())
    rows = events.filter(whole).withWatermark("ts", late)
    kind = F.array_position(F.lit([*KINDS]), F.col("kind")) - 1
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), "id", kind.cast("tinyint").alias("kind"), F.coalesce("entry", F.lit(0)).cast("long").alias("entry"))
    out = rows.groupBy("bucket").transformWithStateInPandas(Leases(terms, key), f"{key} string, {OUT}", "Append", "EventTime")
    return out.withColumn(key, F.col(key).cast(events.schema[key].dataType))
