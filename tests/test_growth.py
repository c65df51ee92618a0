"""What must not grow faster than the input: postings, texts that are parsed, rows that are moved, memory of a task."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from planlark import plans
from planlark.operators import geometry, relational, retrieval, text_index
from planlark.streaming import leases, limiter, streams


def test_texts_of_one_block_share_a_terms_posting(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "i"), 1)
    index.build(spark.createDataFrame([("s", i, "the red ring of " + "abc"[i % 3]) for i in range(300)], "scope string, id long, text string").coalesce(1))
    blocks = index.table("words").select("block").distinct().count()
    assert index.table("words").count() <= blocks * 9 < 300  # seven terms, the row of texts and the folder's row of nulls
    got = index.search(spark.createDataFrame([(1, '"red ring" -a'), (2, "ing of B")], "query_id int, text string"))
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(q, i) for q in (1, 2) for i in range(300) if i % 3 == 1 or (q == 1 and i % 3 == 2)]


def test_places_are_packed_in_bytes():
    texts = ["abcabc", "", "x" * 40_000 + "abc"]
    grams, places, firsts, starts = text_index.gram_postings(texts)
    ends = [*firsts[1:], len(places)]
    packed = text_index.packed(places, firsts).to_pylist()
    assert [text_index.unpacked(p).tolist() for p in packed] == [places[a:b].tolist() for a, b in zip(firsts, ends)]
    assert dict(zip(grams, map(text_index.unpacked, packed)))["abc"].tolist() == [0, 3, 10 + 40_000] and starts.tolist() == [0, 8, 10]
    assert sum(map(len, packed)) < 1.1 * len(places)


@pytest.mark.parametrize("name", ["label_values", "dual_consistency", "dual_label_readings"])
def test_each_label_is_read_once(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "__value" in plan and "Exchange RoundRobinPartitioning" in plan


def test_documents_meet_queries_by_their_rarest_word(spark, tmp_path):
    docs = spark.createDataFrame([(i, "common words here" + (" rare" if i < 3 else "")) for i in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Rare common words"), (2, "common unknown"), (3, "here words")], "id long, text string")
    found = retrieval.lexical_lane(docs, queries)
    got = sorted((r.query_id, r.doc_id) for r in found.collect())
    assert got == [(1, i) for i in range(3)] + [(3, i) for i in range(400)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rare#" in plan and plan.count("Join Inner") == 3


def test_a_task_gets_so_many_rows_whatever_the_table(spark, monkeypatch):
    monkeypatch.setattr(relational, "ROWS_A_TASK", 10)
    rows = spark.createDataFrame([(i % 40, i // 40, i // 40 + 1, i // 40, 0, 5) for i in range(200)], "line long, a long, b long, id long, s0 long, s1 long")
    found = geometry.assembly(rows, ["line"], "s0", "s1")
    assert "hashpartitioning(line" in (plan := found._jdf.queryExecution().toString()) and ", 20)" in plan
    assert {(r.members, r.state) for r in found.collect()} == {(5, "covered")}


@pytest.mark.parametrize("tolerance", [0, 1, 3])
def test_ticks_are_paired_as_sets(spark, tolerance):
    rng = random.Random(tolerance)
    sides = [sorted({(rng.randint(0, 1), rng.randint(0, 4), rng.randint(-20, 20)) for _ in range(60)}) for _ in range(2)]
    l, r = (spark.createDataFrame(s, "page int, row int, x int") for s in sides)
    got = {(x.page, x.l_row): (x.r_row, x.support) for x in geometry.pair_rows(l, r, ["page"], tolerance, 2).collect()}
    want = {}
    for p, row in {s[:2] for s in sides[0]}:
        support = {other: len({x for q, i, x in sides[0] if (q, i) == (p, row) and any((s, j) == (p, other) and abs(x - y) <= tolerance for s, j, y in sides[1])}) for q, other in {s[:2] for s in sides[1]} if q == p}
        best = min(((-n, other) for other, n in support.items() if n), default=None)
        if best:
            want[p, row] = (best[1], -best[0])
    assert got == want
    assert "count(distinct" not in geometry.pair_rows(l, r, ["page"], tolerance, 2)._jdf.queryExecution().toString()


@pytest.mark.parametrize("tolerance", [0, 2])
def test_lines_are_not_repeated_for_their_ends(spark, tolerance):
    rng = random.Random(tolerance)
    lines = [(rng.randint(0, 2), i, rng.randint(0, 12), x, x + rng.randint(0, 60)) for i in range(200) for x in [rng.randint(-90, 90)]]
    ticks = [(rng.randint(0, 2), rng.randint(-90, 150), y, y + 6) for _ in range(300) for y in [rng.randint(0, 6)]]
    found = geometry.dimension_lines(spark.createDataFrame(lines, "page int, id int, y int, x0 int, x1 int"), spark.createDataFrame(ticks, "page int, x int, y0 int, y1 int"), tolerance, 10)
    seen = lambda p, y, end: any(q == p and abs(x - end) <= tolerance and a <= y <= b for q, x, a, b in ticks)
    assert sorted(map(tuple, found.collect())) == sorted((p, i) for p, i, y, a, b in lines if b - a >= 10 and seen(p, y, a) and seen(p, y, b))
    assert "LeftSemi" in found._jdf.queryExecution().toString()


class Kept:
    """A processor's states in memory, and its timers."""

    def __init__(self):
        self.data, self.timers = {}, []
        self.exists, self.get = lambda: "one" in self.data, lambda: self.data.get("one", [])
        self.update = self.put = lambda v: self.data.update(one=v)
        self.appendList = lambda v: self.data.setdefault("one", []).extend(v)
        self.clear = self.data.clear
        self.containsKey, self.getValue, self.removeKey = self.data.__contains__, self.data.get, self.data.pop
        self.updateValue = lambda k, v: self.data.update({k: v})
        self.iterator = lambda: iter([*self.data.items()])
        self.getValueState = self.getListState = self.getMapState = lambda *_: Kept()
        self.registerTimer = self.timers.append


def test_waiting_calls_are_folded_slot_by_slot():
    limits, rng = limiter.Limits(at_once=8, requests=10, tokens=300, window_us=60_000_000, grow_after=3), random.Random(3)
    calls = [(rng.randrange(4 * limiter.SLOT_US), i, rng.randint(0, 50), rng.random() < 0.1, rng.random() < 0.8) for i in range(8000)]
    one, handle = limiter.Limiter(limits, "model"), Kept()
    one.init(handle)
    frame = lambda rows: pd.DataFrame(rows, columns=["at", "id", "tokens", "busy", "answered"])
    for part in range(2):
        assert [*one.handleInputRows(("a",), iter([frame(calls[i : i + 1000]) for i in range(part * 4000, part * 4000 + 4000, 1000)]), None)] == []
    got, most = [], 0
    for mark in (limiter.SLOT_US * 3 // 2, limiter.SLOT_US * 5):
        for out in one.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark // 1000), None):  # noqa: B023
            got, most = got + [*out.itertuples(index=False, name=None)], max(most, len(out))
    fold = limiter.Fold(limits)
    assert got == [("a", i, at, *fold.call(at, tokens, busy, answered)) for at, i, tokens, busy, answered in sorted(calls)]
    assert most < 2500 and len(handle.timers) == 3


def test_a_call_folds_a_bucket_of_keys(monkeypatch):
    monkeypatch.setattr(leases, "PACKED", 700)
    terms, rng = leases.Terms(batch=2, lease_us=50, most_refusals=2), random.Random(4)
    events = [(rng.choice((None, *map(str, range(300)))), rng.randint(0, 1000), i, rng.randrange(4), rng.randint(0, 3)) for i in range(6000)]
    one, handle, got = leases.Leases(terms, "box"), Kept(), []
    one.init(handle)
    for part in range(2):  # two batches of the stream, and the marks after them
        frames = [pd.DataFrame(events[i : i + 500], columns=leases.EVENTS.names) for i in range(part * 3000, part * 3000 + 3000, 500)]
        assert [*one.handleInputRows((7,), iter(frames), None)] == []
    assert len(one.coming.get()) < 12 and len(handle.timers) < 12
    for mark in (0, 1, 1, 5):
        for out in one.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None):  # noqa: B023
            got += out.itertuples(index=False, name=None)
        assert (mark == 0) == (not got)
    queues, want = {}, []
    for name, at, i, kind, entry in sorted(events, key=lambda e: e[1:]):
        want += [(name, i, at, *x) for x in queues.setdefault(name, leases.Queue(terms)).event(at, leases.KINDS[kind], entry)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x[3] for x in want} == {"claimed", "done", "refused", "abandoned", "late"}
    assert not one.first.exists() and not one.coming.exists()


def test_keys_are_dealt_into_a_bounded_number_of_states(spark, tmp_path):
    schema = "box long, id long, ts timestamp, kind string, entry long"
    found = leases.leased(streams.event_stream(spark, str(tmp_path), spark.createDataFrame([], schema).schema), "box", leases.Terms(1, 1), "1 day")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64(box" in plan and f"cast({leases.BUCKETS} as bigint)) AS bucket" in plan
    assert found.schema["box"].dataType.simpleString() == "bigint"
