"""Whole jobs: every vector has its neighbours, every pair that nothing removes is listed, long labels are read."""

import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from planlark import plans
from planlark.functions import labels as L
from planlark.functions import long_labels
from planlark.operators import links
from planlark.operators import retrieval as X
from planlark.plans import geometry, tracker


def dot_cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in (*a, *b) or not any(a) or not any(b):
        return None
    return math.floor(abs(c := np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))) * 1e6 + 0.5) / 1e6 * (1 if c >= 0 else -1)


@pytest.mark.parametrize("block", [7, 2048])
def test_every_vector_has_its_neighbours(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    rng = random.Random(1)
    made = lambda: rng.choice([None, [1.0, None, 0.0], [0.0, 0.0, 0.0], [1.0, 2.0], *[[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(8)]])
    rows = [(i * 3 + 1, made(), rng.choice([1, 1, 1, 2, None])) for i in range(80)]
    pq.write_table(pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}), tmp_path / "embeddings.parquet")
    got = sorted((r.left_id, r["rank"], r.right_id, r.score) for r in plans.QUERIES["dense_topk"](spark, str(tmp_path)).collect())
    want = []
    for i, v, scope in rows:
        pairs = sorted(((s is None, -(s or 0.0), j, s) for j, w, t in rows if t == scope is not None and j != i for s in [dot_cosine(v, w)]))
        want += [(i, k + 1, p[2], p[3]) for k, p in enumerate(pairs[:5])]
    assert got == sorted(want, key=lambda x: x[:2]) and len({g[0] for g in got}) > 50


def test_pairs_that_agree_on_nothing_are_listed(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice(["x", "y", None]), rng.choice(["t", "u", None])) for i in range(60)]
    pq.write_table(pa.Table.from_pylist([dict(zip(("p_partkey", "p_brand", "p_size", "p_name", "p_type"), r, strict=True)) for r in rows]), tmp_path / "part.parquet")
    got = sorted((r.left_id, r.right_id, r.score) for r in plans.QUERIES["metadata_lane"](spark, str(tmp_path)).collect())
    agree = lambda x, y: x is not None and x == y
    want = [(a[0], b[0], (3 * agree(a[2], b[2]) + 2 * agree(a[3], b[3])) / 5) for a in rows for b in rows if a != b and agree(a[1], b[1]) and (a[4] is None or b[4] is None or a[4] == b[4])]
    assert got == sorted(want) and {g[2] for g in got} == {0.0, 0.4, 0.6, 1.0}
    sql = connect_part(tmp_path).execute(plans.ORACLE_SQL["metadata_lane"]).fetchall()
    assert sorted((a, b, s) for a, b, s in sql) == got


def connect_part(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet')")
    return con


def exact(v):
    return v and Fraction(v["num"], v["den"])


def labels_read(spark, texts):
    v = F.col("t")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", L.parse_inches(v).alias("said"), L.plain_dimension(v).alias("plain"), L.plain_dimension(v, True).alias("worded"), L.pair(v).alias("pair"), L.pair(v, True).alias("words"), L.expand_label(v).alias("sum"), L.beyond(v).alias("beyond"))
    expanded = lambda x: x and (exact(x["value"]), x.how, [exact(p) for p in x.parts], x.shares)
    return {r.t: (exact(r.said), exact(r.plain), exact(r.worded), r["pair"] and tuple(r["pair"]), r.words and tuple(r.words), expanded(r["sum"]), r.beyond) for r in rows.orderBy("i").collect()}


def test_labels_of_many_digits_are_read(spark):
    got = labels_read(spark, ['12 1/2"+13 1/4"+14 3/8"', "1234.95 [48 5/8]", '123456789 1/2"', '24.0000000000000000000000000"', "1234567890123\'-6\"", '99999999999999999999"', '100000 1/2"(12 EQ)', "12345678901", "000000610 [24]", '123456789" VIF', None])
    tops = {t: (g[0], g[1], g[5] and g[5][0], g[6]) for t, g in got.items()}
    assert tops == {
        '12 1/2"+13 1/4"+14 3/8"': (None, None, Fraction(321, 8), None), "1234.95 [48 5/8]": (Fraction(389, 8), Fraction(389, 8), None, None), '123456789 1/2"': (Fraction(246913579, 2),) * 2 + (None, None),
        '24.0000000000000000000000000"': (24, 24, None, None), "1234567890123'-6\"": (14814814681482,) * 2 + (None, None), '99999999999999999999"': (None, None, None, "beyond_64_bits"),
        '100000 1/2"(12 EQ)': (None, None, Fraction(200001, 2), None), "12345678901": (None,) * 4, "000000610 [24]": (24, 24, None, None), '123456789" VIF': (None,) * 4, None: (None,) * 4,
    }
    assert got["1234.95 [48 5/8]"][3] == ("48 5/8", None) and got['100000 1/2"(12 EQ)'][5] == (Fraction(200001, 2), "equal-shares", [Fraction(200001, 2)], 12)


def test_long_and_short_labels_follow_the_same_rules(spark):
    rng = random.Random(6)
    pieces = ["1", "2", "24", "610", "635", "25", "3/8", "1/2", "5/4", "3/5", "0", "1/0", " ", " ", "-", "'", '"', "''", "+", ".", "[", "]", "(", ")", " EQ)", "mm", " MM", "in", " inches", "ft", "yd", "½", "1⁄4", "”", "′", "filler", " VIF", "/", "a", "\t", "eq"]
    whole = ["14 3/8\"", "648 [25 1/2]", "25\" [635]", "305 mm [12]", "12\" [305MM]", "36\"(3 EQ)", "5'-0\"", "2' - 10 1/2", "3\"+4 1/2\" Filler", "610 [24-3/4]", "24.25 in", "[24.5]", "5’ 6″", "7 ft", "25.4mm", "30 1/2\" (VIF)", "10 1/2\" (a) (b)"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(700)] + [w[:i] + rng.choice(pieces) + w[i + rng.randint(0, 1) :] for w in whole for _ in range(25) for i in [rng.randint(0, len(w))]] + whole
    texts = [t for t in dict.fromkeys(texts) if sum(c in "0123456789" for c in t) <= L.MOST_DIGITS]
    X_ = long_labels
    own = {t: (X_.parse_inches(t), X_.plain_dimension(t, False), X_.plain_dimension(t, True), X_.pair(t, False), X_.pair(t, True), X_.expand_label(t), None) for t in texts}
    got = labels_read(spark, texts)
    assert {t: (got[t], own[t]) for t in texts if got[t] != own[t]} == {}
    assert sum(any(x is not None for x in v) for v in own.values()) > 80


def test_fusion_of_a_group_is_ranked_in_arrays(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 2, None]), rng.choice([None, *range(-6, 7)])) for i in rng.sample(range(-50, 400), 150)]
    df = spark.createDataFrame(rows, "id long, g int, a long").withColumn("number", F.col("id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        found = X.fused_by_nearness(df, "g", ["a", "number"], lambda left, right: (left + right) % 10 == 0, tasks=3)
        got = sorted((r.left_id, r["rank"], r.right_id, r.score) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for i, g, a in rows:
        others = [(j, abs(a - b) if a is not None is not b else math.inf) for j, h, b in rows if h == g is not None and j != i]
        one = {j: n for n, (j, _) in enumerate(sorted(others, key=lambda x: (x[1], x[0])), 1)}
        two = {j: n for n, (j, _) in enumerate(sorted(others, key=lambda x: (abs(i - x[0]), x[0])), 1)}
        scores = sorted((-math.floor((1 / (60 + one[j]) + 1 / (60 + two[j])) * 1e9 + 0.5), j) for j in one if (i + j) % 10)
        want += [(i, n, j, -s / 1e9) for n, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want)
    plan = plans.QUERIES["rrf_fusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 1 and "MapInArrow" in plan and "Join" not in plan


def test_pairs_of_boxes_are_made_last(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geometry, "LISTED", 7)
    rng = random.Random(7)
    rows = [(1000 * (i // 40) + i % 40, rng.choice([5, 60, 400])) for i in range(1200)]
    pq.write_table(pa.table({"p_partkey": [r[0] for r in rows], "p_size": pa.array([r[1] for r in rows], pa.int32())}), tmp_path / "part.parquet")
    found = plans.QUERIES["box_iou"](spark, str(tmp_path))
    got = sorted(map(tuple, found.select("l_id", "r_id", "common", "joined", "good").collect()))
    sql = connect_part(tmp_path).execute(f"SELECT l_id, r_id, common, joined, good FROM ({plans.ORACLE_SQL['box_iou']})").fetchall()
    assert got == sorted(sql) and len(got) > 5000
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins, made = ([i for i, x in enumerate(plan) if word in x] for word in ("Join Inner", "Generate explode(l_ids"))
    assert made and max(made) < min(joins)


@pytest.mark.parametrize("name", ["job_tracker_items", "job_tracker_rounds"])
def test_lines_are_moved_three_times(spark, name):
    """By order, by package for the fold, by package after it; rows are short and written nowhere between."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moves) == 4 and "tracked-" not in plan and "sightings-" not in plan  # the fourth moves the orders


@pytest.mark.parametrize("call", [1, 30, 100_000])
def test_packages_of_a_stream_are_folded_whole(spark, monkeypatch, call):
    rng = random.Random(9)
    sets = [(p, [(100 * p + i, f"w{rng.randint(0, 2)}") for i in range(rng.randint(1, 12))]) for p in range(40)]
    rows = [(sid, p, sid, sid, 1, sid, False, 1, 1, "", None, w, False, None, 0.0, 0.0, 0.0, 0.0, i + 1) for p, held in sets for i, (sid, w) in enumerate(held)]
    names = [*links.FOLDED, "__place"]
    monkeypatch.setattr(links, "CALL", call)
    stream = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows]).to_batches(max_chunksize=7)
    got = {s: (i, k) for b in links.folded_packages(iter(stream), ["package"]) for s, i, k in zip(*(b.column(c).to_pylist() for c in ("sid", "item", "package")), strict=True)}
    assert got == {sid: (min(s for s, v in held if v == w), p) for p, held in sets for sid, w in held}


def test_what_a_line_says_fits_one_number(spark, tmp_path):
    """Odd values and nulls come back from ``said`` as they went in."""
    from datetime import datetime

    rng, day = random.Random(8), datetime(1996, 1, 1)
    odd = lambda *v: rng.choice([None, *v])
    rows = [(i // 7, i % 7 + 1, odd(-7, 0, 179, 1234, -361), odd(-5, 4, 59, 60, 997), odd(-3.0, 1.0, 45.0, 46.0, 50.0), odd(0.0, 0.02, 0.09, 0.5), odd(-0.05, 0.0, 0.01, 0.04, 0.07, 0.3), odd("A", "N", "R", "X"), odd("F", "O"), day) for i in range(700)]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k % 5, day) for k in range(100)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.answer, r.place): r for r in tracker.described(tracker.lines(spark, str(tmp_path))).collect()}
    rest = lambda v, n: None if v is None else int(math.fmod(v, n))
    for r in rows:
        x = dict(zip(names, r, strict=True))
        g, pk, sk, q, disc, tax = got[x["l_orderkey"], x["l_linenumber"]], x["l_partkey"], x["l_suppkey"], x["l_quantity"], x["l_discount"], x["l_tax"]
        folded = False if x["l_linenumber"] == 1 else None if disc is None else disc >= 0.09
        assert g.folded == folded and (g.page, g.stated_round) == (rest(sk, 4) or None, rest(q, 3) or None)
        assert g.decided_by == (None if sk is None else f"person {rest(sk, 3)}") and g.words == (None if pk is None and x["l_linenumber"] < 7 else "" if x["l_linenumber"] == 7 else f"k{rest(pk, 9)}")
        own = folded is False
        assert g.decision == (None if not own or q is None or q < 46 else "not_a_problem" if pk is not None and pk % 2 == 0 else "agreed")
        assert g.record == (f"r{rest(pk, 10)}" if own and tax is not None and tax >= 0.07 and pk is not None else None)
        assert g.label == (f"d{rest(pk, 12)}" if own and tax == 0 and pk is not None else None)
        assert g.told == (None if not own else {0.01: "fixed", 0.04: "still_not_compared"}.get(tax))
        assert g.compared == (None if x["l_linestatus"] is None else x["l_linestatus"] == "F")
        assert (g.box is not None) == (disc is not None and disc >= 0.02) and (g.box is None or (g.box.x0, g.box.y0) == (pk and rest(pk, 30) * 12.0, None if q is None else rest(q, 10) * 12.0))


def test_large_packages_carry_their_columns(spark, monkeypatch):
    from tests.test_tracker import SCHEMA, brute, made

    monkeypatch.setattr(links, "CALL", 18)
    rows = made(11, packages=6)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {n > 18 for n in {r.package: r["count"] for r in df.groupBy("package").count().collect()}.values()} == {True, False}
    got = links.linked(df, ["package", "words"], df).collect()
    assert {r.sid: r.item for r in got} == brute(rows)
    assert sorted((r.sid, r.package, r.words) for r in got) == sorted((r[0], r[1], r[11] or "") for r in rows)
