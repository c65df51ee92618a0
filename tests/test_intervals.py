"""Interval and box joins, span resolution and medians against all pairs, on pages with many and with huge extents."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from planlark.operators import geometry as G
from planlark.operators import relational as R


def test_inside_equals_all_pairs(spark):
    rng = random.Random(2)
    spans = [(rng.choice("pq"), i, *sorted((rng.randint(-50, 400), rng.randint(-50, 400)))) for i in range(120)] + [("p", 500, -(10**9), 10**9), ("q", 501, 0, 0), ("q", 502, None, 3), ("q", 503, 0, 8), ("q", 504, 0, 2**29)]
    members = [(rng.choice("pq"), i, a, a + rng.choice((0, 1, 7, 60))) for i, a in ((i, rng.randint(-60, 400)) for i in range(200))] + [("q", 900, 0, 0), ("q", 901, 0, 8), ("q", 902, 0, 2**29), ("q", 903, None, 1)]
    df = R.inside(spark.createDataFrame(members, "k string, m long, m0 long, m1 long"), spark.createDataFrame(spans, "k string, s long, s0 long, s1 long"), ["k"], ("m0", "m1"), ("s0", "s1"))
    want = sorted((m[1], s[1]) for m in members for s in spans if m[0] == s[0] and None not in (m[2], s[2]) and s[2] <= m[2] and m[3] <= s[3])
    assert sorted((r.m, r.s) for r in df.collect()) == want


def test_boxes_equal_all_pairs_and_stay_few(spark):
    rng = random.Random(3)
    box = lambda i, most: (i, x := rng.uniform(-500, 500), y := rng.uniform(-500, 500), x + rng.uniform(0.01, most), y + rng.uniform(0.01, most))
    left = [box(i, 40) for i in range(150)] + [(900, -1e6, -1e6, 1e6, 1e6), (901, 0.0, 0.0, 64.0, 64.0)]
    right = [box(i, 90) for i in range(150)] + [(900, -5e6, 0.0, 5e6, 1.0), (901, 64.0, 0.0, 128.0, 64.0), (902, 63.0, 63.0, 64.0, 64.0)]
    frame = lambda rows, p: spark.createDataFrame(rows, ", ".join(f"{p}{c} {t}" for c, t in zip(("id", "x0", "y0", "x1", "y1"), ("long", *["double"] * 4), strict=True)))
    got = sorted((r.l_id, r.r_id) for r in R.box_overlaps(frame(left, "l_"), frame(right, "r_")).collect())
    want = sorted((a[0], b[0]) for a in left for b in right if max(a[1], b[1]) < min(a[3], b[3]) and max(a[2], b[2]) < min(a[4], b[4]))
    assert got == want and len(want) > 100


def resolved(line, items, t):
    """The rules for one line, in words of the drawing."""
    a, b = sorted(line)
    aligned = [i for i in items if abs(i[1] - a) <= t and abs(i[2] - b) <= t]
    if aligned:
        holds = lambda o, i: o[1] <= i[1] and o[2] >= i[2] and o[3] <= i[3] and o[4] >= i[4]
        inner = [i for i in aligned if all(holds(o, i) for o in aligned if o is not i)]
        return ("single", [inner[0][0]]) if len(inner) == 1 else ("ambiguous", [])
    under = sorted((i[1], i[2], i[0]) for i in items if i[1] >= a - t and i[2] <= b + t)
    if len(under) < 2:
        return "none", []
    if abs(under[0][0] - a) > t or abs(under[-1][1] - b) > t:
        return "short", []
    steps = [n[0] - m[1] for m, n in zip(under, under[1:])]
    if any(s < -t for s in steps):
        return "overlap", []
    return ("gap", []) if any(s > t for s in steps) else ("run", [u[2] for u in under])


@pytest.mark.parametrize("tolerance", [0, 2])
def test_spans_equal_the_rules(spark, tolerance):
    rng = random.Random(tolerance)
    items, lines = [], []
    for p in range(6):
        at = 0
        for i in range(14):
            wide = rng.choice((10, 20))
            items.append((p, p * 100 + i, at + rng.randint(-1, 1), at + wide + rng.randint(-1, 1), rng.randint(0, 3), rng.randint(4, 6)))
            at += wide + rng.choice((0, 0, 0, 0, 5, -4))
            if i % 5 == 0:
                items.append((p, p * 100 + 50 + i, items[-1][2], items[-1][3] + rng.randint(-2, 2), rng.randint(-2, 3), rng.randint(4, 9)))
        edges = sorted({e for it in items if it[0] == p for e in it[2:4]})
        lines += [(p, n, *rng.sample(edges, 2)) for n in range(150)]
    lines += [(0, 900, None, 5), (77, 901, 0, 10)]
    df = G.resolved_spans(spark.createDataFrame(lines, "page int, line long, a long, b long"), spark.createDataFrame(items, "page int, item long, x0 long, x1 long, y0 long, y1 long").withColumn("n", F.lit(1)), ["page"], tolerance)
    got = {}
    for r in df.collect():
        got.setdefault((r.page, r.line, r.state), []).append((r.place, r["item"]))
    want = {}
    for p, n, a, b in lines:
        state, found = ("none", []) if a is None else resolved((a, b), [i[1:] for i in items if i[0] == p], tolerance)
        want[p, n, state] = list(enumerate(found, 1)) or [(None, None)]
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert {k[2] for k in want} >= {"single", "none", "short", "overlap", "gap"} and any(k[2] == "run" for k in want)


@pytest.mark.parametrize("buckets", [64, 4096])
def test_medians_equal_sorted_middles(spark, buckets):
    rng = random.Random(4)
    groups = {"a": [rng.randint(-(10**6), 10**6) for _ in range(301)], "b": [7] * 10, "c": [1, 2], "d": [-(2**62), 2**62, 2**62 - 1], None: [3, 4, 100, 5], "e": [None], "f": [None, 9], "g": [rng.randint(0, 3) for _ in range(400)], "h": [rng.randint(0, 10**5) for _ in range(400)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = {r.k: r["median"] for r in R.exact_medians(spark.createDataFrame(rows, "k string, v long").repartition(3), ["k"], "v", buckets).collect()}
    assert got == {k: float(statistics.median([v for v in vs if v is not None])) for k, vs in groups.items() if any(v is not None for v in vs)}
    assert R.exact_medians(spark.createDataFrame([], "k string, v long"), ["k"], "v").count() == 0
