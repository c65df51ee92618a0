"""Polygons by hand, and against the cells of random lattice shapes."""

import random

from planlark.operators import polygons as P

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
U = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]


def test_relations_by_hand():
    at = lambda x, y, s=2: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    assert P.relation(SQUARE, at(0, 0)) == (True, False, True)  # contact from inside
    assert P.relation(SQUARE, SQUARE[::-1]) == (True, True, True)
    assert P.relation(SQUARE, at(4, 0)) == (False, False, False)  # an edge
    assert P.relation(SQUARE, at(4, 4)) == (False, False, False)  # a corner
    assert P.relation(SQUARE, at(3, 3)) == (False, False, True)
    assert P.relation(U, at(2, 3)) == (False, False, False)  # in the gap: its box is inside, it touches both arms
    assert P.relation(U, at(2, 1)) == (False, False, True)
    assert P.relation(U, [(1, 5), (5, 5), (5, 1), (1, 1)]) == (False, False, True)  # all corners inside, not the middle
    assert P.relation([(0, 0), (9, 0), (0, 9)], [(1, 1), (3, 1), (1, 3)]) == (True, False, True)
    assert P.relation([(0, 0), (9, 0), (0, 9)], [(9, 9), (9, 0), (0, 9)]) == (False, False, False)  # halves of a square


def test_simple():
    assert P.simple(SQUARE) and P.simple(U) and P.simple(U[::-1])
    assert not P.simple([(0, 0), (2, 2), (2, 0), (0, 2)]) and not P.simple([(0, 0), (4, 0), (2, 0), (2, 2)])
    assert P.simple([(0, 0), (2, 0), (4, 0), (4, 4)])  # a straight corner
    assert not P.simple([(0, 0), (4, 0), (4, 4), (2, 0)])  # a corner on another edge


def test_random_stairs_against_their_cells():
    rng = random.Random(3)

    def stairs():
        x, y, heights = rng.randint(0, 3), rng.randint(0, 3), [rng.randint(1, 4) for _ in range(rng.randint(1, 4))]
        points = [(x, y), (x + len(heights), y)]
        for i in reversed(range(len(heights))):
            points += [(x + i + 1, y + heights[i]), (x + i, y + heights[i])]
        return P.corners([{"x": a, "y": b} for a, b in points]), {(x + i, y + j) for i, h in enumerate(heights) for j in range(h)}

    for _ in range(400):
        (a, cells_a), (b, cells_b) = stairs(), stairs()
        assert P.simple(a)
        assert P.relation(a, b) == (cells_b <= cells_a, cells_a <= cells_b, bool(cells_a & cells_b))


def test_pairs_keep_to_their_page_and_skip_what_is_no_polygon(spark):
    rows = [(1, 1, SQUARE), (1, 2, [(0, 0), (2, 2), (2, 0), (0, 3)]), (2, 3, SQUARE), (1, 4, None), (1, 5, []), (1, 6, [(0, 0), (4, 4), (None, 4)]), (1, 7, [(0, 0), (4, 0), (0, 400)]), (None, 8, SQUARE)]
    df = spark.createDataFrame(rows, "page long, id long, points array<struct<x: long, y: long>>")
    got = P.polygon_pairs(df, df, ["page"], 100).collect()
    assert sorted((r.page, r.l_id, r.r_id, r.covers, r.covered) for r in got) == [(1, 1, 1, True, True), (2, 3, 3, True, True)]
    refused = {r.id: r.r for r in df.select("id", P.polygon_refusal(df.points, 100).alias("r")).collect()}
    assert refused == {1: None, 2: "crosses", 3: None, 4: "few_points", 5: "few_points", 6: "few_points", 7: "outside", 8: None}
    assert P.polygon_pairs(df.limit(0), df, ["page"], 100).count() == 0
