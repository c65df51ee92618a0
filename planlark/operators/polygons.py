"""Polygons of a page: whether they are valid, and whether one covers or overlaps another, exactly. C8.

Points are array<struct<x: long, y: long>> in whole steps of the page, 0 to ``scale``. Pairs meet by their bounding boxes
(grids by box size), equal ``on`` (the version and the page: polygons of different planes are never compared); each pair
is then judged with integers and fractions, so contact and overlap are never a matter of rounding. A polygon has a few to some
hundred points; a judgement's work is the product of both. Validity is judged once a polygon, and its rows are written; pairs that
lie alike are judged once in a while (a task remembers some thousand).

Cases: fewer than three points, or a null, are no polygon; a point given twice in a row counts once; a ring that touches or
retraces itself crosses itself; contact from inside is covered; a shared edge or corner alone is no overlap; equal
polygons cover and overlap each other; polygons that are refused pair with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from planlark.operators.relational import box_overlaps
from planlark.sources.work import written

Point = tuple[int, int]
WIDE = "decimal(38,0)"


def cross(o: Column, a: Column, b: Column) -> Column:
    wide = lambda p, c: (p[c] - o[c]).cast("decimal(19,0)")
    return wide(a, "x") * wide(b, "y") - wide(a, "y") * wide(b, "x")


def polygon_refusal(points: Column, scale: int) -> Column:
    """Why the points are no polygon, null where they are one: few_points, outside, no_area or crosses."""
    known = F.coalesce(F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), F.lit(False))
    within = F.forall(points, lambda p: p["x"].between(0, scale) & p["y"].between(0, scale))
    area = F.aggregate(F.sequence(F.lit(1), F.size(points) - 1), F.lit(0).cast(WIDE), lambda s, i: (s + cross(points[0], points[i - 1], points[i])).cast(WIDE))
    judged = F.when(area == 0, "no_area").when(~is_simple(ring(points)), "crosses")
    return F.when(~known | (F.size(points) < 3), "few_points").when(~within, "outside").otherwise(judged)


@F.pandas_udf(BooleanType())
def is_simple(rings: pd.Series) -> pd.Series:
    return rings.map(lambda r: r is not None and simple_at(near_origin(c := corners(r), c)[0]))


@lru_cache(maxsize=8192)
def simple_at(polygon: tuple[Point, ...]) -> bool:
    return simple(list(polygon))


def ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))


def corners(points) -> list[Point]:
    """The points without those that repeat the one before."""
    found = [(p["x"], p["y"]) for p in points] if all(p is not None and p["x"] is not None and p["y"] is not None for p in points) else []
    return [p for i, p in enumerate(found) if p != found[i - 1]]


def edges(polygon: list[Point]) -> Iterator[tuple[Point, Point]]:
    return zip(polygon, polygon[1:] + polygon[:1], strict=True)


def turn(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def on_edge(p, a: Point, b: Point) -> bool:
    return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def meet(a: Point, b: Point, c: Point, d: Point) -> list[Fraction]:
    """Where the edge a b meets the edge c d, as shares of a b; of a common stretch, its ends."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    across = dx * (d[1] - c[1]) - dy * (d[0] - c[0])
    if across == 0:
        length = dx * dx + dy * dy
        return [Fraction((p[0] - a[0]) * dx + (p[1] - a[1]) * dy, length) for p in (c, d) if on_edge(p, a, b)] + [Fraction(i) for i, p in enumerate((a, b)) if on_edge(p, c, d)]
    along = Fraction((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0]), across)
    other = Fraction((c[0] - a[0]) * dy - (c[1] - a[1]) * dx, across)
    return [along] if 0 <= along <= 1 and 0 <= other <= 1 else []


def simple(polygon: list[Point]) -> bool:
    """Whether no two edges share a point but the corner between neighbours."""
    n, every = len(polygon), list(edges(polygon))
    if n < 3 or len(set(polygon)) < n:
        return False
    for i, (a, b) in enumerate(every):
        for j in range(i + 1, n):
            shared = set(meet(a, b, *every[j]))
            if shared - ({Fraction(1)} if j == i + 1 else set()) - ({Fraction(0)} if j - i == n - 1 else set()):
                return False
    return True


def place(p, polygon: list[Point]) -> str:
    inside = False
    for a, b in edges(polygon):
        if on_edge(p, a, b):
            return "on"
        if (a[1] > p[1]) != (b[1] > p[1]) and (turn(a, b, p) > 0) == (b[1] > a[1]):
            inside = not inside
    return "in" if inside else "out"


def places(polygon: list[Point], other: list[Point]) -> set[str]:
    """Where the stretches of a boundary lie, cut wherever they meet the other's boundary."""
    found = set()
    for a, b in edges(polygon):
        cuts = sorted({Fraction(0), Fraction(1), *(t for e in edges(other) for t in meet(a, b, *e))})
        for s, t in zip(cuts, cuts[1:]):
            half = (s + t) / 2
            found.add(place((a[0] + half * (b[0] - a[0]), a[1] + half * (b[1] - a[1])), other))
    return found


def relation(a: list[Point], b: list[Point]) -> tuple[bool, bool, bool]:
    """(a covers b, b covers a, they share area): a boundary that is nowhere outside is covered, since there are no holes;
    area is shared where a boundary goes inside the other, or both are one."""
    of_b, of_a = places(b, a), places(a, b)
    return "out" not in of_b, "out" not in of_a, "in" in of_a or "in" in of_b or of_a == of_b == {"on"}


@lru_cache(maxsize=8192)
def relation_of(a: tuple[Point, ...], b: tuple[Point, ...]) -> tuple[bool, bool, bool]:
    return relation(list(a), list(b))


def near_origin(a: list[Point], b: list[Point]) -> tuple[tuple[Point, ...], tuple[Point, ...]]:
    """Both moved together, so that pairs that lie alike are one pair."""
    x, y = min((p[0] for p in a), default=0), min((p[1] for p in a), default=0)
    return tuple((p[0] - x, p[1] - y) for p in a), tuple((p[0] - x, p[1] - y) for p in b)


@F.pandas_udf(StructType([StructField(c, BooleanType()) for c in ("covers", "covered", "overlaps")]))
def related(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([relation_of(*near_origin(corners(a), corners(b))) for a, b in zip(left, right, strict=True)], columns=["covers", "covered", "overlaps"])


def polygon_pairs(left: DataFrame, right: DataFrame, on: list[str], scale: int) -> DataFrame:
    """(on, l_id, r_id, covers, covered, overlaps) of all pairs that share area; both sides: (on, id, points)."""

    def boxed(df: DataFrame, p: str) -> DataFrame:
        side = lambda f, c: f(F.transform("points", lambda q: q[c]))
        found = df.select(*on, F.col("id").alias(f"{p}id"), ring(F.col("points")).alias(f"{p}points"), *[side(f, c).alias(f"{p}{c}{k}") for k, f in enumerate((F.array_min, F.array_max)) for c in "xy"])
        return written(found.repartition(*on, f"{p}id").filter(polygon_refusal(F.col(f"{p}points"), scale).isNull()), "polygons")

    met = box_overlaps(boxed(left, "l_"), boxed(right, "r_"), tuple(on))
    found = met.select(*on, "l_id", "r_id", related("l_points", "r_points").alias("r"))
    return found.select(*on, "l_id", "r_id", "r.*").filter("overlaps")
