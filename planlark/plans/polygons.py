"""Polygons made from parts, on pages of twenty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.operators import polygons as P
from planlark.plans.registry import query
from planlark.sources.io import table


def shape(*points: tuple) -> Column:
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.array(*[F.struct(number(x).alias("x"), number(y).alias("y")) for x, y in points])


@query("""
    SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN 'crosses' WHEN 2 THEN 'no_area' WHEN 3 THEN 'few_points' WHEN 4 THEN 'outside' WHEN 5 THEN 'crosses' WHEN 6 THEN 'crosses' END AS refusal FROM part""")
def polygon_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notched box, a bow tie, points in a line, two points, one off the page, a touching ring, a spike, a repeated point."""
    k, a = F.col("p_partkey") % 8, F.col("p_size") + 2
    kinds = [
        shape((0, 0), (a, 0), (a, 1), (1, 1), (1, a), (0, a)), shape((0, 0), (a, a), (a, 0), (0, a + 1)), shape((0, 0), (a, a), (2 * a, 2 * a)), shape((0, 0), (a, 1)), shape((0, 0), (a, 0), (0, 201)),
        shape((0, 0), (a, a), (2 * a - 4, 0), (2 * a - 4, 2 * a - 4), (a, a), (0, 2 * a - 4)), shape((0, 0), (a, 0), (a, 2), (1, 2), (1, 4), (1, 2), (0, 2)), shape((0, 0), (a, 0), (a, 0), (0, a), (0, 0)),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.array(*kinds)[k.cast("int")].alias("points")).select("p_partkey", P.polygon_refusal(F.col("points"), 200).alias("refusal"))


@query("""
    WITH p AS (SELECT p_partkey AS id, p_partkey // 20 AS page, p_partkey * 7 % 6 AS x, p_partkey * 5 % 7 AS y, 2 + p_size % 3 AS w, 2 + (p_size // 3) % 3 AS h FROM part),
    c AS (SELECT id, page, x + i.i AS cx, y + j.j AS cy FROM p, range(4) i(i), range(4) j(j) WHERE i.i < w AND j.j < h AND NOT (i.i = w - 1 AND j.j = h - 1)),
    n AS (SELECT id, count(*) AS n FROM c GROUP BY id),
    o AS (SELECT a.page, a.id AS l_id, b.id AS r_id, count(*) AS common FROM c a JOIN c b ON a.page = b.page AND a.cx = b.cx AND a.cy = b.cy WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1, 2, 3)
    SELECT o.page, o.l_id, o.r_id, o.common = r.n AS covers, o.common = l.n AS covered, true AS overlaps FROM o JOIN n l ON l.id = o.l_id JOIN n r ON r.id = o.r_id""")
def polygon_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a notch that share area on their page, and which covers which; the SQL counts their unit cells."""
    k = F.col("p_partkey")
    x, y, w, h = k * 7 % 6, k * 5 % 7, F.col("p_size") % 3 + 2, F.floor(F.col("p_size") / 3) % 3 + 2
    notched = shape((x, y), (x + w, y), (x + w, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + h), (x, y + h))
    made = table(spark, sf_dir, "part").select(F.floor(k / 20).alias("page"), k.alias("id"), notched.alias("points"))
    return P.polygon_pairs(made.filter("id % 2 = 0"), made.filter("id % 2 = 1"), ["page"], 100)
