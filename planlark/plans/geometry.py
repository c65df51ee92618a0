"""Intervals, chains and tables of drawings, on positions made from the test tables; and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlark.functions import scalars as S
from planlark.operators import geometry as G
from planlark.operators import metrics as M
from planlark.operators import relational as R
from planlark.plans.registry import query
from planlark.sources.io import table


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, id, a, b): an order's lines as spans."""
    a = F.col("l_partkey") % 6
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("id"), a.alias("a"), (a + 1 + F.col("l_suppkey") % 2).alias("b"))


SPANS = "s AS (SELECT l_orderkey AS line, l_linenumber AS id, l_partkey % 6 AS a, l_partkey % 6 + 1 + l_suppkey % 2 AS b FROM lineitem)"


@query(f"""
    WITH {SPANS}, m AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY line ORDER BY a, b) = a THEN 0 ELSE 1 END AS st FROM (SELECT DISTINCT line, a, b FROM s)),
    c AS (SELECT *, sum(st) OVER (PARTITION BY line ORDER BY a, b) AS chain FROM m)
    SELECT line, count(*) AS links, min(a) AS a, max(b) AS b, CAST(sum(b - a) AS BIGINT) AS length FROM c GROUP BY line, chain HAVING count(*) >= 2""")
def chain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct spans whose ends touch form chains."""
    return G.chains(spans(spark, sf_dir).select("line", "a", "b").distinct(), ["line"])


@query(f"""
    WITH {SPANS}, t AS (SELECT line, max(b) - min(a) AS total, count(*) AS n, sum(b - a) AS parts FROM s GROUP BY line)
    SELECT line, CAST(total AS BIGINT) AS total, CAST(parts AS BIGINT) AS parts, CASE WHEN total = parts THEN 'CLOSED' ELSE 'NOT_CLOSED' END AS state FROM t""")
def chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parts of a line add up to its whole."""
    t = spans(spark, sf_dir).groupBy("line").agg((F.max("b") - F.min("a")).alias("total"), F.sum(F.col("b") - F.col("a")).alias("parts"), F.count("*").alias("n"))
    return t.select("line", "total", "parts", G.chain_state(F.col("total"), F.col("parts"), F.col("n")).alias("state"))


@query(f"""
    WITH {SPANS}, d AS (SELECT DISTINCT line, a, b FROM s)
    SELECT o.line, o.a, o.b, CAST(2 AS INTEGER) AS parts FROM d o WHERE o.b - o.a = 2 AND EXISTS (SELECT 1 FROM d x WHERE x.line = o.line AND x.a = o.a AND x.b = o.a + 1) AND EXISTS (SELECT 1 FROM d y WHERE y.line = o.line AND y.a = o.a + 1 AND y.b = o.b)""")
def tiled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that others tile from end to end; groups are single lines."""
    return G.closures(spans(spark, sf_dir).select("line", "a", "b").distinct(), ["line"])


@query(f"""
    WITH {SPANS}, m AS (SELECT line, id AS m_id, a AS m0, b AS m1 FROM s WHERE b - a = 1), w AS (SELECT line, id AS s_id, a AS s0, b AS s1 FROM s WHERE b - a = 2),
    j AS (SELECT m.line, m_id, s_id, count(*) OVER (PARTITION BY m.line, m_id) AS n, row_number() OVER (PARTITION BY m.line, m_id ORDER BY s_id) AS k FROM m JOIN w ON m.line = w.line AND s0 <= m0 AND m1 <= s1)
    SELECT line, m_id, CASE WHEN n = 1 THEN s_id END AS s_id, CASE WHEN n = 1 THEN 'contained' ELSE 'tie' END AS state FROM j WHERE k = 1""")
def containment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one span that holds a part; ties stay open. (line, id) may repeat in the data, so ids are made unique."""
    s = spans(spark, sf_dir)
    m = s.filter("b - a = 1").select("line", F.col("id").alias("m_id"), F.col("a").alias("m0"), F.col("b").alias("m1"))
    w = s.filter("b - a = 2").select("line", F.col("id").alias("s_id"), F.col("a").alias("s0"), F.col("b").alias("s1"))
    return G.containing_span(m, w, ["line"])


@query(f"""
    WITH {SPANS}, i AS (SELECT line AS page, line * 100 + id * 10 + row_number() OVER (PARTITION BY line, id ORDER BY a, b) AS item, a * 10 + id % 2 AS x0, b * 10 - id % 3 AS x1, 0 AS y0, b - a + id AS y1 FROM (SELECT DISTINCT * FROM s)),
    l AS (SELECT o_orderkey AS page, a * 10 + b AS line, a * 10 AS a, b * 10 AS b FROM orders CROSS JOIN (VALUES (0, 3), (1, 4), (0, 6), (3, 6), (2, 4), (4, 5)) v(a, b)),
    m AS (SELECT l.*, i.item, i.x0, i.x1, i.y0, i.y1, abs(i.x0 - l.a) <= 1 AND abs(i.x1 - l.b) <= 1 AS al FROM l JOIN i ON i.page = l.page AND i.x0 >= l.a - 1 AND i.x1 <= l.b + 1),
    n AS (SELECT m.*, al AND NOT EXISTS (SELECT 1 FROM m z WHERE z.page = m.page AND z.line = m.line AND z.al AND z.item <> m.item AND NOT (z.x0 <= m.x0 AND z.x1 >= m.x1 AND z.y0 <= m.y0 AND z.y1 >= m.y1)) AS inm,
        x0 - lag(x1) OVER w AS step, row_number() OVER w AS place FROM m WINDOW w AS (PARTITION BY page, line ORDER BY x0, x1, item)),
    f AS (SELECT page, line, count(*) FILTER (WHERE al) AS na, count(*) FILTER (WHERE inm) AS ni, count(*) AS n, max(step < -1) AS over, max(step > 1) AS gap, abs(min(x0) - min(a)) <= 1 AND abs(arg_max(x1, (x0, x1, item)) - min(b)) <= 1 AS reach FROM n GROUP BY 1, 2),
    s2 AS (SELECT l.page, l.line, coalesce(CASE WHEN na = 1 OR ni = 1 THEN 'single' WHEN na > 1 THEN 'ambiguous' WHEN n < 2 THEN 'none' WHEN NOT reach THEN 'short' WHEN over THEN 'overlap' WHEN gap THEN 'gap' WHEN n >= 2 THEN 'run' END, 'none') AS state FROM l LEFT JOIN f ON f.page = l.page AND f.line = l.line)
    SELECT s2.page, s2.line, s2.state, n.item, CASE s2.state WHEN 'run' THEN n.place WHEN 'single' THEN 1 END AS place FROM s2 LEFT JOIN n ON n.page = s2.page AND n.line = s2.line AND (s2.state = 'run' OR (s2.state = 'single' AND n.inm))""")
def dimension_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six lines of each order against its items: one item, a run of items side by side, or why not."""
    w = Window.partitionBy("line", "id").orderBy("a", "b")
    i = spans(spark, sf_dir).distinct().withColumn("item", F.col("line") * 100 + F.col("id") * 10 + F.row_number().over(w))
    items = i.select(F.col("line").alias("page"), "item", (F.col("a") * 10 + F.col("id") % 2).alias("x0"), (F.col("b") * 10 - F.col("id") % 3).alias("x1"), F.lit(0).alias("y0"), (F.col("b") - F.col("a") + F.col("id")).alias("y1"))
    drawn = F.array(*[F.struct(F.lit(a * 10 + b).alias("line"), F.lit(a * 10).alias("a"), F.lit(b * 10).alias("b")) for a, b in ((0, 3), (1, 4), (0, 6), (3, 6), (2, 4), (4, 5))])
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.inline(drawn))
    return G.resolved_spans(lines, items, ["page"], 1)


@query("""
    WITH t AS (SELECT l_orderkey AS page, l_orderkey * 8 + l_linenumber AS text, max(l_partkey) * 37 % 200 AS x, max(l_suppkey) * 53 % 200 AS y, CASE WHEN max(l_tax) < 0.04 THEN 'v' ELSE 'h' END AS along,
            CASE WHEN max(l_discount) > 0.08 THEN max(l_partkey) * 11 % 200 END AS lx, CASE WHEN max(l_discount) > 0.08 THEN 40 END AS ly FROM lineitem GROUP BY l_orderkey, l_linenumber),
    l AS (SELECT o_orderkey AS page, k AS line, k * 40 AS x0, o_custkey * 7 % 200 AS y0, CASE k WHEN 3 THEN k * 40 WHEN 4 THEN k * 40 - 50 ELSE k * 40 + 90 - k * 10 END AS x1, o_custkey * 7 % 200 + CASE k WHEN 3 THEN 120 WHEN 4 THEN -50 ELSE k END AS y1 FROM orders CROSS JOIN range(5) r(k)),
    f AS (SELECT t.*, coalesce(lx, x)::DOUBLE AS px, coalesce(ly, y)::DOUBLE AS py, line, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x1 - x0)::DOUBLE AS dx, (y1 - y0)::DOUBLE AS dy, CASE WHEN abs(x1 - x0) > abs(y1 - y0) THEN 'h' WHEN abs(y1 - y0) > abs(x1 - x0) THEN 'v' END AS runs FROM t JOIN l ON l.page = t.page),
    g AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy))) AS u FROM f),
    d AS (SELECT *, (px - (x0 + u * dx)) * (px - (x0 + u * dx)) + (py - (y0 + u * dy)) * (py - (y0 + u * dy)) AS d2 FROM g),
    n AS (SELECT *, lx IS NOT NULL OR coalesce(runs = along, FALSE) AS fits FROM d WHERE d2 <= 2500),
    o AS (SELECT *, bool_or(runs IS NULL) OVER w AS na, count(*) FILTER (WHERE fits) OVER w AS k, row_number() OVER v AS r, lead(CASE WHEN fits THEN d2 END) OVER v AS nx FROM n WINDOW w AS (PARTITION BY page, text), v AS (PARTITION BY page, text ORDER BY fits DESC, d2, line)),
    z AS (SELECT page, text, line, CASE WHEN lx IS NULL AND na THEN 'no_axis' WHEN k = 0 THEN 'other_way' WHEN nx IS NOT NULL AND sqrt(nx) - sqrt(d2) <= 4 THEN 'ambiguous' ELSE 'associated' END AS state FROM o WHERE r = 1)
    SELECT t.page, t.text, CASE WHEN z.state = 'associated' THEN z.line END AS line, coalesce(z.state, 'out_of_range') AS state FROM t LEFT JOIN z ON z.page = t.page AND z.text = t.text""")
def annotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a page and its dimension lines: flat ones, an upright one and one that runs equally both ways."""
    top, led = lambda c, k, m: F.max(c) * k % m, F.max("l_discount") > 0.08
    texts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("text")).agg(
        top("l_partkey", 37, 200).alias("x"), top("l_suppkey", 53, 200).alias("y"), F.when(F.max("l_tax") < 0.04, "v").otherwise("h").alias("along"), F.when(led, top("l_partkey", 11, 200)).alias("lx"), F.when(led, 40).alias("ly")
    )
    y = F.col("o_custkey") * 7 % 200
    drawn = [(F.lit(k * 40), y, F.lit(k * 40 if k == 3 else k * 40 - 50 if k == 4 else k * 40 + 90 - k * 10), y + {3: 120, 4: -50}.get(k, k)) for k in range(5)]
    every = F.array(*[F.struct(F.lit(k).alias("line"), *[c.alias(n) for c, n in zip(cs, ("x0", "y0", "x1", "y1"), strict=True)]) for k, cs in enumerate(drawn)])
    return G.text_lines(texts, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.inline(every)), ["page"], 50.0, 4.0)


@query(f"""
    WITH {SPANS}, k AS (SELECT *, a - lag(b) OVER (PARTITION BY line ORDER BY a, b, id) AS step FROM s),
    g AS (SELECT line, count(*) AS members, bool_or(coalesce(step > 0, FALSE)) AS gap, bool_or(coalesce(step < 0, FALSE)) AS over, min(a) = 0 AS l, max(b) = 6 AS r, count(*) = count(DISTINCT id) AS once FROM k GROUP BY line)
    SELECT line, members, CASE WHEN NOT once THEN 'duplicate_id' WHEN over THEN 'overlap' WHEN gap THEN 'gap' WHEN NOT (l AND r) THEN 'short' ELSE 'covered' END AS state FROM g""")
def assembly_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a span in order, without overlap or gap, to both ends."""
    s = spans(spark, sf_dir).withColumns({"s0": F.lit(0), "s1": F.lit(6)})
    return G.assembly(s, ["line"], "s0", "s1")


@query("""
    WITH c AS (SELECT event_id AS l, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'click'), v AS (SELECT event_id AS r, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'view'),
    p AS (SELECT l, r, abs(c.t - v.t) AS d FROM c JOIN v ON c.user_id = v.user_id AND abs(c.t - v.t) <= 36000),
    n AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS nx FROM p WINDOW w AS (PARTITION BY l ORDER BY d, r))
    SELECT l, r, d, CASE WHEN nx IS NULL OR nx - d >= 600 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS state FROM n WHERE k = 1""")
def nearest_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest view of each click of a user, by buckets of the radius; ambiguous without a clear margin."""
    e = table(spark, sf_dir, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    c = e.filter("event_type = 'click'").select(F.col("event_id").alias("l"), "user_id", F.col("t").alias("lt"))
    v = e.filter("event_type = 'view'").select(F.col("event_id").alias("r"), "user_id", F.col("t").alias("rt"))
    pairs = R.bucketed_near(c, v, ["user_id"], "lt", "rt", 36_000).withColumn("d", F.abs(F.col("lt") - F.col("rt")))
    return R.nearest_with_margin(pairs, "l", "r", "d", 600).select("l", "r", "d", "state")


@query("""
    WITH p AS (SELECT p_partkey AS id, (p_partkey * 37) % 1000 AS x, (p_partkey * 91) % 1000 AS y, p_size AS s FROM part), l AS (SELECT * FROM p WHERE id % 2 = 0), r AS (SELECT * FROM p WHERE id % 2 = 1),
    j AS (SELECT l.id AS l_id, r.id AS r_id, (least(l.x + l.s, r.x + r.s) - greatest(l.x, r.x)) * (least(l.y + l.s, r.y + r.s) - greatest(l.y, r.y)) AS common, l.s * l.s + r.s * r.s AS area FROM l JOIN r ON greatest(l.x, r.x) < least(l.x + l.s, r.x + r.s) AND greatest(l.y, r.y) < least(l.y + l.s, r.y + r.s))
    SELECT l_id, r_id, CAST(common AS BIGINT) AS common, CAST(area - common AS BIGINT) AS joined, common * 100 >= (area - common) * 50 AS good FROM j""")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes by a grid, each pair once, and their exact overlap. Boxes of one place and size meet as one; what
    overlaps is joined with the lists of their ids, and pairs of ids are made last and moved nowhere."""
    l, r = part_boxes(spark, sf_dir)
    found = box_classes(l.select(*BOX["l"]).distinct(), r.select(*BOX["r"]).distinct())
    found = found.withColumn("good", F.col("common") * 100 >= F.col("joined") * 50)
    both = found.join(ids_of_boxes(l, "l").hint("merge"), BOX["l"]).join(ids_of_boxes(r, "r").hint("merge"), BOX["r"])
    pairs = both.select("l_ids", "r_ids", "common", "joined", "good").withColumn("l_id", F.explode("l_ids")).withColumn("r_id", F.explode("r_ids"))
    return pairs.select("l_id", "r_id", "common", "joined", "good")


#: About how many ids of a box are one list.
LISTED = 1024


def ids_of_boxes(boxes: DataFrame, n: str) -> DataFrame:
    """The boxes of one side with their ids, in lists of some ``LISTED``."""
    lists = F.ceil(F.count("*").over(Window.partitionBy(*BOX[n])) / F.lit(LISTED))
    dealt = boxes.select(f"{n}_id", *BOX[n], F.pmod(F.xxhash64(f"{n}_id"), lists).alias("__list"))
    return dealt.groupBy(*BOX[n], "__list").agg(F.collect_list(f"{n}_id").alias(f"{n}_ids")).drop("__list")


BOX = {n: [f"{n}_{c}" for c in ("x0", "y0", "x1", "y1")] for n in "lr"}


def part_boxes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The boxes of even and of odd parts: (l_id, l_x0, l_y0, l_x1, l_y1) and (r_id, ...)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000).alias("x0"), (F.col("p_partkey") * 91 % 1000).alias("y0"), "p_size")
    p = p.select("id", "x0", "y0", (F.col("x0") + F.col("p_size")).alias("x1"), (F.col("y0") + F.col("p_size")).alias("y1"))
    return [p.filter(F.col("id") % 2 == k).select(*[F.col(c).alias(f"{n}_{c}") for c in p.columns]) for k, n in enumerate("lr")]


def box_classes(l: DataFrame, r: DataFrame) -> DataFrame:
    """Overlapping boxes with their common and joined area."""
    box = lambda n: F.struct(*[F.col(c).alias(c[2:]) for c in BOX[n]])
    return R.box_overlaps(l, r).withColumn("i", S.iou_parts(box("l"), box("r"))).select("*", "i.*").drop("i")


@query("""
    WITH l AS (SELECT p_brand, p_partkey, p_size FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_brand, p_partkey, p_size FROM part WHERE p_partkey % 2 = 1),
    j AS (SELECT l.p_partkey AS left_id, r.p_partkey AS right_id FROM l JOIN r ON l.p_brand = r.p_brand AND l.p_size = r.p_size)
    SELECT left_id, right_id FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS a, count(*) OVER (PARTITION BY right_id) AS b FROM j) WHERE a = 1 AND b = 1""")
def unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired only where each side fits exactly one of the other."""
    p = table(spark, sf_dir, "part")
    l, r = (p.filter(F.col("p_partkey") % 2 == k).select("p_brand", "p_size", F.col("p_partkey").alias(n)) for k, n in ((0, "left_id"), (1, "right_id")))
    return R.unique_matches(l, r, ["p_brand", "p_size"], "left_id", "right_id")


@query("""
    WITH t AS (SELECT l_partkey % 50 AS page, l_orderkey % 20 AS row_no, l_suppkey AS x, l_linenumber % 2 AS side FROM lineitem), a AS (SELECT DISTINCT page, row_no, x FROM t WHERE side = 0), b AS (SELECT DISTINCT page, row_no, x FROM t WHERE side = 1),
    s AS (SELECT a.page, a.row_no AS l_row, b.row_no AS r_row, count(DISTINCT a.x) AS support FROM a JOIN b ON a.page = b.page AND abs(a.x - b.x) <= 0 GROUP BY 1, 2, 3),
    n AS (SELECT *, row_number() OVER w AS k, coalesce(lead(support) OVER w, 0) AS nx FROM s WINDOW w AS (PARTITION BY page, l_row ORDER BY support DESC, r_row))
    SELECT page, l_row, r_row, support, CASE WHEN support - nx >= 2 THEN 'paired' ELSE 'ambiguous' END AS state FROM n WHERE k = 1""")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two drawings by coinciding ticks, where the best is clearly ahead."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("page"), (F.col("l_orderkey") % 20).alias("row"), F.col("l_suppkey").alias("x"), (F.col("l_linenumber") % 2).alias("side"))
    a, b = (t.filter(F.col("side") == k).select("page", "row", "x").distinct() for k in (0, 1))
    return G.pair_rows(a, b, ["page"], 0, 2)


@query("""
    WITH s AS (SELECT l_orderkey AS page, l_linenumber AS id, l_partkey % 100 AS x0, l_partkey % 100 + CAST(l_quantity AS BIGINT) AS x1, l_suppkey % 10 AS y FROM lineitem), t AS (SELECT DISTINCT l_orderkey AS page, l_partkey % 100 AS x FROM lineitem UNION SELECT l_orderkey, l_partkey % 100 + CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_tax < 0.05)
    SELECT DISTINCT page, id FROM s WHERE x1 - x0 >= 10 AND EXISTS (SELECT 1 FROM t WHERE t.page = s.page AND abs(t.x - s.x0) <= 1) AND EXISTS (SELECT 1 FROM t WHERE t.page = s.page AND abs(t.x - s.x1) <= 1)""")
def dimension_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a least span with a witness across both ends."""
    l = table(spark, sf_dir, "lineitem").withColumn("x0", F.col("l_partkey") % 100).withColumn("x1", F.col("x0") + F.col("l_quantity").cast("long"))
    lines = l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.struct("l_linenumber", "x0", "x1").alias("id"), (F.col("l_suppkey") % 10).alias("y"), "x0", "x1")
    ticks = l.select(F.col("l_orderkey").alias("page"), F.col("x0").alias("x")).unionByName(l.filter("l_tax < 0.05").select(F.col("l_orderkey").alias("page"), F.col("x1").alias("x"))).distinct()
    found = G.dimension_lines(lines.drop("n"), ticks.withColumns({"y0": F.lit(0), "y1": F.lit(10)}), 1, 10)
    return found.select("page", F.col("id.l_linenumber").alias("id")).distinct()


@query("""
    WITH r AS (SELECT l_suppkey AS view, CAST(l_quantity AS BIGINT) AS r FROM lineitem), m AS (SELECT view, median(r) AS s FROM r GROUP BY view)
    SELECT r.view, max(s)::DOUBLE AS scale, count(*) FILTER (WHERE abs(r - s) * 100 > s * 50) AS outliers, count(*) AS n FROM r JOIN m ON m.view = r.view GROUP BY r.view""")
def view_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A median scale per view, and the ratios that lie off it."""
    return G.view_scale(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("view"), F.col("l_quantity").cast("long").alias("r")), "view", "r", 50)


@query("""
    SELECT o_custkey AS sheet, CASE WHEN count(*) >= 1 AND o_custkey % 5 <> 0 THEN max(o_orderkey) END AS current, CASE WHEN o_custkey % 5 = 0 AND count(*) > 1 THEN 'unordered' ELSE 'ordered' END AS state
    FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey
    UNION ALL SELECT o_custkey, CASE WHEN count(*) = 1 THEN max(o_orderkey) END, CASE WHEN count(*) > 1 THEN 'unordered' ELSE 'ordered' END FROM orders WHERE o_custkey % 5 = 0 GROUP BY o_custkey""")
def sheet_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets are ordered only by what supersedes what; several starts are refused."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return G.supersession(o.select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("version"), F.when(F.col("o_custkey") % 5 != 0, before).alias("supersedes")))


@query("""
    WITH a AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey % 14 = 0 THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey >= 5)
    SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, CASE WHEN b.n_nationkey IS NULL THEN 'only_left' WHEN a.n_nationkey IS NULL THEN 'only_right' WHEN a.n_name <> b.n_name OR a.n_regionkey <> b.n_regionkey THEN 'differs' ELSE 'same' END AS state,
        CASE WHEN a.n_nationkey IS NULL OR b.n_nationkey IS NULL THEN '' WHEN a.n_name <> b.n_name AND a.n_regionkey <> b.n_regionkey THEN 'n_name,n_regionkey' WHEN a.n_name <> b.n_name THEN 'n_name' WHEN a.n_regionkey <> b.n_regionkey THEN 'n_regionkey' ELSE '' END AS differs
    FROM a FULL JOIN b ON a.n_nationkey = b.n_nationkey""")
def room_table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables by key: one-sided rows, and the attributes that differ."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    b = n.filter(k >= 5).select(k, F.when(k % 7 == 0, "X").otherwise(F.col("n_name")).alias("n_name"), F.when(k % 14 == 0, 99).otherwise(F.col("n_regionkey")).alias("n_regionkey"))
    return G.table_diff(n.filter(k < 20), b, ["n_nationkey"], ["n_name", "n_regionkey"])


@query("""
    WITH RECURSIVE k AS (SELECT DISTINCT s_nationkey AS g, s_suppkey % 8 AS x, s_suppkey % 5 AS y FROM supplier),
    r AS (SELECT g, x, y, x * 10 + y AS seed FROM k UNION SELECT k.g, k.x, k.y, r.seed FROM r JOIN k ON k.g = r.g AND abs(k.x - r.x) + abs(k.y - r.y) = 1),
    c AS (SELECT g, x, y, min(seed) AS seed FROM r GROUP BY 1, 2, 3)
    SELECT g, x, y, dense_rank() OVER (PARTITION BY g ORDER BY seed) - 1 AS component FROM c""")
def grid_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that touch are one view, numbered by their least cell."""
    k = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 8).alias("x"), (F.col("s_suppkey") % 5).alias("y")).distinct()
    return G.grid_components(k, ["g"])


def findings(spark: SparkSession, sf_dir: str, limit: float) -> DataFrame:
    """Findings made from lines: what was expected, and what a run with this limit said."""
    e = F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("REVIEW_REQUIRED")
    o = F.when(F.col("l_discount") > limit, "FAIL").when(F.col("l_tax") > 0.07, "NOT_FOUND").otherwise("PASS")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linestatus") == "F", "CRITICAL").otherwise("MINOR").alias("severity"), e.alias("expected"), o.alias("outcome"))


def finding_sql(name: str, limit: float) -> str:
    return f"""{name} AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'CRITICAL' ELSE 'MINOR' END AS severity, CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'R' THEN 'FAIL' ELSE 'REVIEW_REQUIRED' END AS expected,
        CASE WHEN l_discount > {limit} THEN 'FAIL' WHEN l_tax > 0.07 THEN 'NOT_FOUND' ELSE 'PASS' END AS outcome FROM lineitem)"""


def metric_sql(f: str) -> str:
    return f"""SELECT 'critical_false_pass_rate' AS metric, count(*) FILTER (WHERE severity = 'CRITICAL' AND expected = 'FAIL' AND outcome = 'PASS') AS num, count(*) FILTER (WHERE severity = 'CRITICAL' AND expected = 'FAIL') AS den FROM {f}
    UNION ALL SELECT 'fail_recall', count(*) FILTER (WHERE expected = 'FAIL' AND outcome = 'FAIL'), count(*) FILTER (WHERE expected = 'FAIL') FROM {f}
    UNION ALL SELECT 'abstention_recall', count(*) FILTER (WHERE expected = 'REVIEW_REQUIRED' AND outcome = 'NOT_FOUND'), count(*) FILTER (WHERE expected = 'REVIEW_REQUIRED') FROM {f}
    UNION ALL SELECT 'automation_coverage', count(*) FILTER (WHERE outcome <> 'NOT_FOUND'), count(*) FROM {f}"""


@query(f"WITH {finding_sql('f', 0.05)}, m AS ({metric_sql('f')}) SELECT metric, num, den, CASE WHEN den = 0 THEN NULL ELSE round(num::DOUBLE / den, 6) END AS value FROM m")
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 M5 M6 M7: all ratios from one pass."""
    return M.finding_metrics(findings(spark, sf_dir, 0.05))


@query(f"""
    WITH {finding_sql('f', 0.05)}, {finding_sql('g', 0.03)}, a AS ({metric_sql('f')}), b AS ({metric_sql('g')}),
    j AS (SELECT a.metric, round(a.num::DOUBLE / a.den, 6) AS was, round(b.num::DOUBLE / b.den, 6) AS now FROM a JOIN b ON a.metric = b.metric)
    SELECT metric, was, now, round(now - was, 6) AS change, CASE WHEN now = was THEN 'same' WHEN (now > was) = (metric <> 'critical_false_pass_rate') THEN 'better' ELSE 'worse' END AS state FROM j""")
def regression_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: two runs by metric, with each metric's own direction."""
    return M.metric_delta(M.finding_metrics(findings(spark, sf_dir, 0.05)), M.finding_metrics(findings(spark, sf_dir, 0.03)))


@query(f"""
    WITH {finding_sql('f', 0.05)}, {finding_sql('g', 0.03)}, c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2, 3, 4 HAVING count(*) = 1)
    SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_suppkey, CASE WHEN g.outcome = g.expected THEN 'newly_right' ELSE 'newly_wrong' END AS change FROM f JOIN c USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) JOIN g USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)
    WHERE (f.outcome = f.expected) <> (g.outcome = g.expected)""")
def case_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: newly right and newly wrong cases that both runs have."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a, b = (R.claimed_once(findings(spark, sf_dir, x), keys) for x in (0.05, 0.03))
    return M.case_delta(a, b, keys)


@query(f"""
    WITH {finding_sql('f', 0.05)}, m AS ({metric_sql('f')}), v AS (SELECT metric, round(num::DOUBLE / den, 6) AS value FROM m), t(metric, least, most) AS (VALUES ('critical_false_pass_rate', NULL, 0.1), ('fail_recall', 0.4, NULL), ('automation_coverage', 0.99, NULL), ('numeric_accuracy', 0.9, NULL))
    SELECT t.metric, v.value, CASE WHEN v.value IS NULL THEN 'NOT_MEASURED' WHEN v.value < t.least OR v.value > t.most THEN 'BLOCKED' ELSE 'OK' END AS gate FROM t LEFT JOIN v ON v.metric = t.metric""")
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric that was not measured blocks a release."""
    t = spark.createDataFrame([("critical_false_pass_rate", None, 0.1), ("fail_recall", 0.4, None), ("automation_coverage", 0.99, None), ("numeric_accuracy", 0.9, None)], "metric string, least double, most double")
    return M.release_gates(M.finding_metrics(findings(spark, sf_dir, 0.05)), t)


@query("""
    WITH g AS (SELECT p_partkey, p_size AS value, 'in' AS unit FROM part), r AS (SELECT l_partkey AS p_partkey, CAST(max(l_quantity) AS INTEGER) AS value, max(CASE WHEN l_tax > 0.079 THEN 'mm' ELSE 'in' END) AS unit FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1),
    j AS (SELECT g.*, r.value AS v, r.unit AS u FROM g LEFT JOIN r ON r.p_partkey = g.p_partkey), m AS (SELECT 'numeric_accuracy' AS metric, count(*) FILTER (WHERE value = v) AS num, count(*) AS den FROM j UNION ALL SELECT 'unit_accuracy', count(*) FILTER (WHERE unit = u), count(*) FROM j
        UNION ALL SELECT 'identifier_precision', (SELECT count(*) FROM r WHERE p_partkey IN (SELECT p_partkey FROM g WHERE value > 10)), (SELECT count(*) FROM r))
    SELECT metric, num, den, round(num::DOUBLE / den, 6) AS value FROM m""")
def reading_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 M4: readings against gold; what was not read is wrong, and precision counts what was predicted."""
    gold = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("value"), F.lit("in").alias("unit"))
    read = table(spark, sf_dir, "lineitem").filter("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("int").alias("value"), F.max(F.when(F.col("l_tax") > 0.079, "mm").otherwise("in")).alias("unit"))
    return M.reading_metrics(gold, read, ["p_partkey"]).unionByName(M.match_precision(read, gold.filter("value > 10"), ["p_partkey"]))


@query("""
    WITH a AS (SELECT l_orderkey AS page, CAST(l_quantity AS INTEGER) % 5 AS v, l_linenumber AS id FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_orderkey AS page, CAST(l_quantity AS INTEGER) % 5 AS v, l_linenumber AS id, l_tax > 0.05 AS held FROM lineitem WHERE l_linenumber >= 3),
    g AS (SELECT page, v, row_number() OVER (PARTITION BY page, v ORDER BY id) AS k FROM a), r AS (SELECT page, v, held, row_number() OVER (PARTITION BY page, v ORDER BY held, id) AS k FROM b),
    j AS (SELECT coalesce(g.page, r.page) AS page, CASE WHEN g.page IS NULL THEN 'extra' WHEN r.page IS NULL THEN 'missing' WHEN r.held THEN 'held' ELSE 'found' END AS s FROM g FULL JOIN r ON g.page = r.page AND g.v = r.v AND g.k = r.k)
    SELECT page, count(*) FILTER (WHERE s = 'found') AS found, count(*) FILTER (WHERE s = 'held') AS held, count(*) FILTER (WHERE s = 'missing') AS missing, count(*) FILTER (WHERE s = 'extra') AS extra FROM j GROUP BY page""")
def multiset_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings against gold by page and value, each once, usable ones first."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity").cast("int") % 5).alias("v"), F.col("l_linenumber").alias("id"), (F.col("l_tax") > 0.05).alias("held"))
    return M.multiset_match(l.filter("id <= 4").drop("held"), l.filter("id >= 3"), "page", "v")


@query("""
    SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS reviewed, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_orderkey END) AS corrected, round(count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_orderkey END)::DOUBLE / count(DISTINCT l_orderkey), 6) AS rate FROM lineitem GROUP BY 1, 2""")
def correction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 A19."""
    return M.correction_rate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey", F.col("l_discount") > 0.05)


@query("""
    SELECT l_suppkey, count(*) AS cases, count(*) FILTER (WHERE l_tax > 0.079 AND l_suppkey % 2 = 0) AS wrong, count(*) >= 30 AND count(*) FILTER (WHERE l_tax > 0.079 AND l_suppkey % 2 = 0) = 0 AS may_decide FROM lineitem GROUP BY 1""")
def check_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16."""
    return M.may_decide(table(spark, sf_dir, "lineitem"), "l_suppkey", (F.col("l_tax") > 0.079) & (F.col("l_suppkey") % 2 == 0))


@query("""
    WITH g AS (SELECT p_brand, p_partkey, p_size AS value FROM part), r AS (SELECT l_partkey AS p_partkey, CAST(min(l_quantity) AS INTEGER) AS v FROM lineitem WHERE l_quantity < 20 GROUP BY 1)
    SELECT p_brand, round(count(*) FILTER (WHERE v = value)::DOUBLE / nullif(count(v), 0), 6) AS accuracy, round(count(v)::DOUBLE / count(*), 6) AS coverage FROM g LEFT JOIN r ON r.p_partkey = g.p_partkey GROUP BY p_brand""")
def package_scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over what was attempted, coverage over all."""
    gold = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("value"))
    low = table(spark, sf_dir, "lineitem").filter("l_quantity < 20").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_quantity").cast("int").alias("value"))
    return M.scorecard(gold, low.join(gold.select("p_partkey", "p_brand"), "p_partkey"), "p_brand", "p_partkey")


@query("""
    WITH a AS (SELECT p_partkey AS id, p_size % 4 AS x, p_size % 4 = 1 AS rt FROM part WHERE p_partkey % 10 <> 9), b AS (SELECT p_partkey AS id, (p_size + p_partkey) % 4 AS x, (p_size + p_partkey) % 4 = 1 AS rt FROM part WHERE p_partkey % 10 <> 8)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'dropped' WHEN a.id IS NULL THEN CASE WHEN b.rt THEN 'new_right' ELSE 'new_wrong' END WHEN NOT a.rt AND b.rt THEN 'fixed' WHEN a.rt AND NOT b.rt THEN 'broke' WHEN a.x <> b.x THEN 'moved' ELSE 'same' END AS state FROM a FULL JOIN b ON a.id = b.id""")
def scorecard_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    card = lambda cond, x: p.filter(cond).select(k.alias("id"), x.alias("answer"), (x == 1).alias("right"))
    return M.scorecard_diff(card(k % 10 != 9, F.col("p_size") % 4), card(k % 10 != 8, (F.col("p_size") + k) % 4), ["id"])
