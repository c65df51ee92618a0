"""Items over rounds and checks: lines of a customer's orders stand for the findings of a package's checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlark.operators import links as K
from planlark.operators import tracker as J
from planlark.plans.registry import query
from planlark.sources.io import table

#: The sightings as SQL states them.
SIGHTINGS = """
    l AS (
        SELECT l_orderkey, l_linenumber AS place, max(l_partkey) AS pk, max(l_suppkey) AS sk, max(CAST(l_quantity AS BIGINT)) AS q, max(CAST(round(l_discount * 100) AS BIGINT)) AS disc,
            max(CAST(round(l_tax * 100) AS BIGINT)) AS tax, max(l_returnflag) AS rf, max(l_linestatus) AS ls, max(l_shipdate) AS sd FROM lineitem GROUP BY 1, 2),
    b AS (SELECT o.o_custkey AS package, o.o_orderkey AS answer, o.o_orderdate AS at, l.*, min(l.place) OVER (PARTITION BY l.l_orderkey) AS fp FROM l JOIN orders o ON o.o_orderkey = l.l_orderkey),
    c AS (SELECT *, disc >= 9 AND place <> fp AS folded, nullif(sk % 4, 0) AS page, nullif(q % 3, 0) AS stated FROM b),
    u AS (SELECT package, page, arg_min(stated, (-n, stated)) AS usual FROM (SELECT package, page, stated, count(*) AS n FROM c WHERE page IS NOT NULL AND stated IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
    s AS (
        SELECT c.answer * 8 + c.place AS sid, c.package, c.answer, c.at, c.place, c.folded, c.answer * 8 + CASE WHEN c.folded THEN c.fp ELSE c.place END AS carrier, c.page, coalesce(c.stated, u.usual, 1) AS round,
            CASE WHEN c.folded THEN 'check' ELSE CASE c.rf WHEN 'A' THEN 'different' WHEN 'N' THEN 'check' ELSE 'same' END END AS status, c.ls = 'F' AS compared,
            CASE WHEN NOT c.folded THEN CASE c.tax WHEN 1 THEN 'fixed' WHEN 2 THEN 'still_wrong' WHEN 3 THEN 'new' WHEN 4 THEN 'still_not_compared' END END AS told,
            CASE WHEN NOT c.folded AND c.q >= 46 THEN CASE WHEN c.pk % 2 = 0 THEN 'not_a_problem' ELSE 'agreed' END END AS decision, c.sd AS decided_at, 'person ' || c.sk % 3 AS decided_by,
            CASE WHEN NOT c.folded AND c.tax >= 7 THEN 'r' || c.pk % 10 END AS record, CASE WHEN NOT c.folded AND c.tax = 0 THEN 'd' || c.pk % 12 END AS label, CASE WHEN c.place < 7 THEN 'k' || c.pk % 9 ELSE '' END AS words,
            c.disc >= 2 AND c.sk % 3 < 2 AND c.page IS NOT NULL AS spot, CASE WHEN c.sk % 5 <> 0 THEN 'f' || c.sk % 2 END AS file, (c.pk % 30) * 12 AS x0, (c.pk % 30) * 12 + (c.sk % 3) * 40 AS x1, (c.q % 10) * 12 AS y0,
            row_number() OVER (PARTITION BY c.package ORDER BY c.at, c.answer, c.place) AS i, dense_rank() OVER (PARTITION BY c.package ORDER BY c.at, c.answer) AS a
        FROM c LEFT JOIN u ON u.package = c.package AND u.page = c.page)"""

#: The greedy fold as SQL states it: one link of every package a step, groups as lists.
LINKS = f"""WITH RECURSIVE {SIGHTINGS},
    k AS (SELECT *, row_number() OVER (PARTITION BY answer, words, round ORDER BY coalesce(page, 0), i) AS kth, dense_rank() OVER (PARTITION BY answer, words ORDER BY round) AS ro, min(i) OVER (PARTITION BY answer, words) AS wi FROM s WHERE words <> ''),
    pairs AS (
        SELECT f.package, 0 AS phase, f.a AS p1, 0 AS p2, f.i AS p3, 0 AS p4, 0 AS p5, f.i AS n, m.i AS o, CAST(NULL AS BIGINT) AS oa FROM s f JOIN s m ON m.answer = f.answer AND m.carrier = f.carrier AND NOT m.folded WHERE f.folded
        UNION ALL SELECT x.package, 0, x.a, 1, x.wi, x.ro, x.kth, x.i, y.i, CAST(NULL AS BIGINT) FROM k x JOIN k y ON y.answer = x.answer AND y.words = x.words AND y.ro = x.ro + 1 AND y.kth = x.kth
        UNION ALL SELECT package, 1, p1, strength, p3, p4, p5, p3, p5, p4 FROM (
            SELECT x.package, x.a AS p1, x.i AS p3, y.a AS p4, y.i AS p5, CASE WHEN x.record = y.record THEN 0 WHEN x.label = y.label THEN 1
                WHEN x.page = y.page AND x.spot AND y.spot AND (x.file IS NULL OR y.file IS NULL OR x.file = y.file)
                    AND greatest(0, greatest(x.x0, y.x0) - least(x.x1, y.x1)) ** 2 + greatest(0, greatest(x.y0, y.y0) - least(x.y0, y.y0)) ** 2 <= 324 THEN 2
                WHEN x.page = y.page AND x.words = y.words AND x.words <> '' THEN 3 END AS strength
            FROM s x JOIN s y ON y.package = x.package AND y.a < x.a) WHERE strength IS NOT NULL),
    steps AS (SELECT package, n, o, oa, row_number() OVER (PARTITION BY package ORDER BY phase, p1, p2, p3, p4, p5) AS step FROM pairs),
    m AS (SELECT package, list(answer || ':' || round ORDER BY i) AS marks, list(answer || ':' || round || ':' || carrier ORDER BY i) AS carriers, list(i ORDER BY i) AS own, list(sid ORDER BY i) AS sids FROM s GROUP BY package),
    f AS (
        SELECT package, CAST(0 AS BIGINT) AS step, own AS g, CAST([] AS VARCHAR[]) AS linked FROM m
        UNION ALL
        SELECT package, step, CASE WHEN ok THEN list_transform(g, lambda v: CASE WHEN v = greatest(one, two) THEN least(one, two) ELSE v END) ELSE g END,
            CASE WHEN ok AND oa IS NOT NULL THEN list_append(linked, n || ':' || oa) ELSE linked END
        FROM (
            SELECT *, NOT skip AND (one = two OR len(list_distinct(list_transform(met, lambda z: carriers[z]))) = len(list_distinct(list_transform(met, lambda z: marks[z])))) AS ok
            FROM (
                SELECT f.package, steps.step, f.g, f.linked, steps.n, steps.oa, f.g[steps.n] AS one, f.g[steps.o] AS two, coalesce(list_contains(f.linked, steps.n || ':' || steps.oa), FALSE) AS skip, m.marks, m.carriers,
                    list_filter(m.own, lambda z: f.g[z] = f.g[steps.n] OR f.g[z] = f.g[steps.o]) AS met
                FROM f JOIN steps ON steps.package = f.package AND steps.step = f.step + 1 JOIN m ON m.package = f.package))),
    ends AS (SELECT package, arg_max(g, step) AS g FROM f GROUP BY package),
    links AS (SELECT s.sid, m.sids[ends.g[s.i]] AS item FROM s JOIN ends ON ends.package = s.package JOIN m ON m.package = s.package)"""

ITEMS = f"""{LINKS},
    t AS (SELECT s.*, links.item FROM s JOIN links ON links.sid = s.sid),
    pr AS (
        SELECT item, package, round, arg_max(status, (t.at, NOT t.folded, answer, place)) AS status, arg_max({{'v': told}}, (t.at, NOT t.folded, answer, place)).v AS told, arg_max({{'v': page}}, (t.at, NOT t.folded, answer, place)).v AS page
        FROM t WHERE status <> 'same' OR compared GROUP BY 1, 2, 3),
    nx AS (SELECT *, lead(round) OVER (PARTITION BY item ORDER BY round) AS next FROM pr),
    w AS (
        SELECT item, package, min(round) AS first_round, bool_or(status <> 'same') AS any_open, bool_or(status = 'different') AS ever_wrong, count(DISTINCT answer) AS checks_seen, count(*) AS sightings,
            arg_max(decision, (decided_at, t.at, answer, place)) FILTER (WHERE decision IS NOT NULL) AS decision, arg_max(decided_by, (decided_at, t.at, answer, place)) FILTER (WHERE decision IS NOT NULL) AS decided_by,
            coalesce(bool_or(told = 'new'), FALSE) AS any_new, min(t.at) AS first_seen, max(t.at) AS last_seen FROM t GROUP BY 1, 2),
    z AS (
        SELECT item, max(round) AS round_now, arg_max(status, round) AS status_now, arg_max({{'v': told}}, round).v AS told_now, arg_max({{'v': page}}, round).v AS page, max(round) FILTER (WHERE status <> 'same') AS last_wrong,
            count(*) FILTER (WHERE status = 'different') AS times FROM nx GROUP BY item),
    fx AS (SELECT z.item, min(nx.round) AS fixed FROM z JOIN nx ON nx.item = z.item WHERE z.status_now = 'same' AND nx.round > z.last_wrong GROUP BY z.item),
    j AS (
        SELECT w.*, z.round_now, z.status_now, z.told_now, z.page, z.times, CASE WHEN z.status_now = 'same' THEN fx.fixed WHEN z.told_now IN ('fixed', 'now_right') THEN z.round_now + 1 END AS fixed,
            min(w.first_round) OVER (PARTITION BY w.package) AS begins
        FROM w JOIN z ON z.item = w.item LEFT JOIN fx ON fx.item = w.item),
    st AS (SELECT *, CASE WHEN decision = 'not_a_problem' THEN 'not_a_problem' WHEN fixed IS NOT NULL THEN 'fixed' WHEN status_now = 'same' THEN 'right_later' ELSE 'open' END AS state FROM j WHERE any_open),
    items AS (
        SELECT item, package, state, CASE WHEN state = 'open' THEN CASE status_now WHEN 'different' THEN 'wrong' ELSE 'decision' END END AS open_kind, CASE WHEN state = 'fixed' THEN fixed END AS fixed_round,
            array_to_string(list_filter([CASE WHEN first_round > 1 AND (first_round > begins OR any_new) THEN 'New' END, CASE WHEN state = 'open' AND (times >= 2 OR told_now = 'still_wrong') THEN 'Previous comment not addressed' END,
                CASE WHEN state = 'open' AND told_now = 'still_not_compared' THEN 'Still not compared' END], lambda v: v IS NOT NULL), ', ') AS tags,
            first_round, round_now, page, ever_wrong, checks_seen, sightings, decision, decided_by, first_seen, last_seen FROM st),
    rc AS (
        SELECT r.package, r.round, count(x.item) AS items, count(*) FILTER (WHERE x.status <> 'same' AND x.state <> 'not_a_problem') AS open, count(*) FILTER (WHERE x.status = 'different' AND x.state <> 'not_a_problem') AS wrong,
            count(*) FILTER (WHERE x.status = 'check' AND x.state <> 'not_a_problem') AS decision, (SELECT count(*) FROM items y WHERE y.package = r.package AND y.fixed_round = r.round) AS fixed
        FROM (SELECT DISTINCT package, round FROM s) r LEFT JOIN (SELECT nx.*, items.state FROM nx JOIN items ON items.item = nx.item) x ON x.package = r.package AND x.round = r.round GROUP BY r.package, r.round)"""


#: What a line says, as small numbers in one long (name, least, how many), so that rows are short where they are moved; 0 is null.
SAID = [("pk", -179, 359), ("sk", -59, 119), ("q", -29, 59), ("many", 0, 2), ("disc", 0, 3), ("tax", -1, 9), ("rf", 0, 3), ("ls", 0, 2), ("folded", 0, 2)]
#: The columns of a sighting that are moved; all others follow from them.
MOVED = ["package", "answer", "at", "place", "fp", "sd", "said"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of an order (``MOVED``), dealt by package; a line of a large discount is folded into the order's first line.
    Both tables are dealt by order once."""
    cent = lambda c: F.round(F.col(c) * 100).cast("long")
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").cast("long").alias("q"), cent("l_discount").alias("disc"),
        cent("l_tax").alias("tax"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_shipdate").alias("sd"),
    )
    l = l.repartition("answer").groupBy("answer", "place").agg(*[F.max(c).alias(c) for c in l.columns[2:]])
    l = l.withColumn("fp", F.min("place").over(Window.partitionBy("answer")))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("answer"), F.col("o_orderdate").alias("at"))
    b = l.join(o.hint("merge"), "answer")
    level = F.when(F.col("disc") >= 9, 2).when(F.col("disc") >= 2, 1).when(F.col("disc").isNotNull(), 0)
    parts = {
        "pk": F.col("pk") % 180, "sk": F.col("sk") % 60, "q": F.col("q") % 30, "many": F.col("q") >= 46, "disc": level, "tax": F.when(F.col("tax").isNotNull(), F.greatest(F.least("tax", F.lit(7)), F.lit(-1))),
        "rf": F.when(F.col("rf") == "A", 0).when(F.col("rf") == "N", 1).when(F.col("rf") == "R", 2), "ls": F.col("ls") == "F", "folded": (F.col("disc") >= 9) & (F.col("place") != F.col("fp")),
    }
    said = F.lit(0).cast("long")
    for name, least, n in SAID:
        said = said * (n + 1) + F.coalesce(parts[name].cast("long") - least + 1, F.lit(0))
    return b.withColumn("said", said).select(*MOVED).repartition("package")


def described(rows: DataFrame) -> DataFrame:
    """The sightings that ``MOVED`` columns stand for."""
    said, below, found = F.col("said"), 1, {}
    for name, least, n in reversed(SAID):
        part = F.pmod(((said - F.pmod(said, F.lit(below))) / F.lit(below)).cast("long"), F.lit(n + 1))  # exact: all is below 2 ** 53
        found[name], below = F.when(part > 0, part + (least - 1)), below * (n + 1)
    b = rows.withColumns(found).withColumn("folded", F.col("folded") == 1)
    own, sid = ~F.col("folded"), F.col("answer") * 8
    pick = lambda c, *values: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in values])
    word = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    x0, y0 = (F.col("pk") % 30 * 12).cast("double"), (F.col("q") % 10 * 12).cast("double")
    box = F.struct(F.when(F.col("sk") % 5 != 0, word("f", "sk", 2)).alias("file"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("sk") % 3 * 40).alias("x1"), y0.alias("y1"))
    return b.select(
        *rows.columns,
        (sid + F.col("place")).alias("sid"), "folded", (sid + F.when(own, F.col("place")).otherwise(F.col("fp"))).alias("carrier"), F.nullif(F.col("sk") % 4, F.lit(0)).alias("page"),
        F.nullif(F.col("q") % 3, F.lit(0)).alias("stated_round"), F.when(~own, "check").otherwise(pick("rf", (0, "different"), (1, "check"), (2, "same"))).alias("status"), (F.col("ls") == 1).alias("compared"),
        J.told(F.when(own, pick("tax", (1, "fixed_in_later_round"), (2, "still_wrong"), (3, "new"), (4, "still_not_compared")))).alias("told"),
        F.when(own & (F.col("many") == 1), F.when(F.col("pk") % 2 == 0, "not_a_problem").otherwise("agreed")).alias("decision"), F.col("sd").alias("decided_at"), word("person ", "sk", 3).alias("decided_by"),
        F.when(own & (F.col("tax") >= 7), word("r", "pk", 10)).alias("record"), F.when(own & (F.col("tax") == 0), word("d", "pk", 12)).alias("label"), F.when(F.col("place") < 7, word("k", "pk", 9)).otherwise("").alias("words"),
        F.when(F.col("disc") >= 1, box).alias("box"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of an order, dealt by package."""
    return K.filled_rounds(described(lines(spark, sf_dir)))


def orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package) once for every line, for counting: a line that repeats counts again."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("answer"))
    return o.join(n, "answer").select("package", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sightings with their items, dealt by package."""
    rows = K.linked(sightings(spark, sf_dir), [*MOVED, "round"], orders_lines(spark, sf_dir))
    return described(rows.drop("sid").repartition("package"))


@query(f"{LINKS} SELECT sid, item FROM links")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of several checks of a package that are one item, the strongest links first."""
    return K.linked(sightings(spark, sf_dir), [], orders_lines(spark, sf_dir))


@query(f"{ITEMS} SELECT * FROM items")
def job_tracker_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: where each item stands now, from its rounds and decisions."""
    return J.items(tracked(spark, sf_dir))


@query(f"{ITEMS} SELECT * FROM rc")
def job_tracker_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: open, wrong and fixed items of each round of a package."""
    return J.round_counts(tracked(spark, sf_dir))


@query(f"""{ITEMS},
    v AS (SELECT c_custkey AS package, c_mktsegment AS vendor FROM customer),
    nf AS (SELECT item, min(round) AS first FROM nx WHERE status = 'different' AND (next = round + 1 OR told IN ('fixed', 'still_wrong')) GROUP BY item),
    vi AS (
        SELECT v.vendor, count(*) AS items, count(*) FILTER (WHERE x.mistake) AS mistakes, count(*) FILTER (WHERE x.state = 'open') AS open, count(*) FILTER (WHERE x.mistake AND nf.first IS NOT NULL) AS fixed_next_of,
            count(*) FILTER (WHERE x.mistake AND x.fixed_round = nf.first + 1) AS fixed_next
        FROM (SELECT *, ever_wrong AND state NOT IN ('not_a_problem', 'right_later') AS mistake FROM items) x JOIN v ON v.package = x.package LEFT JOIN nf ON nf.item = x.item GROUP BY v.vendor),
    vr AS (SELECT v.vendor, count(DISTINCT rc.package) AS sets, count(*) AS rounds, sum(rc.open) AS n FROM rc JOIN v ON v.package = rc.package GROUP BY v.vendor)
    SELECT vr.vendor, vr.sets, vr.rounds, vi.items, vi.mistakes, vi.open, vi.fixed_next, vi.fixed_next_of,
        CASE WHEN vi.fixed_next_of > 0 THEN CAST(round_even(100.0 * vi.fixed_next / vi.fixed_next_of, 0) AS BIGINT) END AS fixed_next_share, CAST(round_even(vr.n / vr.rounds, 1) AS DOUBLE) AS average_open
    FROM vr JOIN vi ON vi.vendor = vr.vendor""")
def vendor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: how often each vendor is wrong, and mends it by the next round."""
    s = K.written(tracked(spark, sf_dir), "tracked")
    sets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("package"), F.col("c_mktsegment").alias("vendor"))
    return J.vendor_records(sets, s, J.items(s))
