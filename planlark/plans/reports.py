"""Reports on usage, spending, packages, readiness, budgets and retention, over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.functions import scalars as S
from planlark.operators import relational as R
from planlark.plans.registry import query
from planlark.sources.io import table
from planlark.streaming import streams as T


def cents(c: str) -> Column:
    """Doubles are rounded to cents before they are summed, so sums do not depend on order."""
    return F.round(F.col(c) * 100).cast("long")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


@query("""
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS model, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
    GROUP BY GROUPING SETS ((CAST(CAST(ts AS DATE) AS VARCHAR), event_type), (CAST(CAST(ts AS DATE) AS VARCHAR)), ())""")
def usage_by_day_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open window, day and model, with totals at every level from one aggregation."""
    e = table(spark, sf_dir, "events").filter((F.col("ts") >= at("2024-01-05")) & (F.col("ts") < at("2024-01-20")))
    e = e.select(S.utc_day(F.col("ts")).cast("string").alias("day"), F.col("event_type").alias("model"), cents("value").alias("c"))
    return e.rollup("day", "model").agg(F.count("*").alias("calls"), F.sum("c").alias("cents"))


@query("""
    SELECT e.user_id, count(*) AS calls, CAST(sum(CAST(round(e.value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events e WHERE e.user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY e.user_id""")
def usage_by_user_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call once although its user has many orders: a semi join, so nothing fans out."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(o, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(cents("value")).alias("cents"))


@query("""
    SELECT source, sum(n)::BIGINT AS n, sum(c)::BIGINT AS cents FROM (
        SELECT event_type AS source, 1 AS n, CAST(round(value * 100) AS BIGINT) AS c FROM events
        UNION ALL SELECT o_orderpriority, 1, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders) GROUP BY source""")
def spend_merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources in one tally, dearest first."""
    a = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), cents("value").alias("c"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), cents("o_totalprice").alias("c"))
    return R.stacked(a, b).groupBy("source").agg(F.count("*").alias("n"), F.sum("c").alias("cents")).orderBy(F.desc_nulls_last("cents"), "source")


@query("""
    WITH s AS (SELECT user_id, ts, event_id, event_type, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS begun FROM events),
    l AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM s WHERE begun = 1),
    k AS (SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) AS last_type FROM l WHERE ended = 0 GROUP BY user_id)
    SELECT user_id, started_at, CASE WHEN last_type IN ('purchase', 'error') THEN last_at END AS finished_at,
        CASE last_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'reading' END AS outcome,
        CASE WHEN last_type IN ('purchase', 'error') THEN (epoch_us(last_at) - epoch_us(started_at)) // 1000 END AS duration_ms FROM k""")
def session_reading_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first signup of a user to the first purchase; an error ends it unless more follows."""
    return T.reading_times(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "ts", "event_type", "signup", ("purchase",), ("closed",), "error")


@query("""
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 W3 A5 W9."""
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.desc_nulls_last("ts"), F.desc("event_id")).drop("ts")


@query("""
    SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS n FROM orders) WHERE n = 1""")
def newest_run_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a customer's newest day."""
    return R.newest_run(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc_nulls_last("o_orderdate"))


@query("""
    SELECT c.c_mktsegment AS segment, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderkey END) AS finished,
        count(DISTINCT CASE WHEN l.l_returnflag = 'R' THEN o.o_orderkey END) AS returned, coalesce(bool_or(l.l_discount > 0.09), FALSE) AS any_high, max(o.o_orderdate) AS last_order
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_mktsegment""")
def distinct_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts are safe although lines fan out; lines are reduced per order before they join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_discount") > 0.09).alias("high"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if("r").alias("r"), F.bool_or("high").alias("high"), F.max("o_orderdate").alias("d"))
    both = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return both.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), total("f", "finished"), total("r", "returned"), F.coalesce(F.bool_or("high"), F.lit(False)).alias("any_high"), F.max("d").alias("last_order"))


@query("""
    SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '2000-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 101""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page by row values, with one row more when there is a next page (the limit is the feature)."""
    import datetime

    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return R.keyset_page(o, ["o_orderdate", "o_orderkey"], (datetime.datetime(2000, 1, 1), 500), 100)


@query("""
    SELECT DISTINCT o.o_orderkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate > o.o_orderdate + INTERVAL 400 DAY""")
def stale_after_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a shipment long after the order; shipments are reduced to their last before the join."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("checked"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return R.stale(o, lines, "o_orderkey", "checked", "l_shipdate")


@query("""
    WITH n AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS supersedes FROM events)
    SELECT a.user_id, a.event_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.supersedes = a.event_id)""")
def tip_of_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event supersedes its user's one before; the tips remain."""
    e = R.earlier_than(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id", "supersedes")
    return R.tip_of_chain(e.select("user_id", "event_id", "supersedes"), "event_id", "supersedes").select("user_id", "event_id")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def claimed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose number another line claims too are left out."""
    return R.claimed_once(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("""
    WITH i AS (SELECT l_suppkey, epoch_us(l_shipdate) // 60000000 AS a, epoch_us(l_shipdate) // 60000000 + CAST(l_quantity AS BIGINT) * 1440 AS b FROM lineitem),
    m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b) AS island FROM m),
    u AS (SELECT l_suppkey, island, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2)
    SELECT l_suppkey, count(*) AS intervals, sum(b - a)::BIGINT AS minutes FROM u GROUP BY l_suppkey""")
def interval_union_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time covered by a supplier's shipments, overlaps once."""
    start = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 60_000_000)
    i = table(spark, sf_dir, "lineitem").select("l_suppkey", start.alias("a"), (start + F.col("l_quantity").cast("long") * 1440).alias("b"))
    return R.interval_union(i, ["l_suppkey"], "a", "b").groupBy("l_suppkey").agg(F.count("*").alias("intervals"), F.sum(F.col("end") - F.col("start")).alias("minutes"))


@query("""
    WITH h AS (SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS earlier, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS later,
        string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY user_id)
    SELECT user_id, earlier, later, ids, CASE WHEN earlier < 3 AND later < 3 THEN 'steady' WHEN later - earlier <= -0.1 * (earlier + later) THEN 'improving'
        WHEN later - earlier >= 0.1 * (earlier + later) THEN 'worsening' ELSE 'steady' END AS trend FROM h""")
def trend_two_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of a user in two halves of a window, with their ids in order."""
    e = table(spark, sf_dir, "events").filter((F.col("event_type") == "error") & (F.col("ts") >= at("2024-01-01")) & (F.col("ts") < at("2024-01-31")))
    first = F.col("ts") < at("2024-01-16")
    g = e.groupBy("user_id").agg(F.count_if(first).alias("earlier"), F.count_if(~first).alias("later"), F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return g.withColumn("trend", R.trend(F.col("earlier"), F.col("later")))


@query("""
    SELECT n.n_name, count(o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'F') AS num, count(o.o_orderkey) AS den,
        CASE WHEN count(o.o_orderkey) = 0 THEN NULL ELSE round(CAST(count(o.o_orderkey) FILTER (WHERE o.o_orderstatus = 'F') AS DOUBLE) / count(o.o_orderkey), 6) END AS share
    FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900 LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name""")
def rate_with_null_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share is null where nothing was measured."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    both = table(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    g = both.groupBy("n_name").agg(F.count_if(F.col("o_orderstatus") == "F").alias("num"), F.count("o_orderkey").alias("den"))
    return g.withColumn("share", R.ratio(F.col("num"), F.col("den")))


@query("""
    SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor((event_id * 1000 * 0.003 + user_id * 100 * 0.015) * 1000 + 0.5) AS BIGINT) END AS micros,
        CASE WHEN event_type = 'error' THEN 'not_priced' ELSE 'priced' END AS state FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, NULL, 'not_priced' FROM events WHERE event_type = 'error'""")
def cost_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens priced at decimals per 1000, half up to micros; models without a price have no cost."""
    from planlark.sources.io import price_frame

    prices = price_frame(spark, {m: ("0.003", "0.015") for m in ("click", "view", "signup", "purchase")})
    e = table(spark, sf_dir, "events").join(F.broadcast(prices), F.col("event_type") == F.col("model"), "left")
    used = F.col("event_type") != "view"
    tokens_in, tokens_out = F.when(used, F.col("event_id") * 1000).otherwise(0), F.when(used, F.col("user_id") * 100).otherwise(0)
    micros = F.when(F.col("model").isNotNull(), S.call_cost_micros(tokens_in, tokens_out, F.col("input_per_1k"), F.col("output_per_1k")))
    return e.select("event_id", micros.alias("micros"), F.when(micros.isNull(), "not_priced").otherwise("priced").alias("state"))


@query("""
    SELECT user_id, sum(CAST(round(value * 10000) AS BIGINT))::BIGINT AS micros, CAST(CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DECIMAL(18,0)) / 1000000 AS DECIMAL(18,6))::VARCHAR AS usd,
        CASE WHEN sum(CAST(round(value * 10000) AS BIGINT)) >= 12000000 THEN 'EXHAUSTED' WHEN sum(CAST(round(value * 10000) AS BIGINT)) * 100 >= 12000000 * 80 THEN 'APPROACHING' ELSE 'AVAILABLE' END AS state,
        greatest(12000000 - sum(CAST(round(value * 10000) AS BIGINT)), 0)::BIGINT AS remaining FROM events GROUP BY user_id""")
def budget_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 Q12 U21."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 10000).cast("long")).alias("micros"))
    ceiling = T.nearest_ceiling(F.lit(None).cast("long"), F.lit(12_000_000).cast("long"), F.lit(99_000_000).cast("long"))
    return e.select("user_id", "micros", S.usd(F.col("micros")).alias("usd"), T.budget_state(F.col("micros"), ceiling).alias("state"), F.greatest(ceiling - F.col("micros"), F.lit(0).cast("long")).alias("remaining"))


@query("""
    SELECT event_id, event_type FROM events WHERE user_id % 7 <> 0 AND
        date_diff('day', CAST(ts AS DATE), DATE '2024-06-01') > CASE event_type WHEN 'click' THEN 90 WHEN 'view' THEN 30 WHEN 'error' THEN 180 WHEN 'signup' THEN 365 WHEN 'purchase' THEN 2555 END""")
def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past the age of their class, and under no hold."""
    kinds = {"click": "log", "view": "trace", "error": "render", "signup": "crop", "purchase": "original"}
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    holds = e.filter(F.col("user_id") % 7 == 0).select("user_id")
    return T.retention_due(e.withColumn("kind", kind), holds, "user_id", "kind", "ts", at("2024-06-01")).select("event_id", "event_type")


@query("""
    SELECT event_id, before, event_type AS state, coalesce(before, '-') || '>' || event_type IN ('->signup', 'signup>view', 'view>click', 'click>purchase', 'click>view', 'view>view') AS legal
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def legal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7."""
    legal = {(None, "signup"), ("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("view", "view")}
    return T.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", legal).select("event_id", "before", F.col("event_type").alias("state"), "legal")


@query("""
    SELECT event_id, count(*) OVER w AS requests, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents_in_window
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)""")
def rate_window_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and sums of the 60 seconds up to each call."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", cents("value").alias("cents"))
    return T.rate_window(e, ["event_type"], "ts", 60, "cents").select("event_id", "requests", "cents_in_window")


@query("""
    SELECT event_type, count(*) AS users FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) GROUP BY event_type""")
def live_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 Q6."""
    return T.latest_states(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").withColumnRenamed("count", "users")


@query("""
    SELECT user_id, max(ts) AS last, max(ts) < TIMESTAMP '2024-01-30' AS stale FROM events GROUP BY user_id""")
def stale_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    return T.stale_jobs(table(spark, sf_dir, "events"), "user_id", "ts", at("2024-01-30 00:01:00"), 60)


@query("""
    SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS refusals,
        CASE WHEN bool_or(event_type = 'purchase' AND value > 50) THEN 'done' WHEN count(*) FILTER (WHERE event_type = 'error') >= 20 THEN 'abandoned' ELSE 'waiting' END AS state FROM events GROUP BY user_id""")
def outbox_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    result = F.when(F.col("event_type") == "error", "refused").when((F.col("event_type") == "purchase") & (F.col("value") > 50), "done").otherwise("sent")
    return T.attempt_state(table(spark, sf_dir, "events").withColumn("result", result), "user_id")


@query("""
    SELECT event_id, user_id FROM events WHERE event_id > 900 ORDER BY event_id LIMIT 50""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next rows of a log after an offset (the limit is the feature)."""
    return T.tail(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 900, 50)


@query("""
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_brand FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
    WHERE CAST(l.l_quantity AS INTEGER) = p.p_size""")
def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's answer is reused where the content is the same."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.col("p_size").alias("content"))
    new = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("content"))
    return T.carried_forward(old, new, "l_partkey", "content").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


@query("""
    SELECT r.r_name, c.c_mktsegment AS segment, count(*) AS corrections, count(DISTINCT o.o_custkey) AS customers FROM orders o
    JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
    WHERE o.o_orderdate >= TIMESTAMP '1998-01-01' AND o.o_orderdate <= TIMESTAMP '1998-12-31' AND o.o_orderpriority LIKE '1-%' GROUP BY 1, 2""")
def correction_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed window, and a chain of joins whose small tables Catalyst broadcasts by size."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate").between(at("1998-01-01"), at("1998-12-31")) & F.col("o_orderpriority").startswith("1-"))
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    both = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    return both.groupBy("r_name", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("corrections"), F.count_distinct("o_custkey").alias("customers"))


@query("""
    SELECT p.p_partkey, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 49) THEN 'no large line' ELSE 'not returned' END AS reason
    FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 49 AND l.l_returnflag = 'R')""")
def not_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was left out, and why: anti joins, the first reason wins."""
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("back"))
    p = table(spark, sf_dir, "part").select("p_partkey").join(large, "p_partkey", "left").filter(~F.coalesce("back", F.lit(False)))
    return p.select("p_partkey", F.when(F.col("back").isNull(), "no large line").otherwise("not returned").alias("reason"))


@query("""
    SELECT event_type, count(*) AS interventions FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND event_type NOT IN ('view', 'click') GROUP BY event_type""")
def recovery_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 F1 F2."""
    e = table(spark, sf_dir, "events").filter((F.col("ts") >= at("2024-01-10")) & (F.col("ts") < at("2024-01-12")) & ~F.col("event_type").isin("view", "click"))
    return e.groupBy("event_type").agg(F.count("*").alias("interventions"))


@query("""
    SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS paise, CASE WHEN sum(CAST(round(o_totalprice * 100) AS BIGINT)) < 100000000 THEN 'below'
        WHEN sum(CAST(round(o_totalprice * 100) AS BIGINT)) <= 300000000 THEN 'within' ELSE 'above' END AS plan FROM orders GROUP BY o_custkey""")
def plan_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("paise"))
    return g.withColumn("plan", F.when(F.col("paise") < 100_000_000, "below").when(F.col("paise") <= 300_000_000, "within").otherwise("above"))


@query("""
    SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50""")
def json_path_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number from JSON text."""
    k = S.json_numbers(F.col("props"), "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 50")


@query("""
    WITH e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN user_id END AS direct, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
    SELECT e.event_id, c.c_custkey, c.c_mktsegment, e.direct IS NULL AS by_order FROM e LEFT JOIN orders o ON o.o_orderkey = e.k JOIN customer c ON c.c_custkey = coalesce(e.direct, o.o_custkey)""")
def owners_by_either_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's owner is named by itself, or by the order that it speaks of."""
    direct = F.when(F.col("event_type").isin("click", "purchase"), F.col("user_id"))
    e = table(spark, sf_dir, "events").select("event_id", direct.alias("direct"), S.json_numbers(F.col("props"), "$.k").alias("o_orderkey"))
    return R.by_either_path(e, "direct", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(
        "event_id", "c_custkey", "c_mktsegment", F.col("direct").isNull().alias("by_order")
    )


@query("""
    SELECT user_id, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE CAST(props->>'$.k' AS BIGINT) % 5 <> 0 GROUP BY user_id""")
def usage_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage counts invocations that called a model, not answers that were used again."""
    k = S.json_numbers(F.col("props"), "$.k")
    packet = F.to_json(F.struct(k.alias("question"), F.when(k % 5 == 0, F.concat(F.lit("answer "), F.col("event_id"))).alias(S.REUSED)))
    calls = table(spark, sf_dir, "events").withColumn("packet", packet).filter(S.made_a_call(F.col("packet")))
    return calls.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(cents("value")).alias("cents"))


@query("""
    WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, CAST(props->>'$.k' AS BIGINT) AS k, ts FROM events)
    SELECT user_id, CAST(day AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) - 1 AS place,
        '{"cents":' || cents || ',"id":' || event_id || ',"props":{"k":' || k || '},"type":"' || event_type || '"}' AS found
    FROM e WHERE (event_type = 'purchase' OR event_type = 'error') AND k >= 20""")
def json_path_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the JSON array of a user's day, every element of two types whose props pass."""
    e = table(spark, sf_dir, "events").withColumn("day", S.utc_day(F.col("ts")).cast("string"))
    block = F.struct("ts", "event_id", cents("value").alias("cents"), F.col("event_id").alias("id"), F.from_json("props", "k long").alias("props"), F.col("event_type").alias("type"))
    answers = e.groupBy("user_id", "day").agg(F.to_json(F.transform(F.array_sort(F.collect_list(block)), lambda b: b.dropFields("ts", "event_id"))).alias("blocks"))
    keep = lambda b: S.text_at(b, "$.type").isin("purchase", "error") & (F.try_variant_get(b, "$.props.k", "long") >= 20)
    found = answers.select("user_id", "day", F.posexplode(S.json_elements(F.col("blocks"), keep)).alias("place", "found"))
    return found.select("user_id", "day", "place", F.to_json("found").alias("found"))


@query("""
    SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT concat(user_id, '|', CAST(ts AS DATE))) FILTER (WHERE value > 10) AS active_days,
        min(ts) AS first_at, max(ts) AS last_at, median(CAST(round(value * 100) AS BIGINT))::DOUBLE AS median_cents FROM events GROUP BY event_type HAVING count(*) > 10""")
def reading_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs are counted as structs, so null parts do not merge; no type's values meet in one task."""
    day = F.struct("user_id", S.utc_day(F.col("ts")))
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 10, day)).alias("active_days"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )
    middle = R.exact_medians(e.select("event_type", cents("value").alias("cents")), ["event_type"], "cents")
    return g.filter("n > 10").join(middle.withColumnRenamed("median", "median_cents"), "event_type")


@query("""
    SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, arg_min(event_type, (-n, event_type)) AS most, max(n) AS votes
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def majority_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in order, and the most frequent one, ties to the lowest."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    kinds = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return R.majority(e, "user_id", "event_type").withColumnRenamed("event_type", "most").join(kinds, "user_id")


@query("""
    WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey), c AS (SELECT o.o_custkey, s.flags FROM orders o JOIN s ON s.l_orderkey = o.o_orderkey)
    SELECT o_custkey, count(*) AS orders, CASE WHEN bool_and(list_contains(flags, 'A')) THEN 'A' ELSE '' END || CASE WHEN bool_and(list_contains(flags, 'N')) THEN 'N' ELSE '' END || CASE WHEN bool_and(list_contains(flags, 'R')) THEN 'R' ELSE '' END AS shared
    FROM c GROUP BY o_custkey""")
def shared_by_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that every order of a customer has."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    c = table(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.collect_list("flags").alias("all"))
    return c.select("o_custkey", "orders", F.array_join(R.shared_by_all(F.col("all")), "").alias("shared"))


@query("""
    SELECT e.event_id, e.user_id, e.value, (SELECT p.event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) AS last_purchase
    FROM events e WHERE e.event_type = 'click'""")
def as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the newest purchase at or before it, in one window over both."""
    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "value", "ts")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return R.as_of(clicks, bought, "user_id", "ts", "last_purchase").select("event_id", "user_id", "value", "last_purchase")
