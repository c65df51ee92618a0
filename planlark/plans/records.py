"""Single operators over the test tables: refusals, seals, vetoes, costs, queues, overlaps and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.functions import scalars as S
from planlark.functions import units as U
from planlark.operators import evidence as E
from planlark.operators import geometry as G
from planlark.operators import metrics as M
from planlark.operators import relational as R
from planlark.operators import retrieval as X
from planlark.operators import rules as B
from planlark.operators import verdict as V
from planlark.plans.geometry import BOX, box_classes, part_boxes
from planlark.plans.registry import ORACLE_SQL, query
from planlark.plans.reports import at
from planlark.plans.retrieval import paired_readers
from planlark.plans.verdicts import parameter_layering
from planlark.sources.io import table
from planlark.sources.work import written
from planlark.streaming import streams as T


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'NO_APPLICABLE_RULE' WHEN o_custkey % 5 = 0 THEN 'REVIEW_REQUIRED' WHEN o_orderkey % 3 = 0 THEN 'AMBIGUOUS_MATCH' WHEN o_orderkey % 11 = 0 THEN 'REVIEW_REQUIRED'
        WHEN o_custkey % 2 = 0 AND o_orderkey % 2 = 0 THEN 'NOT_FOUND' WHEN o_orderkey % 13 = 0 THEN 'REVIEW_REQUIRED' WHEN o_totalprice <= 150000 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM orders""")
def rule_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each abstention in its place before the verdict, made from the keys of an order."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    result = V.maximum(F.col("o_totalprice"), F.lit(150000))
    outcome = B.engine_outcome(F.when(c % 7 == 0, V.NO_APPLICABLE_RULE), c % 5 == 0, k % 3 == 0, k % 11 == 0, (c % 2 == 0) & (k % 2 == 0), k % 13 == 0, result, F.lit(V.NOT_FOUND), F.lit("AMBIGUOUS_MATCH"))
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"))


@query("""
    SELECT p_partkey, p_size * 2 AS twice, p_size * 2 - 10 AS off, (p_size * 2 - 10) * (p_size * 2) AS product FROM part""")
def derivation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each derivation may use those before it."""
    steps = [("twice", F.col("p_size") * 2), ("off", F.col("twice") - 10), ("product", F.col("off") * F.col("twice"))]
    return B.derived(table(spark, sf_dir, "part"), steps).select("p_partkey", *[n for n, _ in steps])


@query("""
    SELECT c_mktsegment AS project, 'depth' AS name, 'overridden' AS state FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1
    UNION ALL SELECT c_mktsegment, 'gap', 'overridden' FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1
    UNION ALL SELECT DISTINCT c_mktsegment, 'margin', 'outstanding' FROM customer""")
def override_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a layer changed, and what is required but set nowhere."""
    needed = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project")).distinct()
    required = needed.select("project", F.explode(F.array(*[F.lit(n) for n in ("gap", "depth", "margin")])).alias("name"))
    return B.overrides(parameter_layering(spark, sf_dir), required, ["project"])


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 'EMPTY_TEXT' WHEN l_quantity > 45 THEN 'UNPARSED' WHEN l_returnflag = 'R' THEN 'NO_UNIT' WHEN l_returnflag = 'A' THEN 'UNKNOWN_UNIT' WHEN l_linenumber = 1 THEN 'BAD_PAGE' WHEN l_discount > 0.05 THEN 'BAD_CONFIDENCE' END AS refusal FROM lineitem""")
def candidate_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason for which a reading is no observation; blank text is empty."""
    c = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 7 == 0, "  ").otherwise("x").alias("raw_text"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("parsed_value"),
        F.when(F.col("l_returnflag") == "A", "yd").when(F.col("l_returnflag") != "R", "in").alias("unit_guess"), (F.col("l_linenumber") - 1).alias("page"), F.when(F.col("l_discount") > 0.05, 1.5).otherwise(0.5).alias("confidence"),
    )
    return E.normalize(c).select("l_orderkey", "l_linenumber", "refusal")


@query(f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 AND a_text = b_text THEN a_text END AS value,
        CASE WHEN l_linenumber = 7 THEN 'held' WHEN a_text IS NULL OR b_text IS NULL THEN 'one_reader' WHEN a_text <> b_text THEN 'disagree' ELSE 'sealed' END AS state FROM ({ORACLE_SQL["paired_readers"]})""")
def sealed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers seal a label only where both say the same and nothing holds it."""
    seal = E.seal_label(F.col("a_text"), F.col("b_text"), F.col("l_linenumber") == 7)
    return paired_readers(spark, sf_dir).select("l_orderkey", "l_linenumber", seal.alias("s")).select("l_orderkey", "l_linenumber", "s.value", "s.state")


@query("""
    SELECT l_orderkey, l_linenumber, CAST(2 * abs(7 * a - b * b) AS BIGINT) AS twice FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 9 AS a, l_partkey % 9 AS b FROM lineitem)""")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the area of the parallelogram on (a, b) and (b, 7), by the shoelace sum; 0 is no polygon."""
    a, b = (F.col("l_suppkey") % 9).cast("long"), (F.col("l_partkey") % 9).cast("long")
    zero, seven = F.lit(0).cast("long"), F.lit(7).cast("long")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = F.array(point(zero, zero), point(a, b), point(a + b, b + seven), point(b, seven))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", E.twice_area(corners).alias("twice"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.02 OR l_suppkey % 10 = 0 THEN 'unchecked' WHEN abs(l_quantity - (l_suppkey % 10) * 5) * 100 > (l_suppkey % 10) * 5 * 20 THEN 'vetoed' ELSE 'kept' END AS state FROM lineitem""")
def drawn_length_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sealed value against the drawn length; none, or 0, leaves it unchecked."""
    drawn = F.when(F.col("l_tax") >= 0.02, F.col("l_suppkey") % 10 * 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.length_veto(F.col("l_quantity"), drawn, 20).alias("state"))


@query("""
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'picture' ELSE 'blank' END WHEN p_size % 4 * 2 >= 5 THEN 'drawing' WHEN p_partkey % 3 * 150 >= 200 THEN 'text' ELSE 'other' END AS kind FROM part""")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page is, by its dimensions, words and images."""
    return table(spark, sf_dir, "part").select("p_partkey", G.page_type(F.col("p_size") % 4 * 2, F.col("p_partkey") % 3 * 150, (F.col("p_partkey") + 1) % 2).alias("kind"))


@query(f"""
    WITH i AS ({ORACLE_SQL["box_iou"]})
    SELECT 'mean_iou' AS metric, count(*) AS pairs, round(avg(common::DOUBLE / joined), 6) AS value FROM i
    UNION ALL SELECT 'localisation_rate', count(*), round(count(*) FILTER (WHERE l_id % 3 = r_id % 3 AND common * 2 >= joined)::DOUBLE / count(*), 6) FROM i""")
def mean_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean overlap of boxes, and the share that is on the same page with half in common."""
    l, r = (b.groupBy(*BOX[n], (F.col(f"{n}_id") % 3).alias(f"{n}_page")).agg(F.count("*").alias(f"{n}_n")) for n, b in zip("lr", part_boxes(spark, sf_dir), strict=True))
    # boxes of one place, size and page are one row with their number; a pair of such rows stands for all its pairs
    pairs = written(box_classes(l, r).select("common", "joined", (F.col("l_page") == F.col("r_page")).alias("same_page"), (F.col("l_n") * F.col("r_n")).alias("n")), "overlaps")
    return M.mean_iou(pairs).unionByName(M.localisation(pairs, 50).select("metric", F.col("den").alias("pairs"), "value"))


@query("""
    WITH s AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'invalid' WHEN p_size % 4 = 3 THEN 'unsure' WHEN p_size % 4 = p_partkey % 4 THEN 'right' ELSE 'wrong' END AS a, CASE WHEN p_size % 7 = 0 THEN 'invalid' WHEN p_size % 3 = 2 THEN 'unsure' WHEN p_size % 3 = p_partkey % 4 THEN 'right' ELSE 'wrong' END AS b FROM part)
    SELECT a, b, CASE WHEN a = 'right' AND b = 'right' THEN 'both_right' WHEN a = 'wrong' AND b = 'wrong' THEN 'both_wrong' WHEN 'right' IN (a, b) THEN 'one_right' ELSE 'none_right' END AS pair, count(*) AS items FROM s GROUP BY 1, 2""")
def reader_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader right, wrong, unsure or invalid, and the two together."""
    size, key = F.col("p_size"), F.col("p_partkey") % 4
    a = M.reader_state(F.when(size % 4 != 3, size % 4), key, size % 5 != 0)
    b = M.reader_state(F.when(size % 3 != 2, size % 3), key, size % 7 != 0)
    both = table(spark, sf_dir, "part").select(a.alias("a"), b.alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("items")).withColumn("pair", M.pair_state(F.col("a"), F.col("b")))


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 0 END WHEN event_type = 'view' AND user_id % 2 = 1 THEN 77 WHEN event_type = 'view' THEN 0 ELSE user_id END AS cost FROM events""")
def charged_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cost, 0 for what was never served, priced again where 0 was stored although tokens were used."""
    kind, odd = F.col("event_type"), F.col("user_id") % 2 == 1
    stored = F.when(kind == "view", F.lit(0).cast("long")).when(kind != "error", F.col("user_id").cast("long"))
    cost = S.charged_cost(stored, F.when(kind == "error", "failed").otherwise("done"), odd, F.lit(77).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", cost.alias("cost"))


@query("""
    SELECT event_id FROM events WHERE event_type <> 'purchase' AND ts < TIMESTAMP '2024-01-15 11:30:00'""")
def stuck_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: not done and older than half an hour at a given time."""
    return T.stuck(table(spark, sf_dir, "events"), "ts", at("2024-01-15 12:00:00"), 30, F.col("event_type") == "purchase").select("event_id")


@query("""
    SELECT l_orderkey, l_linenumber, sqrt(l_suppkey % 50 + l_linenumber * l_linenumber) - sqrt(l_suppkey % 50) >= 1 AS clear FROM lineitem""")
def clear_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next is a whole unit farther than the nearest, from squared distances."""
    near = (F.col("l_suppkey") % 50).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.clearly_nearer(near, near + F.col("l_linenumber") * F.col("l_linenumber"), 1.0).alias("clear"))


@query("""
    SELECT p_partkey, CAST(x * x + greatest(abs(y - 5) - 5, 0) * greatest(abs(y - 5) - 5, 0) AS DOUBLE) AS squared, least(60.0, pow(2.0, p_size % 9))::DOUBLE AS wait, CAST(ceil(3.0::DOUBLE + 0.3::DOUBLE * p_size) AS BIGINT) AS low, CAST(ceil(5.0::DOUBLE + 0.5::DOUBLE * p_size) AS BIGINT) AS high,
        sha256(concat('v:', p_partkey, chr(31), CASE WHEN p_size % 3 = 0 THEN 'n' ELSE concat('v:', p_size) END)) AS key, p_type = 'SMALL' AS small FROM (SELECT *, p_size % 13 AS x, p_partkey % 17 AS y FROM part)""")
def part_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged key, a bounded wait, the distance to a segment, usual minutes, a JSON array's member."""
    size, d = F.col("p_size"), lambda c: c.cast("double")
    zero, minutes = F.lit(0.0), S.usual_minutes(F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.segment_distance2(d(size % 13), d(F.col("p_partkey") % 17), zero, zero, zero, F.lit(10.0)).alias("squared"), S.delay_seconds(size % 9 + 1).alias("wait"), minutes["low"].alias("low"), minutes["high"].alias("high"),
        S.idempotency_key(F.col("p_partkey"), F.when(size % 3 != 0, size)).alias("key"), S.json_contains(F.to_json(F.array("p_type", "p_brand")), "SMALL").alias("small"),
    )


LABELS = ("914 [36]", '914mm [36"]', "920 [36]", '36"', "914 mm", "950 [36]", "914", "914 [36]", "915 [36]", '914 [36 1/2]')


@query("""
    WITH k(k, system, mm, inch, agree, unit) AS (VALUES (0, 'dual', 914, 36.0, TRUE, 'in'), (1, 'dual', 914, 36.0, TRUE, 'in'), (2, 'dual', 920, 36.0, TRUE, 'in'), (3, 'in', NULL, 36.0, FALSE, 'in'), (4, 'mm', NULL, 914.0, FALSE, 'mm'),
        (5, 'dual', 950, 36.0, FALSE, 'in'), (7, 'dual', 914, 36.0, TRUE, 'in'), (8, 'dual', 915, 36.0, TRUE, 'in'), (9, 'dual', 914, 36.5, FALSE, 'in')),
    c AS (SELECT l_orderkey AS label, l_linenumber % 3 AS reader, (l_orderkey + CASE WHEN l_partkey % 5 = 0 THEN l_suppkey ELSE 0 END) % 10 AS k FROM lineitem),
    v AS (SELECT c.label, c.reader, k.* FROM c JOIN k ON k.k = c.k),
    g AS (SELECT label, count(*) AS n, count(DISTINCT reader) AS readers, count(DISTINCT reader // 2) AS vendors, count(DISTINCT system) AS systems, bool_or(system = 'mm') AS mm, count(DISTINCT (inch, unit)) AS readings, count(DISTINCT inch) AS vals,
        bool_or(system = 'dual') AS dual, bool_and(agree) AS agree, count(DISTINCT mm) AS halves FROM v GROUP BY label)
    SELECT l.label, coalesce(readers, 0) AS readers, coalesce(vals, 0) AS values, CASE WHEN n IS NULL OR n < 2 OR readers < 2 OR (systems > 1 AND mm) THEN 'RAW_CANDIDATE' WHEN readings > 1 THEN 'CONFLICTING' WHEN dual AND (NOT agree OR halves > 1) THEN 'RAW_CANDIDATE'
        WHEN vendors < 2 THEN 'RAW_CANDIDATE' ELSE 'CORROBORATED' END AS status FROM (SELECT DISTINCT label FROM c) l LEFT JOIN g ON g.label = l.label""")
def dual_label_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers of one label, written in millimetres and inches, in one of both, or without a value."""
    k = ((F.col("l_orderkey") + F.when(F.col("l_partkey") % 5 == 0, F.col("l_suppkey")).otherwise(0)) % 10).cast("int")
    raw = F.array(*map(F.lit, LABELS))[k]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label"), (F.col("l_linenumber") % 3).cast("string").alias("extractor"), raw.alias("raw"))
    token, text, inches = F.col("token"), F.col("__value"), F.col("inches")
    made = {"token": U.canonical_notation(text)["token"], "inches": U.normalise_to_inches(token)["value"], "system": E.authored_units(token, text, F.lit("in")), "dual": E.dual_halves(token, text, inches)}
    rows = R.per_value(rows, "raw", **made)
    is_mm = F.col("raw") == "914 mm"
    value = F.when(is_mm, F.lit(914).cast("decimal(38,19)")).otherwise((F.col("inches.num").cast("decimal(19,0)") / F.col("inches.den").cast("decimal(19,0)")).cast("decimal(38,19)"))
    readings = rows.select(
        "label", "extractor", F.when(F.col("extractor") == "2", "vendor:b").otherwise("vendor:a").alias("key"), value.alias("value"), F.when(is_mm, "mm").otherwise("in").alias("unit"), F.lit("width").alias("semantic"), F.lit(False).alias("stacked"),
        "system", "dual",
    )
    return E.corroborate(readings, "label")


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'NOT_QUALIFIED' WHEN NOT (l_tax > 0.05 OR (l_linestatus = 'F' AND l_suppkey % 2 = 0)) THEN 'NOT_QUALIFIED' WHEN l_partkey % 11 = 0 THEN 'ADVISORY' END AS refusal FROM lineitem""")
def drawn_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The architect's printed text with its drawn length passes without a second reader, a vendor's does not."""
    status = F.when(F.col("l_returnflag") == "R", E.CONFLICTING).otherwise(E.CORROBORATED)
    authority = F.when(F.col("l_partkey") % 11 == 0, "ADVISORY").otherwise("AUTHORITATIVE")
    role = F.when(F.col("l_suppkey") % 2 == 0, "ARCH").otherwise("SHOP")
    refusal = E.gate(status, F.col("l_tax") > 0.05, F.lit(False), authority, F.col("l_quantity"), F.lit("in"), F.col("l_linestatus") == "F", role)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", refusal.alias("refusal"))


NOTES = ('24"', '36" VIF', '12 including  field cut', "Tall pantry", "under-counter fridge", "microwave oven", "double oven")


@query("""
    WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS k FROM lineitem),
    t(k, note) AS (VALUES (0, '24"'), (1, '36" VIF'), (2, '12 including  field cut'), (3, 'Tall pantry'), (4, 'under-counter fridge'), (5, 'microwave oven'), (6, 'double oven'))
    SELECT n.l_orderkey, CASE WHEN bool_or(n.k = 2) THEN 'field-cut-included' WHEN bool_or(n.k = 1) THEN 'vif' END AS hold, arg_min(t.note, (n.l_linenumber, n.k)) FILTER (WHERE n.k IN (3, 6)) AS broken_by
    FROM n JOIN t ON t.k = n.k GROUP BY n.l_orderkey""")
def row_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's notes that hold its whole row for a person."""
    k = F.col("l_partkey") % 7
    note = F.struct("l_linenumber", k.alias("k"), F.array(*map(F.lit, NOTES))[k.cast("int")].alias("note"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["note"]).alias("notes"))
    return rows.select("l_orderkey", U.row_hold(F.col("notes")).alias("hold"), U.counter_break(F.col("notes")).alias("broken_by"))


#: Tags of parts' types that say what a reading is.
TAGS = {"LARGE": "countertop_width", "MEDIUM": "cabinet_width", "SMALL": "filler_width"}


@query("""
    SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN CASE split_part(p_type, ' ', 1) WHEN 'LARGE' THEN 'countertop_width' WHEN 'MEDIUM' THEN 'cabinet_width' WHEN 'SMALL' THEN 'filler_width' END END AS semantic FROM part""")
def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a part's exact tag says it is; none where an agent has suggested it, or the tag is unknown."""
    tag = F.substring_index("p_type", " ", 1)
    return table(spark, sf_dir, "part").select("p_partkey", E.semantic_type(tag, TAGS, F.col("p_size") % 4 == 0).alias("semantic"))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(round((l_partkey % 612) / 612.0 * 1000000) AS BIGINT) AS x, CAST(round((1 - (l_suppkey % 792) / 792.0) * 1000000) AS BIGINT) AS y FROM lineitem""")
def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a letter page, from its lower left corner, as millionths from the upper left."""
    spot = E.to_unit_square(F.col("l_partkey") % 612, F.col("l_suppkey") % 792, F.lit(612.0), F.lit(792.0))
    millionths = lambda c: F.round(spot[c] * 1_000_000).cast("long").alias(c)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", millionths("x"), millionths("y"))


@query("""
    WITH v AS (SELECT l_orderkey, l_linenumber, nullif(l_partkey % 3, 0) AS code, nullif(l_suppkey % 3, 0) AS one, nullif((l_partkey + l_linenumber) % 3, 0) AS two, l_quantity > 10 AS shown FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN code = one AND one = two AND shown THEN 'automatic' WHEN coalesce(code, one, two) IS NULL THEN 'none' ELSE 'ask' END AS decision FROM v""")
def view_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that the code and both readers pick is taken if it is shown; a person is asked about the others."""
    pick = lambda c: F.nullif(c % 3, F.lit(0))
    code, one, two = pick(F.col("l_partkey")), pick(F.col("l_suppkey")), pick(F.col("l_partkey") + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.three_way(code, one, two, F.col("l_quantity") > 10).alias("decision"))


@query("""
    SELECT l_partkey AS item, l_linenumber AS semantic, count(*) AS readings FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size % 7 = l.l_linenumber) GROUP BY 1, 2""")
def unannotated_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of items and types that have no gold value, counted."""
    gold = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 7).alias("semantic"))
    read = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("semantic"))
    return R.unannotated(read, gold, ["item", "semantic"]).groupBy("item", "semantic").agg(F.count("*").alias("readings"))
