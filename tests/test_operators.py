"""Operations at their boundaries, and errors that must be loud."""

import pytest
from pyspark.sql import functions as F

from planlark.operators import evidence as E
from planlark.operators import geometry as G
from planlark.operators import metrics as M
from planlark.operators import relational as R
from planlark.operators import retrieval as L
from planlark.operators import rules as B
from planlark.operators import verdict as V
from planlark.sources import io
from planlark.streaming import streams as T


@pytest.fixture()
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(x).cast("long") for x in xs])


def test_scalar_operations(one):
    assert one(V.exists(F.lit(0))) == "PASS"
    assert one(V.exists(F.lit(""), "text")) == "FAIL"
    assert one(V.within_tolerance(F.lit(102), F.lit(100), F.lit(2))) == "PASS"
    assert one(V.within_tolerance(F.lit(103), F.lit(100), F.lit(2))) == "FAIL"
    with pytest.raises(Exception, match="negative"):
        one(V.within_tolerance(F.lit(1), F.lit(1), F.lit(-1)))
    with pytest.raises(Exception, match="exceed"):
        one(V.between(F.lit(1), F.lit(3), F.lit(2)))
    with pytest.raises(Exception, match="no options"):
        one(V.one_of(F.lit(1), F.array().cast("array<int>")))
    assert one(V.conditional_required(F.lit(True), F.lit(None))).outcome == "NOT_FOUND"
    assert one(V.conditional_required(F.lit(False), F.lit(None))).requirement_exercised is False


def test_list_operations(one):
    assert one(V.total(arr(51, 533, 457, 984))) == 2025
    assert one(V.running_totals(arr(1, 2, 3))) == [1, 3, 6]
    with pytest.raises(Exception, match="nothing"):
        one(V.total(F.array().cast("array<bigint>")))
    assert one(V.count(F.array().cast("array<bigint>"))) == 0
    assert one(V.alignment(arr(5), F.lit(1))) == "NOT_FOUND"
    assert one(V.alignment(arr(5, 7), F.lit(2))) == "PASS"
    assert one(V.all_within_tolerance(arr(1, 4), F.lit(2), F.lit(2))) == "PASS"


def test_row_total(one):
    none = F.lit(None).cast("array<bigint>")
    got = lambda *a: tuple(one(V.row_total(*a)))[:2]
    assert got(arr(21, 18), none, none) == (None, 39)
    assert got(none, arr(21), arr(18)) == (None, 39)
    assert got(arr(39), arr(21), arr(18)) == (None, 39)
    assert got(arr(40), arr(21), arr(18)) == ("REVIEW_REQUIRED", None)
    assert got(arr(40), arr(21), none) == ("REVIEW_REQUIRED", None)
    assert got(none, arr(21), none) == ("NOT_FOUND", None)
    assert got(arr(0, 39), none, none) == ("REVIEW_REQUIRED", None)


def test_cabinet_run(one):
    """Widths in sixteenths: 90 to 82 leaves 42 over two cabinets that may move."""
    w = lambda *xs: arr(*[x * 16 for x in xs])
    bound = F.struct(F.lit(9 * 16).alias("low"), F.lit(40 * 16).alias("high"))
    bounds = F.create_map(*[x for k in ("single_door", "double_door", "drawer") for x in (F.lit(k), bound)])
    kinds = F.array(F.lit("drawer"), F.lit("equipment"), F.lit("drawer"))
    run = lambda field, nf, nc: tuple(one(V.cabinet_run(F.lit(field * 16).cast("long"), F.lit(90 * 16).cast("long"), w(3, 3), nf, w(24, 36, 24), nc, kinds, bounds, F.lit(2 * 16).cast("long"), F.lit(5 * 16).cast("long"))))
    assert run(90, w(3, 3), w(24, 36, 24)) == ("PASS", "no_change_required", 0)
    assert run(82, w(2, 2), w(21, 36, 21)) == ("PASS", "cabinets_absorb_remainder", 0)
    assert run(82, w(2, 2), w(22, 36, 20))[:2] == ("FAIL", "cabinets_absorb_remainder")
    assert run(88, w(2, 2), w(24, 36, 24)) == ("PASS", "fillers_absorb", 0)
    assert run(40, w(2, 2), w(1, 36, 1))[1] == "cannot_resolve"
    assert run(90, w(3), w(24, 36, 24))[1] == "run_shape_unsupported"


def test_engine_precedence(one):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("string")
    at = lambda *a: one(B.engine_outcome(*a, F.lit("PASS"), F.lit("NOT_FOUND"), F.lit("REVIEW_REQUIRED")))
    assert at(F.lit("NO_APPLICABLE_RULE"), t, t, t, t, t) == "NO_APPLICABLE_RULE"
    assert at(n, f, f, f, t, t) == "NOT_FOUND"
    assert at(n, f, f, f, f, f) == "PASS"


def test_rules(spark):
    snaps = spark.createDataFrame([("r", "1.9.0", 1), ("r", "1.10.0", 2)], "rule_id string, version string, x int")
    assert B.latest_snapshots(snaps).first().x == 2
    twice = spark.createDataFrame([("p", "n", "RUN", 1), ("p", "n", "RUN", 2)], "project string, name string, layer string, value int")
    with pytest.raises(Exception, match="one layer"):
        B.layered(twice, ["project"]).collect()
    assert B.snapshot_id({"b": 1, "a": 2}) == B.snapshot_id({"a": 2, "b": 1})
    with pytest.raises(KeyError):
        V.resolve("eval")


def test_evidence(one, spark):
    assert one(E.twice_area(F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (4, 0), (4, 3))]))) == 12
    assert tuple(one(E.seal_label(F.lit("a"), F.lit("b"), F.lit(False)))) == (None, "disagree")
    bad = spark.createDataFrame([("", None, None, 1, 0.5), ("x", 1, "yd", 1, 0.5), ("x", 1, "in", 1, 0.5)], "raw_text string, parsed_value int, unit_guess string, page int, confidence double")
    assert [r.refusal for r in E.normalize(bad).collect()] == ["EMPTY_TEXT", "UNKNOWN_UNIT", None]


def test_retrieval(one, spark):
    assert sorted(one(L.trigrams(F.lit("X-223")))) == sorted(["  x", " x ", "  2", " 22", "223", "23 "])
    assert one(L.cover_density(F.lit("a b c a"), F.array(F.lit("a"), F.lit("b")))) == pytest.approx((1 / 2 + 1 / 3) / (1 + 1 / 2 + 1 / 3))
    assert one(L.three_way(F.lit("v"), F.lit("v"), F.lit("v"), F.lit(True))) == "automatic"
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, t string")
    assert L.build_digest(rows, ["k"], "t").select("digest").distinct().count() == 2


def test_geometry(spark):
    segs = spark.createDataFrame([(1, 0, 0, 5, 0), (1, 5, 0, 0, 0)], "page int, x0 int, y0 int, x1 int, y1 int")
    assert G.distinct_segments(segs).count() == 1
    pairs = spark.createDataFrame([("v", 0, 0), ("v", 10, 11), ("v", 20, 20), ("v", 5, 50)], "view string, l long, r long")
    assert tuple(G.aligned_views(pairs, ["view"], 1).first()) == ("v", 3, True)
    shapes = spark.createDataFrame([("f", 1, 10.0, 10.0), ("f", 2, 9.5, 10.0), ("f", 3, 4.0, 10.0)], "font string, id long, w double, h double")
    assert [r.leader for r in G.leaders(shapes, ["font"], 0.9).orderBy("id").collect()] == [1, 1, 3]
    forks = spark.createDataFrame([("s", 1, None), ("s", 2, 1), ("s", 3, 1)], "sheet string, version int, supersedes int")
    assert G.supersession(forks).first().state == "fork"


def test_relational(spark):
    boxes = lambda p, rows: spark.createDataFrame(rows, f"{p}_id int, {p}_x0 long, {p}_y0 long, {p}_x1 long, {p}_y1 long")
    met = R.box_overlaps(boxes("l", [(1, 0, 0, 300, 300)]), boxes("r", [(2, 100, 100, 400, 400), (3, 300, 0, 310, 10)]))
    assert [(r.l_id, r.r_id) for r in met.collect()] == [(1, 2)]
    cards = spark.createDataFrame([("a", 1.0), ("b", None)], "metric string, value double")
    lost = M.metric_delta(cards, cards.withColumn("value", F.lit(None).cast("double"))).collect()
    assert {r.metric: r.state for r in lost} == {"a": "lost", "b": "unmeasured"}


def test_sources(spark, tmp_path):
    (tmp_path / "prices.json").write_text('{"m": ["0.003", "0.015"]}')
    assert io.price_frame(spark, io.read_prices(str(tmp_path / "prices.json"))).count() == 1
    (tmp_path / "bad.json").write_text('{"m": [0.003, 0.015]}')
    with pytest.raises(ValueError, match="strings"):
        io.read_prices(str(tmp_path / "bad.json"))
    (tmp_path / "r1.rule").write_text('{"rule_id": "R", "version": "1.0.0", "inputs": {"a": "LIST"}}')
    assert io.read_rules(spark, str(tmp_path / "r1.rule")).first().inputs == {"a": "LIST"}
    df = spark.createDataFrame([(1, "=cmd()"), (2, None)], "i int, t string")
    io.put_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exist"):
        io.put_once(df, str(tmp_path / "once"))
    io.append_only(df, str(tmp_path / "log"))
    io.append_only(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    io.export_csv(df, str(tmp_path / "csv"))
    back = io.read_csv(spark, str(tmp_path / "csv"), "i string, t string")
    assert {r.t for r in back.collect()} == {"'=cmd()", None}
    (tmp_path / "f.bin").write_bytes(b"abc")
    files = io.read_files(spark, str(tmp_path), "*.bin")
    sha = files.select(F.sha2("content", 256)).first()[0]
    path = files.first().path
    ok = spark.createDataFrame([("c", path, f"sha256:{sha}")], "case_id string, path string, content_hash string")
    assert io.checked_cases(ok, files).count() == 1
    with pytest.raises(Exception, match="changed"):
        io.checked_cases(ok.withColumn("content_hash", F.lit("sha256:0")), files).collect()
    parts = spark.createDataFrame([("p", i, f"n{i}", 10) for i in range(42)], "portfolio string, position int, name string, bytes long")
    assert io.unpacked(parts).filter("refusal = 'too_many'").count() == 2


def test_reading_times(spark):
    rows = [("a", 1, "start"), ("a", 2, "retry"), ("a", 3, "stop"), ("b", 1, "start"), ("b", 2, "retry"), ("b", 3, "work"), ("c", 1, "work"), ("c", 2, "start"), ("c", 4, "done"), ("c", 5, "retry")]
    df = spark.createDataFrame(rows, "k string, n int, s string").withColumn("at", F.timestamp_seconds("n"))
    got = {r.k: (r.outcome, r.duration_ms) for r in T.reading_times(df, "k", ["n"], "at", "s", "start", ("done",), ("stop",), "retry").collect()}
    assert got == {"a": ("failed", 1000), "b": ("reading", None), "c": ("finished", 2000)}


def test_concurrency(spark):
    rows = [("k", i, i == 0) for i in range(41)]
    assert T.concurrency(spark.createDataFrame(rows, "k string, n int, busy boolean"), "k", ["n"], "busy").first().limit == 6
    with pytest.raises(ValueError):
        T.age(0)
