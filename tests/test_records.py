"""Operators whose results a query over the test tables would not tell apart."""

from pyspark.sql import functions as F

from planlark.functions import scalars as S
from planlark.functions import units as U
from planlark.operators import geometry as G
from planlark.streaming import streams as T


def test_leaders_take_what_is_alike_in_both_sides(spark):
    shapes = spark.createDataFrame([("f", 1, 10.0, 10.0), ("f", 2, 9.0, 10.0), ("f", 3, 9.0, 4.0), ("f", 4, 8.0, 4.0), ("g", 5, 10.0, 10.0)], "font string, id long, w double, h double")
    got = {r.id: r.leader for r in G.leaders(shapes, ["font"], 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    sink, batch = str(tmp_path / "sink"), lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    for number, ks in ((0, (1, 1, 2)), (1, (2, 3)), (1, (2, 3)), (0, (1, 1, 2))):
        T.append_new(batch(*ks), sink, ["k"], number)
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_json_arrays_and_names(spark):
    rows = spark.createDataFrame([('["a","b"]', " A b "), ("[]", ""), (None, None), ("{", "x")], "j string, n string")
    got = rows.select(S.json_contains(F.col("j"), "a").alias("one"), S.json_contains(F.col("j"), "a", "c").alias("two"), S.name_key(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, False, "a b"), (False, False, ""), (None, None, None), (None, None, "x")]


def test_json_elements(spark):
    rows = [(1, '[{"type":"a","n":1},{"type":"b"},{"type":"a","n":"x"},5,"a",null,[{"type":"a"}],{"type":5}]'), (2, '{"type":"a"}'), (3, "[]"), (4, None), (5, "{"), (6, '"a"'), (7, "null")]
    df = spark.createDataFrame(rows, "id long, j string")
    found = S.json_elements(F.col("j"), lambda e: S.text_at(e, "$.type") == "a")
    got = {r.id: r.f for r in df.select("id", F.transform(found, lambda e: F.to_json(e)).alias("f")).collect()}
    assert got == {1: ['{"n":1,"type":"a"}', '{"n":"x","type":"a"}'], 2: ['{"type":"a"}'], 3: [], 4: [], 5: [], 6: [], 7: []}


def test_rows_that_go_to_a_person(spark):
    rows = [(1, ['24"', None]), (2, ["vif", "INCLUDING\tFIELD CUT"]), (3, ["VIF-24"]), (4, ["VIFX", "MIXED REFS"]), (5, []), (6, None), (7, ["UC oven", "MW  oven", "w/d", "tall"])]
    got = spark.createDataFrame(rows, "id int, t array<string>").select("id", U.row_hold(F.col("t")).alias("h"), U.counter_break(F.col("t")).alias("b")).collect()
    assert {r.id: (r.h, r.b) for r in got} == {1: (None, None), 2: ("field-cut-included", None), 3: ("vif", None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, "w/d")}


def test_reused_answers_made_no_call(spark):
    rows = [('{"reused_from":"x"}',), ('{"reused_from":null}',), ("{}",), (None,), ('{"a":{"reused_from":"x"}}',)]
    assert [r.c for r in spark.createDataFrame(rows, "p string").select(S.made_a_call(F.col("p")).alias("c")).collect()] == [False, True, True, True, True]
