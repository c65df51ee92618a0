"""Order of ties, and plans whose work is spread and grows with the input."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from planlark import plans
from planlark.operators import links as K
from planlark.operators import relational as R
from planlark.operators import retrieval as X


def write(folder, name: str, files: list[dict]) -> None:
    (folder / f"{name}.parquet").mkdir(parents=True)
    for i, columns in enumerate(files):
        pq.write_table(pa.table(columns), folder / f"{name}.parquet" / f"{i:03d}.parquet")


def test_first_claim_of_a_tie_is_the_first_in_the_table(spark, tmp_path):
    # the second file is larger, so its rows are read first
    lines = lambda flags, keys: {"l_partkey": keys, "l_orderkey": [7] * len(keys), "l_linenumber": [1] * len(keys), "l_returnflag": flags}
    write(tmp_path, "lineitem", [lines(["A", "N", "R"], [1, 1, 2]), lines(["R"] * 500 + ["N"] * 500, [1, 2] * 500)])
    write(tmp_path, "part", [{"p_partkey": [1, 2], "p_size": [6, 8]}])
    got = {r.l_partkey: (r.claim, r.answer) for r in plans.QUERIES["row_check"](spark, str(tmp_path)).collect()}
    assert got == {1: ("A", "A"), 2: ("R", "R")}


def plan_of(spark, name: str) -> str:
    return plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dimension_spans", "annotated_lines", "polygon_overlaps"])
def test_exploded_rows_do_not_pass_through_the_driver(spark, name):
    assert "Broadcast" not in plan_of(spark, name)


def test_boxes_of_one_place_meet_once(spark, tmp_path):
    from planlark.plans import geometry

    # even parts lie at (0, 0), odd ones at (37, 91) or, with 27 more, 36 before: some overlap, each pair of places once
    keys = [*range(0, 400_000, 1000), *range(27, 400_000, 2000)]
    keys += [*range(1027 - 27 + 1, 400_000, 2000)]
    write(tmp_path, "part", [{"p_partkey": keys, "p_size": [95] * len(keys)}])
    l, r = geometry.part_boxes(spark, str(tmp_path))
    classes = geometry.box_classes(l.select(*geometry.BOX["l"]).distinct(), r.select(*geometry.BOX["r"]).distinct())
    pairs = plans.QUERIES["box_iou"](spark, str(tmp_path))
    assert classes.count() <= 4 < 10_000 <= pairs.count() == pairs.distinct().count()
    assert {x.pairs for x in plans.QUERIES["mean_overlap"](spark, str(tmp_path)).collect()} == {pairs.count()}


def test_agreeing_pairs_equal_all_pairs_and_meet_by_their_fields(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([1, 2, 3, None]), rng.choice("xyz"), rng.choice(["t", "u", None])) for i in range(90)]
    p = spark.createDataFrame(rows, "id long, brand string, size long, name string, kind string")
    args = (p, p, ["brand"], {"size": 3, "name": 2, "kind": 0}, ("kind",))
    flat = lambda df: sorted((r.left_id, r.right_id, r.score) for r in df.collect())
    assert flat(X.agreeing_lane(*args)) == flat(X.metadata_lane(*args).filter("score > 0"))
    plan = plans.QUERIES["metadata_lane"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert all("l_p_size" in j or "l_p_name" in j for j in plan.splitlines() if "Join Inner" in j) and "Join Inner" in plan


def test_unique_matches_list_no_pairs(spark):
    l, r = (spark.createDataFrame([(k, i) for k, n in groups.items() for i in range(k * 1000, k * 1000 + n)], f"k long, {side} long") for side, groups in (("a", {1: 1, 2: 1, 3: 2, 4: 300}), ("b", {1: 1, 2: 2, 3: 1, 4: 300})))
    assert [tuple(x) for x in R.unique_matches(l, r, ["k"], "a", "b").collect()] == [(1000, 1000)]
    assert "Window" not in plan_of(spark, "unique_pairs")


def test_fusion_moves_rows_and_not_pairs(spark):
    plan = plan_of(spark, "rrf_fusion").splitlines()
    first_join = max(i for i, x in enumerate(plan) if "Window" in x)
    assert not any("Exchange" in x for x in plan[:first_join])


def test_small_packages_are_folded_without_components(spark, monkeypatch):
    def refused(_):
        raise AssertionError("small packages need no components")

    monkeypatch.setattr(K, "components", refused)
    assert plans.QUERIES["entity_links"](spark, "/root/testdata/sf0.001").count() > 1000


@pytest.mark.parametrize("name", ["imperial_parse"])
def test_each_text_is_parsed_once(spark, name):
    assert "__value" in plan_of(spark, name)


def test_a_scope_is_dealt_over_tasks(spark):
    assert "__deal" in plan_of(spark, "dense_topk")
