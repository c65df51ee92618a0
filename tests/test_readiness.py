"""Readiness by hand: each reason in its order, inputs by every level, nulls."""

import pytest

from planlark.operators import readiness as A


def test_reasons_in_order(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    state = A.AWAITING
    packages = df([(p, p // 4, None if p == 6 else state) for p in range(1, 10)], "package long, project long, state string")
    checks = df([(10 * p, p, 100, False) for p in range(1, 9)] + [(11, 1, 900, True), (42, 4, 50, None)], "check long, package long, at long, superseded boolean")
    rows = [(10 * p, "PASS", None, None, None) for p in range(1, 8)]
    rows += [(11, "FAIL", "x", True, False), (20, "PASS", "x", True, False), (20, "FAIL", "x", True, True), (30, "NOT_FOUND", "Waiting for a width", False, False)]
    rows += [(30, "FAIL", "Waiting for a width", False, None), (42, None, None, None, None), (50, "NOT_FOUND", None, False, False), (50, "FAIL", "x", False, True)]
    results = df(rows, "check long, outcome string, reason string, corrected boolean, addressed boolean")
    unchecked = df([(2, 7), (3, 7), (3, 8)], "package long, page long")
    inputs = df([(3, 500), (4, 101), (5, 100), (9, 500)], "package long, at long")
    got = {r.package: (r.reason, r.n_open, r.n_waiting, r.n_rerun) for r in A.readiness(packages, checks, results, unchecked, inputs).collect()}
    assert got == {
        1: (None, 0, 0, 0),  # the check that found something is superseded
        2: ("corrected_wait_for_checks", 1, 0, 1),  # before its unchecked page
        3: ("pages_unchecked", 1, 1, 0),
        4: ("inputs_changed", 0, 0, 0),
        5: (None, 1, 0, 0),  # an open result alone keeps nothing back; an input at the check's time is checked
        6: ("not_awaiting_review", 0, 0, 0),
        7: (None, 0, 0, 0),
        8: ("no_results", 0, 0, 0),
        9: ("no_results", 0, 0, 0),
    }


def test_inputs_by_every_level(spark):
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    packages, pages, views = df([(1, 7), (2, 7), (3, 8)], "package project"), df([(50, 1), (50, 2), (51, 3)], "page package"), df([(90, 50), (91, 51)], "view page")
    by = lambda level, rows: A.branch(df(rows, "k t"), level, "k", "t")
    branches = [by("package", [(1, 5), (None, 99), (1, None)]), by("project", [(7, 4), (9, 99)]), by("page", [(50, 3), (50, 6)]), by("view", [(91, 2), (90, 1)]), by("view", [(90, 8), (92, 99)])]
    found = lambda bs: {r.package: r["at"] for r in A.last_inputs(bs, packages, pages, views).collect()}
    assert found(branches) == {1: 8, 2: 8, 3: 2}
    assert found(branches[:2]) == {1: 5, 2: 4}
    assert found(branches[2:3]) == {1: 6, 2: 6}
    with pytest.raises(ValueError, match="not by room"):
        by("room", [])
