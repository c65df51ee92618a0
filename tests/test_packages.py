"""Pages of the packages' summary: every row once in each order, cursors that belong to one order and search."""

from datetime import datetime

import pytest

from planlark.operators import packages as P

LABELS = {"K": ["Kitchen", "Kitchens"], "V": ["Vanity", "Vanities"]}


@pytest.fixture(scope="module")
def rows(spark):
    day = lambda n: datetime(2024, 1, n)
    data = [(i, v, p, day(1 + i % 3), b) for i, (v, p, b) in enumerate([("beta", "K", 1), (" Alpha ", "V", 2), (None, "K", 2), ("", "V", 0), ("alpha", "K", 1), ("100%_a", "V", 2), ("x\\y", "K", 0), ("  ", None, 5), ("BETA", "V", 1)])]
    df = spark.createDataFrame(data, "package int, vendor string, product string, updated_at timestamp, blocking int")
    unnamed, key = P.name_or_unnamed(df["vendor"])
    return df.withColumns({"unnamed": unnamed, "vendor_key": key})


def walk(rows, sort, size, text=None):
    out, cursor = [], None
    while True:
        got = P.page(rows, sort, size, cursor, text, LABELS).collect()
        out += [r.package for r in got[:size]]
        if len(got) <= size:
            return out
        cursor = P.cursor_of(got[size - 1], sort, text)


@pytest.mark.parametrize("size", [2, 4, 20])
def test_every_order_walks_all_rows(rows, size):
    every = [r.asDict() for r in rows.collect()]
    by = lambda key, down: [r["package"] for r in sorted(every, key=key, reverse=down)]
    assert walk(rows, "updated", size) == by(lambda r: (r["updated_at"], r["package"]), True)
    assert walk(rows, "vendor", size) == [5, 1, 4, 0, 8, 6, 2, 3, 7]
    assert walk(rows, "needs_decision", size) == by(lambda r: (r["blocking"], r["updated_at"], r["package"]), True)


def test_search_is_literal_and_finds_labels(rows):
    find = lambda text: sorted(walk(rows, "vendor", 3, text))
    assert find("ALPHA") == [1, 4] and find("%") == [5] and find("_") == [5] and find("\\") == [6]
    assert find("kitch") == [0, 2, 4, 6] and find("vanities") == [1, 3, 5, 8] and find("  ") == list(range(9)) and find("zzz") == []


def test_cursors_belong_to_one_list(rows):
    cursor = P.cursor_of(P.page(rows, "vendor", 2, None, "a", LABELS).collect()[1], "vendor", "a")
    assert P.page(rows, "vendor", 2, cursor, " a ", LABELS).collect()
    for sort, text, c in (("updated", "a", cursor), ("vendor", "b", cursor), ("vendor", None, cursor), ("vendor", "a", "junk"), ("vendor", "a", "")):
        with pytest.raises(ValueError):
            P.page(rows, sort, 2, c, text, LABELS)


def test_a_summary_by_hand(spark):
    f = spark.createDataFrame
    day = lambda n: datetime(2024, 1, n)
    out = P.summaries(
        f([(1, "A", "K"), (2, None, "K"), (3, "no revision", "K")], "package int, vendor string, product string"),
        f([(1, 10, 1, day(1)), (1, 11, 2, day(2)), (2, 20, 1, day(3))], "package int, revision int, number int, created_at timestamp"),
        f([(11, 1, 1, day(9)), (11, 2, 1, day(5)), (11, 2, 2, day(6)), (10, 9, 9, day(30))], "revision int, sequence int, id int, at timestamp"),
        f([(1, day(4)), (2, day(8))], "package int, at timestamp"),
        f([(1, 11, "PASS", False, False), (1, 11, "PASS", False, False), (2, 11, "FAIL", False, True), (3, 11, "FAIL", True, True), (4, 10, "FAIL", False, True), (5, 11, "OTHER", None, None)], "finding int, revision int, outcome string, superseded boolean, blocking boolean"),
        f([(11,), (11,)], "revision int"),
        f([(10,)], "revision int"),
    )
    got = {r.package: (r.revision, r.updated_at, r["pass"], r.fail, r.blocking, r.approved, r.signed_ready, r.unnamed) for r in out.collect()}
    assert got == {1: (11, day(6), 1, 1, 1, True, False, 0), 2: (20, day(8), 0, 0, 0, False, False, 1)}
