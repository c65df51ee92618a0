"""The trie of conversations against its SQL and a brute-force trie."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from planlark.llm import prefix_trie, queries
from tests.llm.texts import SF
from tests.oracle import connect, same

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node by listing every beginning of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    found = []
    for path, ms in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(built[c]) == len(path)))
        found.append(
            (
                min(ms),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(ms),
                sum(len(p) == len(path) + 1 for p in below),
                sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
                sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(found, key=str)


def ours(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_given_conversations(spark):
    same(queries.op13_prefix_trie(spark, SF), queries.ORACLE_SQL["op13_prefix_trie"], connect(SF))


def test_odd_conversations(spark):
    rows = [
        *[(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in (0, 1, 2, 3, 4, 7) for t in range(8)],
        *[(c, t, r, x) for c in (5, 6) for t, r, x in ((None, None, None), (1, "user", "é" * 50), (1, "user", "é" * 50), (2, "", "x" * 30_000))],
        (8, 3, "a", "bc"), (8, 3, "ab", "c"), (9, 0, "", ""), (13, 0, None, ""), (None, 1, "user", "lost"), (27, 1, "a", "bc"),
        (10**12, 1, "user", "turn 0"), *[(40 + i, 0, "system", "hello") for i in range(30)],
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"parent_conv_id": F.lit("x"), "n_convs": F.lit(1), "key": F.lit(0), "pos": F.lit(0), "len": F.lit(0), "node": F.lit(0)})
    assert ours(prefix_trie.op13_trie(spark, df.repartition(7))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "only")], [(None, 0, "user", "no id")]])
def test_few_rows(spark, rows):
    assert ours(prefix_trie.op13_trie(spark, spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_long_conversations_span_ranges(spark):
    """One conversation has most rows; its copy shares its first 5 turns."""
    rows = [(c, t, "user", f"{t if t < 5 else (c, t)}") for c in (1, 2) for t in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.in_order(spark.createDataFrame(rows, SCHEMA).repartition(5))
        assert sorted((r.conv_id, r.pos) for r in turns.rows.collect()) == [(c, t + 1) for c in (1, 2) for t in range(3000)]
        found = prefix_trie.nodes(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.count() == 1 + 5 + 2 * 2995
    assert found.filter("depth = 5").select("n_convs", "n_children", "n_leaves").collect() == [(2, 2, 2)]


def test_blocks_of_ids_hash_as_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 40)
    ends = spark.createDataFrame([(1, 2, c) for c in range(500, 0, -1)] + [(1, 3, 9), (2, 2, 10)], "node long, depth int, conv_id long").repartition(3)
    got = {(r.node, r.depth): r.ends_sha256 for r in prefix_trie.end_hashes(ends).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 2): sha(range(1, 501)), (1, 3): sha([9]), (2, 2): sha([10])}
