"""Exact dedup and top-k search against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from planlark.llm import exact_dedup, hamming
from planlark.llm.common import work_path
from planlark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.texts import SF
from tests.oracle import connect, same


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(lower(text).encode()).hexdigest()


def test_queries_equal_their_sql(spark):
    con = connect(SF)
    for name, sql in ORACLE_SQL.items():
        same(QUERIES[name](spark, SF), sql, con)


def test_dedup_cases(spark):
    rows = [(1, None), (2, ""), (3, "Ab"), (4, "aB"), (4, "aB"), (5, "É"), (6, "é"), (7, "x" * 200_000), (None, "ab"), (9, "K")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, group_size string")
    got = exact_dedup.op1_exact_dedup(spark, docs, buckets=4).collect()
    best, size = {}, {}
    for i, t in rows:
        best[sha(t)] = max((x for x in (best.get(sha(t)), i) if x is not None), default=None)
        size[sha(t)] = size.get(sha(t), 0) + 1
    want = [(i, best[sha(t)], size[sha(t)], i == best[sha(t)], sha(t)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup.op1_exact_dedup(spark, docs.limit(0), buckets=4).count() == 0


def test_the_index_persists(spark):
    path = work_path(spark, "index")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    exact_dedup.dedup(first, exact_dedup.DigestIndex(spark, path, 4)).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert again.rows().count() == 2
    second = spark.createDataFrame([(10, "a"), (11, "c"), (12, "C")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(second, again).collect()}
    assert got == {10: (3, False), 11: (12, False), 12: (12, True)}
    assert {(r.text_sha256, r.keep_id) for r in again.rows().collect()} == {(sha("a"), 3), (sha("b"), 2), (sha("c"), 12)}


def test_index_join_is_sort_merge_on_buckets(spark):
    index = exact_dedup.DigestIndex(spark, work_path(spark, "index"), 4)
    index.append(spark.createDataFrame([("x", 1)], "text_sha256 string, keep_id long"))
    new = spark.createDataFrame([("x",), ("y",)], "text_sha256 string")
    plan = new.hint("merge").join(index.rows(), "text_sha256", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan
    assert "Bucketed: true" in plan


def brute_topk(codes, queries, k):
    out = set()
    for q in queries:
        near = sorted((bin((codes[q] ^ c) & (1 << 64) - 1).count("1"), i) for i, c in codes.items() if i != q)[:k]
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near)}
    return out


def test_topk_is_exact(spark):
    draw = random.Random(3)
    for near in (0, 5, 30):
        base = draw.getrandbits(64)
        codes = {}
        for i in range(120):
            c = base
            for _ in range(near):
                c ^= 1 << draw.randrange(64)
            codes[i] = (c if near else base) - (1 << 64 if (c if near else base) >> 63 else 0)
        rows = spark.createDataFrame(list(codes.items()), "id long, code long")
        got = hamming.topk(rows, rows.filter("id % 20 = 0"), 7).collect()
        assert {tuple(r) for r in got} == brute_topk(codes, [i for i in codes if i % 20 == 0], 7)


def test_topk_cases(spark):
    vec = lambda *on: [1.0 if i in on else -1.0 for i in range(64)]
    rows = [(0, vec(1), 1), (100, None, 1), (3, vec(1), 1), (3, vec(1), 1), (4, vec(1, 2), 1), (5, [float("nan"), None] + [0.0] * 62, 1), (200, vec(63), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int")
    got = hamming.op5_topk(spark, df, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.distance) for r in got] == [(0, 1, 3, 0), (0, 2, 4, 1), (0, 3, 5, 1), (200, 1, 5, 1), (200, 2, 0, 2), (200, 3, 3, 2)]
    assert hamming.op5_topk(spark, df.limit(0), 3).count() == 0


def test_sign_code(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0],)], "v array<float>")
    assert df.select(hamming.sign_code("v").alias("c")).first().c == 0b1001
    assert df.select(hamming.segment(F.lit(-1).cast("long"), 3).alias("s")).first().s == 65535
