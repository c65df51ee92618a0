"""Whitening against integers of any size and a whole decomposition in numpy."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from planlark.llm import queries, whitening
from tests.llm.texts import SF

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """The fit list, its sums and its covariance as fractions, and its components."""
    x = [(i, tuple(math.floor(Fraction(c) * 64) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(dim)]
    cov = [[Fraction(n * sum(v[i] * v[j] for v in fit) - sums[i] * sums[j], n * n) for j in range(dim)] for i in range(dim)]
    e, q = np.linalg.eigh(np.array(cov, dtype=float))
    return x, fit, n, sums, cov, e[::-1], q[:, ::-1]


def check(found, rows, k):
    x, fit, n, sums, cov, e, q = brute(rows)
    assert len(found) == len(rows) * k
    by = defaultdict(list)
    for r in found:
        by[r.vec_id].append(r)
    trace = float(sum(cov[j][j] for j in range(len(sums))))
    signs = {}
    for i, v in x:
        own = {r.component: r for r in by[i]}
        assert sorted(own) == list(range(1, k + 1))
        centred = [n * a - s for a, s in zip(v, sums, strict=True)]
        for c, r in own.items():
            assert r.n == n and r.deviation == sum(a * a for a in centred)
            assert r.explained == pytest.approx(e[c - 1] / trace, rel=1e-6)
            assert 0 <= r.identity_error <= 1e-4
            want = float(np.array([a / n for a in centred]) @ q[:, c - 1] / np.sqrt(e[c - 1]))
            sign = signs.setdefault(c, 1 if abs(want) < 1e-6 or r.whitened * want > 0 else -1)
            if abs(want) > 1e-3:
                assert r.whitened * sign == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_given_embeddings(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows = list(zip(t["vec_id"], t["embedding"], strict=True))
    found = queries.op11_whitening(spark, SF).collect()
    check(found, rows, 16)
    assert found[0].identity_error < 1e-9


def test_large_offsets_and_odd_rows(spark):
    """Entries of 10**9 with spreads of 1, where sums of squares in floats would lose all digits."""
    rng = np.random.default_rng(3)
    rows = [(i, [1e9 + float(a), -1e9 + float(b), float(c), float(a + b) * 3]) for i, (a, b, c) in enumerate(rng.normal(size=(300, 3)))]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    odd = [(2000, None), (2001, [None, 1.0, 1.0, 1.0]), (2002, [float("nan"), 1.0, 1.0, 1.0]), (2003, [float("-inf"), 1.0, 1.0, 1.0]), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({"x": F.lit("x"), "n": F.lit(7), "component": F.lit(0)})
    check(whitening.op11_whitening(spark, df.repartition(5)).collect(), rows, 4)


def test_scatter_is_exact_for_any_size(spark):
    rows = [[2**62, -(2**63), 5], [2**63 - 1, 3, -7], [1, 2**45, -(2**33)], [0, 0, 0]] * 3
    for shift in (0, 1_000_000, -(2**40)):
        got = whitening.scatter(spark.createDataFrame([(r,) for r in rows], "x array<bigint>").repartition(3), 3, shift)
        y = [[a - shift for a in r] for r in rows]
        assert got.n == len(rows)
        assert list(got.sums) == [sum(r[j] for r in y) for j in range(3)]
        assert got.cross.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]


def test_no_variance(spark):
    one = whitening.op11_whitening(spark, spark.createDataFrame([(1, [0.5, 0.25])] * 3, SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)] * 3
    flat = whitening.op11_whitening(spark, spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 2.0]), (None, [0.5, 3.0])], SCHEMA)).collect()
    assert [(r.whitened is None, r.explained) for r in flat if r.component == 2] == [(True, 0.0)] * 3
    assert all(r.identity_error < 1e-9 and r.explained == 1.0 for r in flat if r.component == 1)


def test_deviation_beyond_long(spark):
    rows = [(i, [1e16 * i, 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    exact = {r.vec_id: r.deviation for r in whitening.whiten(df).collect()}
    x = [math.floor(c[0] * 64) + 1_000_000 for _, c in rows]
    full = [(4 * v - sum(x)) ** 2 for v in x]
    assert exact == {i: v if v < 10**38 else None for i, v in enumerate(full)}
    assert {r.deviation for r in whitening.op11_whitening(spark, df).collect()} == {None}


def test_no_rows(spark):
    for rows in ([], [(1, None)]):
        df = whitening.op11_whitening(spark, spark.createDataFrame(rows, SCHEMA))
        assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
