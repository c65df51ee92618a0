"""Unit functions against Python's exact fractions, and boundary tables."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from planlark.functions import rational as Q
from planlark.functions import scalars as S
from planlark.functions import units as U


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("x")).collect())]


def exact(value):
    return None if value is None else Fraction(value["num"], value["den"])


def test_rational_grid(spark):
    grid = [(a, b, c, d) for a in (-7, 0, 3, 25) for b in (1, 4, 64) for c in (-5, 1, 16) for d in (2, 127)]
    df = spark.createDataFrame(grid, "a long, b long, c long, d long")
    x, y = Q.rational(F.col("a"), F.col("b")), Q.rational(F.col("c"), F.col("d"))
    rows = df.select("a", "b", "c", "d", Q.add(x, y).alias("s"), Q.sub(x, y).alias("m"), Q.mul(x, y).alias("p"), Q.le(x, y).alias("le"), Q.lt(x, y).alias("lt"), Q.eq(x, y).alias("eq"), Q.reduced(x).alias("r")).collect()
    for r in rows:
        p, q = Fraction(r.a, r.b), Fraction(r.c, r.d)
        assert (exact(r.s), exact(r.m), exact(r.p), r.le, r.lt, r.eq) == (p + q, p - q, p * q, p <= q, p < q, p == q)
        assert (r.r.num, r.r.den) == (p.numerator, p.denominator)


def test_rational_overflow_raises(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000,)], "a long")
    with pytest.raises(Exception, match="(?i)overflow"):
        df.select(Q.mul(Q.rational(F.col("a")), Q.rational(F.col("a"))).alias("x")).collect()


def test_parse_imperial(spark):
    cases = {"38 3/4": Fraction(155, 4), '38 3/4"': Fraction(155, 4), "-3 1/2": Fraction(-7, 2), "6": Fraction(6), "2.375": Fraction(19, 8), "1/0": "zero_denominator", "": "empty", "abc": "unsupported", None: "empty", "1 2": "unsupported"}
    for got, want in zip(column(spark, list(cases), U.parse_imperial), cases.values(), strict=True):
        assert (exact(got["value"]) if got["refusal"] is None else got["refusal"]) == want


def test_normalise_to_inches(spark):
    cases = {
        "3'-6 1/2\"": Fraction(85, 2), "984 mm": Fraction(4920, 127), '38 3/4"': Fraction(155, 4), "38 3/4": "unmarked", "3 ft": Fraction(36), "3’ − 6\"": Fraction(42), "16⅜\"": Fraction(131, 8), "2 yd": "yards",
        "3'-13\"": "over_a_foot", "3'-6 4/3\"": "denominator", "3'-6 5/4\"": "improper", "38 cm": "no_unit", "": "empty", None: "empty", "3'6\"": Fraction(42), "12.5mm": Fraction(125, 254), "4 in": Fraction(4),
    }
    for token, got in zip(cases, column(spark, list(cases), U.normalise_to_inches), strict=True):
        assert (exact(got["value"]) if got["refusal"] is None else got["refusal"]) == cases[token], token


def test_format_and_refusals(spark):
    got = column(spark, [(85, 2), (-7, 2), (3, 4), (0, 5), (12, 4)], U.format_inches, "struct<num:bigint,den:bigint>")
    assert got == ["42 1/2", "-3 1/2", "3/4", "0", "3"]
    assert column(spark, ["163/8", "16 3/8", "5/3", "9/8", "x"], lambda c: U.fraction_refusal(c, True)) == ["squeezed", None, "denominator", "improper", None]
    assert column(spark, ["1/2 x 9/8", "1/2 - 3/4", "1/2/3", "12 - 5/8", "5 163/8", "1/2 x 163/8"], lambda c: U.fraction_refusal(c, True)) == ["improper", None, None, None, "improper", "squeezed"]
    assert column(spark, ["9/0", "3/7", "8/7"], lambda c: U.fraction_refusal(c, False)) == [None, None, "improper"]
    token = column(spark, ["3'-6 1/2\"", "25-1/2\"", "984 mm [38 3/4]", "6\" (typ) (VIF)", "984MM[38 3/4\"]", "x"], U.canonical_notation)
    assert [(t["token"], t["mm"]) for t in token] == [("3'-6 1/2\"", None), ('25 1/2"', None), ('38 3/4"', "984"), ('6" (typ)', None), ('38 3/4"', "984"), ("x", None)]
    assert column(spark, ['6" + 3"', "6 + 3", '6"–3'], U.is_compound) == [True, False, True]
    assert column(spark, ["984 [38 3/4]", "984", "984 [39 3/4]", "x"], U.check_dual) == ["consistent_within_rounding", "not_corroborated", "inconsistent", None]


def test_scalars(spark):
    assert column(spark, ["see 3/A-401 and 3 / a401, 7/S2"], S.references) == [["3/A401", "7/S2"]]
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(S.call_cost_micros(F.lit(1), F.lit(0), F.lit("0.0005").cast("decimal(12,6)"), F.lit("1").cast("decimal(12,6)"))) == 1
    assert one(S.charged_cost(F.lit(None).cast("long"), F.lit("failed"), F.lit(False), F.lit(5).cast("long"))) == 0
    assert one(S.charged_cost(F.lit(0).cast("long"), F.lit("ok"), F.lit(True), F.lit(5).cast("long"))) == 5
    assert one(S.clearly_nearer(F.lit(4.0), F.lit(9.0), 1.0)) is True
    assert one(S.clearly_nearer(F.lit(4.0), F.lit(8.9), 1.0)) is False
    assert one(S.segment_distance2(F.lit(5.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0))) == 2.0
    assert one(S.idempotency_key(F.lit(None), F.lit("a"))) != one(S.idempotency_key(F.lit(""), F.lit("a")))
    assert one(S.delay_seconds(F.lit(10))) == 60.0
    assert one(S.usual_minutes(F.lit(10))) == (6, 10)
