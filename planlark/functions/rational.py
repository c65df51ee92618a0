"""Exact rationals as struct<num: bigint, den: bigint> with den > 0, by built-in functions.

Arithmetic is exact: products are bigint under ANSI mode, so an overflow raises, and comparisons multiply crosswise as
decimals of 38 digits. Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(19,0)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def let2(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: f(s["a"], s["b"]))


def rational(num: Column | int, den: Column | int = 1) -> Column:
    num, den = (x if isinstance(x, Column) else F.lit(x) for x in (num, den))
    num, den = num.cast("long"), den.cast("long")
    value = F.struct(F.when(den < 0, -num).otherwise(num).alias("num"), F.abs(den).alias("den"))
    return F.when(num.isNotNull() & (den != 0), value)


def _cross(a: Column, b: Column) -> tuple[Column, Column]:
    return a["num"].cast(WIDE) * b["den"].cast(WIDE), b["num"].cast(WIDE) * a["den"].cast(WIDE)


def eq(a: Column, b: Column) -> Column:
    return let2(a, b, lambda p, q: _cross(p, q)[0] == _cross(p, q)[1])


def le(a: Column, b: Column) -> Column:
    return let2(a, b, lambda p, q: _cross(p, q)[0] <= _cross(p, q)[1])


def lt(a: Column, b: Column) -> Column:
    return let2(a, b, lambda p, q: _cross(p, q)[0] < _cross(p, q)[1])


def add(a: Column, b: Column) -> Column:
    def summed(x: Column, y: Column) -> Column:
        mixed = rational(x["num"] * y["den"] + y["num"] * x["den"], x["den"] * y["den"])
        return F.when(x["den"] == y["den"], rational(x["num"] + y["num"], x["den"])).otherwise(mixed)

    return let2(a, b, summed)


def neg(a: Column) -> Column:
    return let(a, lambda x: rational(-x["num"], x["den"]))


def sub(a: Column, b: Column) -> Column:
    return add(a, neg(b))


def mul(a: Column, b: Column) -> Column:
    return let2(a, b, lambda x, y: rational(x["num"] * y["num"], x["den"] * y["den"]))


def magnitude(a: Column) -> Column:
    return let(a, lambda x: rational(F.abs(x["num"]), x["den"]))


def gcd(a: Column, b: Column) -> Column:
    """Euclid over a fixed number of steps, enough for 64 bits."""
    pair = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        pair,
        lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(F.try_mod(s["a"], s["b"])).cast("long").alias("b")),
        lambda s: s["a"],
    )


def whole(a: Column, b: Column) -> Column:
    """Integer division of a multiple."""
    return F.round(F.try_divide(a.cast(WIDE), b.cast(WIDE))).cast("long")


def reduced(a: Column) -> Column:
    return let(a, lambda x: let(gcd(x["num"], x["den"]), lambda g: rational(whole(x["num"], g), whole(x["den"], g))))


def sum_of(values: Column) -> Column:
    """Sum of an array of rationals, 0/1 for an empty one."""
    return F.aggregate(values, rational(0), add)


def as_decimal(a: Column, places: int = 6) -> Column:
    """For reports only; rounds half up."""
    return F.round(F.try_divide(a["num"].cast("decimal(28,10)"), a["den"].cast("decimal(18,0)")), places)
