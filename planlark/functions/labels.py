"""A dimension label's exact inches: plain ones, millimetres beside inches, sums and equal shares. U13 U14.

Values are rationals, null where the text is none of these. Millimetres only choose which of two numbers is the inches;
they are never the value.

Cases: null and empty texts are null; a fraction over 0 is no number. Texts of up to MOST_DIGITS digits, whose products stay
within 64 bits, are read by built-in functions; the others by the same rules with whole numbers of any length, in Arrow
batches. A value that 64 bits do not hold is null, and ``beyond`` says so.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from planlark.functions import long_labels as X
from planlark.functions import rational as R
from planlark.functions import units as U
from planlark.functions.long_labels import INCH_MARKS, NEAR_MM, SUM_WORD

#: As many digits as built-in functions read.
MOST_DIGITS = 8
VALUE, PAIR = "struct<num:bigint,den:bigint>", "struct<inches:string,refusal:string>"
EXPANDED = f"struct<value:{VALUE},how:string,parts:array<{VALUE}>,shares:int>"


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def few_digits(c: Column) -> Column:
    return F.when(digits(c) <= MOST_DIGITS, c)


def read_long(c: Column, f: Callable[[str], object], held: pa.DataType, kind: str) -> Column:
    """f of the texts that have more digits, null for the others."""
    return F.arrow_udf(X.read(f, held), kind)(F.when(digits(c) > MOST_DIGITS, c))


def shape_of(c: Column) -> Column:
    """The text with a # for each run of digits."""
    return F.regexp_replace(c, "[0-9]+", "#")


def parse_inches(c: Column) -> Column:
    """The inches that a text states: in its one pair of brackets, or marked as inches or feet; fractions as written. U13."""
    text = F.trim(F.translate(few_digits(c), "".join(U.MARKS), "".join(U.MARKS.values())))
    short = R.let2(text, F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), lambda t, b: F.when(F.size(b) == 1, stated(F.try_element_at(b, F.lit(1)), False)).when(F.size(b) == 0, stated(t, True)))
    return F.coalesce(short, read_long(c, lambda t: X.held(X.parse_inches(t)), X.VALUE, VALUE))


def stated(c: Column, marked: bool) -> Column:
    def read(text: Column) -> Column:
        return R.let2(shape_of(text), U.numbers(text), valued)

    def valued(shape: Column, found: Column) -> Column:
        after = F.regexp_replace(F.when(shape.startswith("#'"), F.substring(shape, 3, 1000)), "^-", "")
        rest = F.when(after != '"', F.regexp_replace(after, '"$', ""))
        feet = R.rational(U.number(found, 1) * 12)
        part = F.when(rest == "", R.rational(0)).when(rest != U.JOINED, U.quantity(rest, found, 2))
        body = F.rtrim(F.regexp_extract(shape, '^([#./ -]*)', 1))
        mark = F.ltrim(F.substring(shape, F.length(body) + 1, F.lit(1000)))
        is_inch = mark.isin(*INCH_MARKS) | ((mark == "") & F.lit(not marked))
        return F.when(after.isNotNull(), R.add(feet, part)).when(is_inch & (body != U.JOINED), U.quantity(body, found))

    spaced = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), " ?([/'\"-]) ?", "$1")
    return R.let(spaced, read)


def side(c: Column) -> Column:
    """struct<text, mark, value, step, split>: one number of two, its mark, and the step in which it is printed; a null step
    where it is no number."""

    def read(text: Column) -> Column:
        mark = F.when(text.endswith('"'), '"').when(F.lower(text).endswith("mm"), "mm").otherwise("")
        return R.let2(F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(mark))), mark, lambda number, m: R.let(F.struct(number.alias("text"), m.alias("mark"), shape_of(number).alias("shape"), U.numbers(number).alias("found")), valued))

    def valued(x: Column) -> Column:
        shape, found = x["shape"], x["found"]
        both = shape.isin("#.# #/#", "#.#-#/#")  # a decimal and a fraction, which add up
        summed = R.add(U.decimal_value(found), R.rational(U.number(found, 3), U.number(found, 4)))
        places = F.length(F.try_element_at(found, F.lit(2)))
        tenths = R.rational(F.lit(1), F.rpad(F.lit("1"), places + 1, F.lit("0")).try_cast("long"))
        step = F.when(shape.contains("/"), R.rational(F.lit(1), U.number(found, -1))).when(shape == U.DECIMAL, tenths).otherwise(R.rational(1))
        known = both | shape.isin(U.WHOLE, U.DECIMAL, U.FRACTION, U.MIXED, U.JOINED)
        value = F.when(both, summed).otherwise(U.quantity(shape, found))
        return F.struct(x["text"], x["mark"], value.alias("value"), step.alias("step"), shape.contains("/").alias("split"), known.alias("known"))

    return R.let(F.trim(c), read)


def agrees(mm: Column, inch: Column, mm_first: bool) -> Column:
    """Whether one number is the other's millimetres: within half the millimetres' step, or, where they come first, within half
    of both steps and NEAR_MM."""
    to_mm = lambda x: R.mul(x, R.rational(127, 5))
    gap, own = R.magnitude(R.sub(mm["value"], to_mm(inch["value"]))), R.mul(mm["step"], R.rational(1, 2))
    both = R.add(own, to_mm(R.mul(inch["step"], R.rational(1, 2))))
    near = (R.le(gap, both) & R.le(gap, R.rational(NEAR_MM))) if mm_first else R.le(gap, own)
    fits = (mm["mark"] != '"') & (inch["mark"] != "mm") & ~mm["split"] & R.lt(R.rational(0), inch["value"])
    return F.coalesce(fits & near, F.lit(False))


def pair(c: Column, worded: bool = False) -> Column:
    """struct<inches, refusal> of a number and another in brackets, null for other texts: the inches as printed, where exactly one
    reading of the two agrees, or else why there are none. The word mm is read only where ``worded``."""

    def named(found: tuple | None) -> dict | None:
        return None if found is None else dict(zip(("inches", "refusal"), found, strict=True))

    return F.coalesce(short_pair(c, worded), read_long(c, lambda t: named(X.pair(t, worded)), X.PAIR, PAIR))


def short_pair(c: Column, worded: bool) -> Column:
    def read(text: Column) -> Column:
        outside, inside = F.substring_index(text, "[", 1), F.substring_index(F.substring_index(text, "[", -1), "]", 1)
        once = text.endswith("]") & (F.length(F.regexp_replace(text, r"[^\[\]]", "")) == 2) & text.contains("[")
        return F.when(once, R.let2(side(outside), side(inside), chosen))

    def chosen(a: Column, b: Column) -> Column:
        is_pair = a["known"] & b["known"] & (F.lit(worded) | ((a["mark"] != "mm") & (b["mark"] != "mm")))
        return F.when(is_pair, R.let2(agrees(a, b, True), agrees(b, a, False), lambda second, first: one(second, first, a, b)))

    def one(second: Column, first: Column, a: Column, b: Column) -> Column:
        inches = F.when(second & ~first, b["text"]).when(first & ~second, a["text"])
        return F.struct(inches.alias("inches"), F.when(inches.isNull(), "mm_and_inches_disagree").alias("refusal"))

    return R.let(F.trim(few_digits(c)), read)


def as_drawn(c: Column) -> Column:
    """The inches of one written dimension; null where it has no unit, or a fraction that no drawing has."""
    return R.let(U.canonical_notation(c)["token"], lambda t: F.when(U.fraction_refusal(t, True).isNull(), U.normalise_to_inches(t)["value"]))


def plain_dimension(c: Column, worded: bool = False) -> Column:
    """The inches of a plain label: digits, fractions and marks, or two numbers that agree. Null for words, for two dimensions
    in one, without a unit, and for a fraction that no drawing has. U14."""

    def read(text: Column, found: Column) -> Column:
        numbered = F.concat(found["inches"], F.lit('"'))
        single = F.when(text.rlike(r"^[0-9 /\"'.-]+$"), text)
        return as_drawn(F.when(~U.is_compound(text), F.when(found.isNotNull(), numbered).otherwise(single)))

    short = R.let2(few_digits(c), short_pair(c, worded), read)
    return F.coalesce(short, read_long(c, lambda t: X.held(X.plain_dimension(t, worded)), X.VALUE, VALUE))


def expand_label(c: Column) -> Column:
    """struct<value, how, parts, shares>: a sum of marked inches, with the word filler or none, or equal shares of marked inches
    (``36"(3 EQ)``: two shares or more, the value is their total). Null for other texts and those that hold a row. U14."""
    positive = lambda v: F.coalesce(R.lt(R.rational(0), v), F.lit(False))
    marked = lambda t: t.rlike(r'^[0-9][0-9 /.-]*"$')

    def read(text: Column) -> Column:
        word = F.regexp_extract(text, "([A-Za-z]*)$", 1)
        body = F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(word)))
        pieces = F.transform(F.split(body, r"\+"), lambda p: F.trim(p))
        is_sum = (F.size(pieces) > 1) & F.upper(word).isin("", SUM_WORD) & F.forall(pieces, marked)
        whole = F.rtrim(F.substring_index(text, "(", 1))
        count = F.regexp_extract(text, r"^[^(]*\(\s*([0-9]+)\s*[eE][qQ]\s*\)$", 1).try_cast("int")
        shared = marked(whole) & (count >= 2)
        parts = F.transform(F.when(is_sum, pieces).when(shared, F.array(whole)), lambda p: as_drawn(p))
        return R.let2(parts, F.when(~is_sum, count), valued)

    def valued(parts: Column, shares: Column) -> Column:
        how = F.when(shares.isNull(), "sum").otherwise("equal-shares")
        return F.when(F.forall(parts, positive), F.struct(R.reduced(R.sum_of(parts)).alias("value"), how.alias("how"), parts.alias("parts"), shares.alias("shares")))

    short = R.let(F.trim(few_digits(c)), lambda t: F.when(U.row_hold(F.array(t)).isNull(), read(t)))
    return F.coalesce(short, read_long(c, X.expanded, X.EXPANDED, EXPANDED))


def beyond(c: Column) -> Column:
    """Why a label with an exact value has none here: 64 bits do not hold it."""
    return read_long(c, X.beyond, pa.string(), "string")
