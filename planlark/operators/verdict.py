"""The typed operations of a rule: scalar, list, pairwise and distribution checks with a five-valued outcome.

Values are exact (integers, decimals, or rationals of planlark.functions.rational); all comparisons are inclusive. Each
function returns a Column (or struct Column) for one projection, so a rule over any number of cases is one narrow stage;
list operands arrive as arrays built once by a grouped collect with an explicit position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlark.functions import checks

PASS, FAIL, NOT_FOUND, REVIEW_REQUIRED, NO_APPLICABLE_RULE = "PASS", "FAIL", "NOT_FOUND", "REVIEW_REQUIRED", "NO_APPLICABLE_RULE"
DECISIVE = (PASS, FAIL)


def verdict(ok: Column) -> Column:
    return F.when(ok, PASS).otherwise(FAIL)


def exists(value: Column, kind: str = "scalar") -> Column:
    """PASS unless null or empty; zero is present. V1."""
    full = value.isNotNull() & (F.size(value) > 0 if kind == "list" else F.length(value) > 0 if kind == "text" else F.lit(True))
    return verdict(F.coalesce(full, F.lit(False)))


def equals(actual: Column, expected: Column) -> Column:
    return verdict(actual == expected)


def within_tolerance(actual: Column, expected: Column, tolerance: Column) -> Column:
    """|actual - expected| <= tolerance; a negative tolerance is the author's error and raises. V3."""
    checked = checks.checked(tolerance, tolerance >= 0, "tolerance must not be negative")
    return verdict(F.abs(actual - expected) <= checked)


def minimum(value: Column, bound: Column) -> Column:
    return verdict(value >= bound)


def maximum(value: Column, bound: Column) -> Column:
    return verdict(value <= bound)


def between(value: Column, low: Column, high: Column) -> Column:
    checked = checks.checked(low, low <= high, "low must not exceed high")
    return verdict((value >= checked) & (value <= high))


def one_of(value: Column, options: Column) -> Column:
    checked = checks.checked(options, F.size(options) > 0, "no options")
    return verdict(F.array_contains(checked, value))


def contains(text: Column, part: Column) -> Column:
    return verdict(F.contains(text, part))


def difference_between(a: Column, b: Column) -> Column:
    return a - b


def scale(value: Column, times: Column) -> Column:
    return value * checks.checked(times, times >= 0, "times must not be negative")


def conditional_required(when: Column, value: Column) -> Column:
    """struct<outcome, requirement_exercised>. V11."""
    return F.struct(F.when(~when, PASS).when(value.isNull(), NOT_FOUND).otherwise(PASS).alias("outcome"), when.alias("requirement_exercised"))


def total(values: Column) -> Column:
    """The sum of a list; an empty one is an error. V12."""
    checked = checks.checked(values, F.size(values) > 0, "nothing to sum")
    return F.aggregate(checked, checked[0] - checked[0], lambda a, x: a + x)


def running_totals(values: Column) -> Column:
    """The trace of a sum."""
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, 1, i + 1), values[0] - values[0], lambda a, x: a + x))


def count(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)).cast("long")


def count_equals(values: Column, n: Column) -> Column:
    return verdict(count(values) == n)


def sum_within_tolerance(target: Column, addends: Column, tolerance: Column) -> Column:
    return within_tolerance(target, total(addends), tolerance)


def worst_deviation(values: Column, expected: Column) -> Column:
    return F.array_max(F.transform(values, lambda x: F.abs(x - expected)))


def all_within_tolerance(values: Column, expected: Column, tolerance: Column) -> Column:
    checked = checks.checked(values, F.size(values) > 0, "nothing to compare")
    return verdict(worst_deviation(checked, expected) <= tolerance)


def row_total(pieces: Column, cabinets: Column, fillers: Column) -> Column:
    """struct<outcome, value, reason> from two statements of one row; null lists were not given. V17."""
    add = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    flat = F.exists(F.flatten(F.array(*[F.coalesce(v, F.array().cast("array<bigint>")) for v in (pieces, cabinets, fillers)])), lambda x: x <= 0)
    kinds = add(cabinets) + add(fillers)
    neither, both = cabinets.isNull() & fillers.isNull(), cabinets.isNotNull() & fillers.isNotNull()
    outcome = (
        F.when(flat, REVIEW_REQUIRED)
        .when(pieces.isNull(), F.when(both, F.lit(None).cast("string")).otherwise(NOT_FOUND))
        .when(neither, F.lit(None).cast("string"))
        .when(~both, REVIEW_REQUIRED)
        .when(kinds != add(pieces), REVIEW_REQUIRED)
    )
    reason = (
        F.when(flat, "zero or less")
        .when(pieces.isNull(), F.when(both, "cabinets and fillers").otherwise("no complete statement"))
        .when(neither, "pieces")
        .when(~both, "half a second statement")
        .when(kinds != add(pieces), "statements disagree")
        .otherwise("pieces, confirmed")
    )
    return F.struct(outcome.alias("outcome"), F.when(outcome.isNull(), F.coalesce(add(pieces), kinds)).alias("value"), reason.alias("reason"))


def alignment(positions: Column, tolerance: Column) -> Column:
    """max - min <= tolerance; fewer than two positions are NOT_FOUND. V18."""
    return F.when(F.coalesce(F.size(positions), F.lit(0)) < 2, NOT_FOUND).otherwise(verdict(F.array_max(positions) - F.array_min(positions) <= tolerance))


#: Which outcome of several decides: FAIL, then NOT_FOUND, then PASS.
PRECEDENCE = {PASS: 0, NOT_FOUND: 1, FAIL: 2}


def decisive_outcome(rank: Column) -> Column:
    return F.element_at(F.array(F.lit(PASS), F.lit(NOT_FOUND), F.lit(FAIL)), rank + 1)


def pairwise(left: DataFrame, right: DataFrame, case: str, key: str, value: str, tolerance: Column) -> DataFrame:
    """(case, outcome, pairs, worst): every key of either side, a missing side NOT_FOUND. One shuffle on (case, key),
    then partial aggregation. V19, J10."""
    both = left.select(case, key, F.col(value).alias("__l")).join(right.select(case, key, F.col(value).alias("__r")), [case, key], "full_outer")
    gap = F.abs(F.col("__l") - F.col("__r"))
    rank = F.when(gap.isNull(), PRECEDENCE[NOT_FOUND]).when(gap <= tolerance, PRECEDENCE[PASS]).otherwise(PRECEDENCE[FAIL])
    return both.groupBy(case).agg(decisive_outcome(F.max(rank)).alias("outcome"), F.count("*").alias("pairs"), F.max(gap).alias("worst"))


def filler_distribution(field: Column, design: Column, design_fillers: Column, proposed: Column, low: Column, high: Column, asymmetric: Column) -> Column:
    """struct<outcome, condition, delta>: the fillers take up what the site differs by. V20."""
    both = (F.size(design_fillers) == 2) & (F.size(proposed) == 2)
    expected = design_fillers[0] + design_fillers[1] + field - design
    given = proposed[0] + proposed[1]
    beyond = F.when(expected < 2 * low, 2 * low - expected).when(expected > 2 * high, expected - 2 * high)
    in_bounds = F.forall(proposed, lambda f: (f >= low) & (f <= high))
    equal = asymmetric | ((2 * proposed[0] == expected) & (2 * proposed[1] == expected))
    return F.struct(
        F.when(~both | beyond.isNotNull(), REVIEW_REQUIRED).otherwise(verdict(in_bounds & (given == expected) & equal)).alias("outcome"),
        F.when(~both, "run_shape_unsupported").when(beyond.isNotNull(), "cabinet_selection_required").otherwise("fillers_absorb").alias("condition"),
        F.when(both, F.coalesce(beyond, F.abs(given - expected))).alias("delta"),
    )


def cabinet_run(field: Column, design: Column, fillers: Column, new_fillers: Column, cabinets: Column, new_cabinets: Column, kinds: Column, bounds: Column, low: Column, high: Column) -> Column:
    """struct<outcome, condition, deviation>: fillers move first and equally, the rest goes equally to cabinets that are
    not equipment. Widths are whole sixteenths (integers); ``bounds`` is map<kind, struct<low, high>>. V21."""
    add = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    shape = (F.size(fillers) > 0) & (F.size(cabinets) > 0) & (F.size(new_fillers) == F.size(fillers)) & (F.size(new_cabinets) == F.size(cabinets)) & (F.size(kinds) == F.size(cabinets))
    shape = shape & F.forall(kinds, lambda k: k.isin("single_door", "double_door", "drawer", "equipment"))
    difference, drawn = field - design, add(fillers)
    moved = F.least(F.greatest(drawn + difference, low * F.size(fillers)), high * F.size(fillers))
    rest = difference - (moved - drawn)
    must_move, alike = moved != drawn, F.size(F.array_distinct(fillers)) == 1
    uneven = must_move & (F.try_mod(moved, F.size(fillers).cast("long")) != 0)
    wanted_fillers = F.transform(fillers, lambda f: F.when(must_move & alike, F.floor(F.try_divide(moved, F.size(fillers)))).otherwise(f).cast("long"))
    free = F.size(F.filter(kinds, lambda k: k != "equipment")).cast("long")
    share_odd = (rest != 0) & (free > 0) & (F.try_mod(rest, free) != 0)
    share = F.floor(F.try_divide(rest, free)).cast("long")
    wanted = F.zip_with(cabinets, kinds, lambda c, k: F.when((rest != 0) & (k != "equipment"), c + share).otherwise(c))
    past = F.exists(F.zip_with(wanted, kinds, lambda c, k: (k != "equipment") & ((c < F.element_at(bounds, k)["low"]) | (c > F.element_at(bounds, k)["high"]))), lambda x: x)
    stuck = (rest != 0) & ((free == 0) | past)
    off = add(F.zip_with(new_fillers, wanted_fillers, lambda a, b: F.abs(a - b))) + add(F.zip_with(new_cabinets, wanted, lambda a, b: F.abs(a - b)))
    condition = (
        F.when(~shape, "run_shape_unsupported")
        .when(must_move & ~alike, "filler_apportionment_not_determined")
        .when(uneven, "share_does_not_divide")
        .when((rest != 0) & (free == 0), "cannot_resolve")
        .when(share_odd, "share_does_not_divide")
        .when(stuck, "cannot_resolve")
        .when(difference == 0, "no_change_required")
        .when(rest == 0, "fillers_absorb")
        .otherwise("cabinets_absorb_remainder")
    )
    decided = condition.isin("no_change_required", "fillers_absorb", "cabinets_absorb_remainder")
    return F.struct(F.when(decided, verdict(off == 0)).otherwise(REVIEW_REQUIRED).alias("outcome"), condition.alias("condition"), F.when(decided, off).alias("deviation"))


#: The closed registry: name to (kind, function).
REGISTRY = {
    **{f.__name__: ("verdict", f) for f in (exists, equals, within_tolerance, minimum, maximum, between, one_of, contains, conditional_required, count_equals, sum_within_tolerance, all_within_tolerance, alignment)},
    **{name: ("derivation", f) for name, f in (("difference_between", difference_between), ("scale", scale), ("sum", total), ("count", count), ("row_total", row_total))},
    "pairwise_within_tolerance": ("verdict", pairwise),
    "filler_distribution": ("verdict", filler_distribution),
    "cabinet_run_distribution": ("verdict", cabinet_run),
}


def resolve(name: str):
    """An operation by name; an unknown one is an error."""
    if name not in REGISTRY:
        raise KeyError(f"no operation {name}")
    return REGISTRY[name]
