"""Evidence from readings: typed refusals, independence, consensus between readers, and the gate before a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlark.functions import rational as R
from planlark.functions import units as U

RAW, CORROBORATED, CONFLICTING, CONFIRMED, REJECTED = "RAW_CANDIDATE", "CORROBORATED", "CONFLICTING", "HUMAN_CONFIRMED", "REJECTED"


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds, null where none does. C1, F14."""
    out = F.when(*checks[0])
    for cond, name in checks[1:]:
        out = out.when(cond, name)
    return out


def normalize(c: DataFrame) -> DataFrame:
    """Adds ``refusal``: why a candidate is not an observation. C1."""
    return c.withColumn(
        "refusal",
        first_reason(
            (F.coalesce(F.trim("raw_text"), F.lit("")) == "", "EMPTY_TEXT"),
            (F.col("parsed_value").isNull(), "UNPARSED"),
            (F.col("unit_guess").isNull(), "NO_UNIT"),
            (~F.col("unit_guess").isin("mm", "in"), "UNKNOWN_UNIT"),
            (F.col("page") < 1, "BAD_PAGE"),
            (~F.col("confidence").between(0, 1), "BAD_CONFIDENCE"),
        ),
    )


#: Which vendor trains a model family.
VENDORS = {"claude": "anthropic", "anthropic": "anthropic", "gpt": "openai", "gemini": "google", "nova": "amazon"}


def independence_key(extractor: Column, version: Column, vendors: dict[str, str] | None = None) -> Column:
    """vendor:<name> for known model families, one key for unknown models, else route:<extractor>. C2."""
    bare = F.regexp_replace(version, r"^(us|eu|apac|global)\.", "")
    out = None
    for prefix, vendor in (vendors or VENDORS).items():
        key = F.lit(f"vendor:{vendor}")
        out = F.when(bare.startswith(prefix), key) if out is None else out.when(bare.startswith(prefix), key)
    return out.when(extractor.startswith("model"), "vendor:unknown").otherwise(F.concat(F.lit("route:"), extractor))


def authored_units(value_text: Column, raw_text: Column, unit: Column) -> Column:
    """The unit system that a reading was written in: dual where one of its texts has brackets, else what marks its value's
    text (its raw text where there is none), else its unit. C3."""
    brackets = lambda t: F.coalesce(t.contains("[") & t.contains("]"), F.lit(False))
    text = F.coalesce(F.nullif(value_text, F.lit("")), raw_text)
    return F.when(brackets(value_text) | brackets(raw_text), "dual").when(text.rlike(r"(?i)\bmm\b"), "mm").when(text.rlike(r"""(?i)"|'|\b(in|inch|inches|ft|feet)\b"""), "in").otherwise(unit)


def dual_halves(value_text: Column, raw_text: Column, inches: Column) -> Column:
    """struct<mm, inch, agree>: both halves of the one dual label that a reading states, null where it states none, several
    or two dimensions; the inches are its value, given as a rational. ``agree``: both within half of their written steps. C3, C4."""
    texts = F.array_distinct(F.filter(F.array(value_text, raw_text), lambda t: t.isNotNull() & (t != "")))

    def read(ts: Column) -> Column:
        stated = F.array_distinct(F.filter(F.transform(ts, U.canonical_notation), lambda x: x["mm"].isNotNull()))
        compound = F.exists(ts, lambda t: F.coalesce(U.is_compound(t), F.lit(False)))
        return R.let(F.when((F.size(stated) == 1) & ~compound & inches.isNotNull(), F.try_element_at(stated, F.lit(1))), halves)

    def halves(x: Column) -> Column:
        mm = R.rational(x["mm"].try_cast("long"))
        gap = R.magnitude(R.sub(mm, R.mul(inches, R.rational(127, 5))))
        allowed = R.add(U.rounding_band_mm(x["mm"], False), U.rounding_band_mm(x["token"], True))
        return F.when(x.isNotNull(), F.struct(x["mm"].try_cast("long").alias("mm"), (inches["num"].cast("decimal(19,0)") / inches["den"].cast("decimal(19,0)")).alias("inch"), F.coalesce(R.le(gap, allowed), F.lit(False)).alias("agree")))

    return R.let(texts, read)


def corroborate(candidates: DataFrame, label: str) -> DataFrame:
    """(label, status, readers, values): consensus of the readings of one label. C3, A22.

    candidates: label, extractor, key (independence), value, unit, semantic, stacked; also ``system`` (``authored_units``) and
    ``dual`` (``dual_halves``) where texts are known. Readings without a value abstain. Values are compared where all were
    written in one system, or dual beside plain inches; a dual label is agreed only on both halves by every reader, each
    reader's own halves agreeing. Only the two counts that are returned are distinct counts; elsewhere the least and the
    greatest tell whether there are several.
    """
    for name, default in (("system", F.col("unit")), ("dual", F.lit(None).cast("struct<mm:int,inch:int,agree:boolean>"))):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, default)
    valued = F.col("value").isNotNull()
    n = lambda c: F.count_distinct(F.when(valued, F.col(c)))
    several = lambda c: F.coalesce(F.min(F.when(valued, F.col(c))) < F.max(F.when(valued, F.col(c))), F.lit(False))
    any_of = lambda c: F.coalesce(F.bool_or(valued & c), F.lit(False))
    is_dual = F.col("system") == "dual"
    candidates = candidates.withColumn("__halves", F.when(F.col("dual.agree"), F.struct("dual.mm", "dual.inch")))
    found = candidates.groupBy(label).agg(
        F.coalesce(F.bool_or("stacked"), F.lit(False)).alias("stacked"),
        F.count_if(valued).alias("readings"),
        n("extractor").alias("readers"),
        several("key").alias("independent"),
        several("system").alias("systems"),
        any_of(~F.coalesce(F.col("system").isin("dual", "in"), F.lit(False))).alias("others"),
        several("unit").alias("units"),
        any_of(is_dual).alias("some_dual"),
        any_of(~F.coalesce(is_dual, F.lit(False)) | F.col("__halves").isNull()).alias("not_dual"),
        several("__halves").alias("halves"),
        n("value").alias("values"),
        several("semantic").alias("semantics"),
        F.count_if(valued & F.col("semantic").isNotNull()).alias("typed"),
        F.count_if(valued & F.col("semantic").isNull()).alias("untyped"),
    )
    status = (
        F.when(F.col("stacked") | (F.col("readings") < 2) | (F.col("readers") < 2) | (F.col("systems") & F.col("others")), RAW)
        .when((F.col("values") > 1) | F.col("units"), CONFLICTING)
        .when(F.col("some_dual") & (F.col("not_dual") | F.col("halves")), RAW)
        .when(~F.col("independent"), RAW)
        .when(~F.col("semantics") & (F.col("typed") > 0) & (F.col("untyped") == 0), CORROBORATED)
        .otherwise(RAW)
    )
    return found.select(label, status.alias("status"), "readers", "values")


def one_dual_label(readings: DataFrame, label: str) -> DataFrame:
    """(label, one): whether a region's agreed readings (system, dual) of several passes state one dual label: none is dual,
    or all are, with the same agreeing halves. It only ever holds a region back. C3."""
    halves = F.when(F.col("dual").isNotNull() & F.col("dual.agree"), F.struct("dual.mm", "dual.inch"))
    is_dual = F.coalesce(F.col("system") == "dual", F.lit(False))
    same = F.bool_and(is_dual & halves.isNotNull()) & (F.min(halves) == F.max(halves))
    return readings.groupBy(label).agg((~F.bool_or(is_dual) | F.coalesce(same, F.lit(False))).alias("one"))


def gate(status: Column, second_reader: Column, human: Column, authority: Column, value: Column, unit: Column, drawn_length: Column | None = None, role: Column | None = None) -> Column:
    """The refusal of a sealing, null where the operand is sealed. C5.

    A corroborated reading needs a second reader or a person; the architect's own printed text also passes by its drawn
    length (``drawn_length`` with the role ARCH), a vendor's never does."""
    witness = F.coalesce(drawn_length & (role == "ARCH"), F.lit(False)) if drawn_length is not None and role is not None else F.lit(False)
    return first_reason(
        (~F.coalesce(status.isin(CORROBORATED, CONFIRMED), F.lit(False)), "NOT_QUALIFIED"),
        (~(second_reader | human | witness), "NOT_QUALIFIED"),
        (authority == "ADVISORY", "ADVISORY"),
        (value.isNull(), "NO_VALUE"),
        (~F.coalesce(unit.isin("mm", "in"), F.lit(False)), "UNKNOWN_UNIT"),
    )


def semantic_type(tag: Column, known: dict[str, str], suggested_by_agent: Column) -> Column:
    """Exact tags only; what an agent suggests never qualifies. C6."""
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), tag)
    return F.when(~suggested_by_agent, mapped)


def to_unit_square(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Page points (origin below) to stored 0..1 (origin above). C7."""
    return F.struct((x / width).alias("x"), (1 - y / height).alias("y"))


def twice_area(points: Column) -> Column:
    """Shoelace sum of an array<struct<x,y>>; 0 is no polygon. C8."""
    n = F.size(points)
    return F.abs(F.aggregate(F.transform(points, lambda p, i: p["x"] * points[F.try_mod(i + 1, n)]["y"] - points[F.try_mod(i + 1, n)]["x"] * p["y"]), F.lit(0).cast("long"), lambda a, v: a + v))


def seal_label(first: Column, second: Column, held: Column) -> Column:
    """struct<value, state> of a label from two readers: sealed only where both say the same and nothing holds it. C9."""
    state = F.when(held, "held").when(first.isNull() | second.isNull(), "one_reader").when(first != second, "disagree").otherwise("sealed")
    return F.struct(F.when(state == "sealed", first).alias("value"), state.alias("state"))


def slot_value(labels: DataFrame, slot: str, value: str, no_dimension: str) -> DataFrame:
    """(slot, value, state): exactly one label that is a dimension, else review. C10."""
    real = F.when(F.col(value) != no_dimension, F.col(value))
    found = labels.groupBy(slot).agg(F.count(real).alias("__n"), F.max(real).alias("__v"))
    return found.select(slot, F.when(F.col("__n") == 1, F.col("__v")).alias("value"), F.when(F.col("__n") == 1, "one").when(F.col("__n") == 0, "none").otherwise("several").alias("state"))


def row_check(claims: DataFrame, own: DataFrame, ref: str, order: str) -> DataFrame:
    """Each reference once (the first claim); a claim that differs from the code's own comparison is unsure. C11."""
    first = claims.withColumn("__n", F.row_number().over(Window.partitionBy(ref).orderBy(order))).filter("__n = 1").drop("__n")
    both = first.join(own.withColumnRenamed("result", "own"), ref, "left")
    return both.withColumn("answer", F.when(F.col("claim").eqNullSafe(F.col("own")), F.col("claim")).otherwise("unsure"))


def combine_panels(panels: DataFrame, job: str, value: str) -> DataFrame:
    """AUTO only where all panels hold one value. C12."""
    one = F.min(value) == F.max(value)
    return panels.groupBy(job).agg(F.when(one, F.min(value)).alias("value"), F.when(F.coalesce(one, F.lit(False)), "AUTO").otherwise("ASK").alias("decision"))


def paired_answers(a: DataFrame, b: DataFrame, keys: list[str], position: str, text: str) -> DataFrame:
    """Two readers by position: they agree only on the same text. C13."""
    left, right = a.select(*keys, position, F.col(text).alias("a_text")), b.select(*keys, position, F.col(text).alias("b_text"))
    both = left.join(right, [*keys, position], "full_outer")
    return both.withColumn("agree", F.coalesce(F.col("a_text") == F.col("b_text"), F.lit(False)))
