"""Inches and millimetres as drawings write them, read exactly.

Parsers take a string column and return a struct with the value (a rational, or null) and the reason for a refusal (or
null). Nothing is rounded: 25.4 mm to the inch is 127/5, and twelve inches are a foot.

A text is read as its form and its numbers. The form has a ``#`` for each run of digits and a letter for each unit (``F``
feet, ``I`` inches, ``J`` the word inch, ``M`` millimetres), with single spaces, none beside units and hyphens; so ``3' -
6 1/2"`` is ``#F-# #/#I`` with the numbers 3, 6, 1, 2. Rules compare forms and compute from the numbers.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlark.functions import rational as R

#: How fonts write the marks of feet, inches and the hyphen.
MARKS = {"″": '"', "′": "'", "’": "'", "‘": "'", "”": '"', "“": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-"}
#: Fixed value: the slash that Unicode writes inside a fraction.
FRACTION_SLASH = "⁄"
#: Fixed value: the finest fraction of an inch that is drawn.
MAXIMUM_DENOMINATOR = 64

#: Forms of one quantity, and the unit words of forms, longer ones first.
WHOLE, DECIMAL, FRACTION, MIXED, JOINED = "#", "#.#", "#/#", "# #/#", "#-#/#"
WORDS = (("inches", "I"), ("inch", "J"), ("in", "I"), ("feet", "F"), ("ft", "F"), ("mm", "M"), ("\"", "I"), ("'", "F"))
YARDS = ("yd", "yds", "yard", "yards")


def vulgar_fractions() -> dict[str, str]:
    """Every character that stands for a fraction, and its plain form, by Unicode's own rule."""
    found = [chr(c) for c in (*range(0xA0, 0x100), *range(0x2150, 0x2190)) if unicodedata.decomposition(chr(c)).startswith("<fraction>")]
    return {c: unicodedata.normalize("NFKD", c).replace(FRACTION_SLASH, "/") for c in found}


def fold_fractions(c: Column) -> Column:
    """Vulgar fractions as digits, apart from digits beside them."""
    out = c
    for char, plain in vulgar_fractions().items():
        out = F.regexp_replace(out, f"(?<=[0-9]){char}", f" {plain}")
        out = F.regexp_replace(out, f"{char}(?=[0-9])", f"{plain} ")
        out = F.replace(out, F.lit(char), F.lit(plain))
    out = F.replace(out, F.lit(FRACTION_SLASH), F.lit("/"))
    return F.when(c.rlike(f"[{''.join(vulgar_fractions())}{FRACTION_SLASH}]"), out).otherwise(c)


def plain_marks(c: Column) -> Column:
    return F.replace(F.translate(fold_fractions(c), "".join(MARKS), "".join(MARKS.values())), F.lit("''"), F.lit('"'))


def form(c: Column) -> Column:
    """The text's form; letters that are no unit stay as they are."""
    out = F.regexp_replace(F.lower(c), "[0-9]+", "#")
    for word, letter in WORDS:
        out = F.replace(out, F.lit(word), F.lit(letter))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.regexp_replace(out, " ?([FIJM-]) ?", "$1")


def numbers(c: Column) -> Column:
    """The runs of digits, as text."""
    return F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))


def number(found: Column, k: int) -> Column:
    return F.try_element_at(found, F.lit(k)).try_cast("long")


def decimal_value(found: Column, k: int = 1) -> Column:
    """A decimal's exact value from the runs of digits around its point."""
    places = F.try_element_at(found, F.lit(k + 1))
    digits = F.concat(F.try_element_at(found, F.lit(k)), places).try_cast("long")
    return R.rational(digits, F.rpad(F.lit("1"), F.length(places) + 1, F.lit("0")).try_cast("long"))


def quantity(shape: Column, found: Column, k: int = 1) -> Column:
    """The value of a form of one quantity, its numbers from the k-th on; null for other forms and a zero below."""
    a, b, c = (number(found, k + i) for i in range(3))
    return (
        F.when(shape == WHOLE, R.rational(a))
        .when(shape == DECIMAL, decimal_value(found, k))
        .when(shape == FRACTION, F.when(b != 0, R.rational(a, b)))
        .when(shape.isin(MIXED, JOINED), F.when(c != 0, R.rational(a * c + b, c)))
    )


def parse_imperial(c: Column) -> Column:
    """struct<value, refusal>: an optional minus, then a whole number, a/b, w a/b or a decimal, then an optional mark."""

    def read(token: Column) -> Column:
        unsigned = F.when(token.startswith("-"), F.ltrim(F.substring(token, F.lit(2), F.length(token)))).otherwise(token)
        bare = F.rtrim(F.when(unsigned.endswith('"'), F.substring(unsigned, F.lit(1), F.length(unsigned) - 1)).otherwise(unsigned))
        return R.let2(form(bare), numbers(bare), lambda shape, found: valued(token, bare, shape, found))

    def valued(token: Column, bare: Column, shape: Column, found: Column) -> Column:
        size = F.when(shape != JOINED, quantity(shape, found))
        below = F.when(shape == MIXED, number(found, 3)).when(shape == FRACTION, number(found, 2))
        refusal = F.when(token.isNull() | (bare == ""), "empty").when(below == 0, "zero_denominator").when(size.isNull(), "unsupported")
        return F.struct(F.when(token.startswith("-"), R.neg(size)).otherwise(size).alias("value"), refusal.alias("refusal"))

    return R.let(F.trim(c), read)


def format_inches(value: Column) -> Column:
    """A mixed number; the sign stands on the whole."""

    def read(value: Column) -> Column:
        return R.let(R.reduced(R.magnitude(value)), lambda r: written(value, r))

    def written(value: Column, r: Column) -> Column:
        whole = F.floor(r["num"].cast("decimal(19,0)") / r["den"].cast("decimal(19,0)")).cast("long")
        rest = r["num"] - whole * r["den"]
        part = F.concat(rest.cast("string"), F.lit("/"), r["den"].cast("string"))
        text = F.when(rest == 0, whole.cast("string")).when(whole == 0, part).otherwise(F.concat(whole.cast("string"), F.lit(" "), part))
        return F.when(value["num"] < 0, F.concat(F.lit("-"), text)).otherwise(text)

    return R.let(value, read)


def dual_parts(token: Column) -> tuple[Column, Column, Column]:
    """Whether the text is a number and something in brackets, and both parts."""
    before, inside = F.rtrim(F.substring_index(token, "[", 1)), F.substring_index(token, "[", -1)
    within = F.trim(F.substring(inside, F.lit(1), F.length(inside) - 1))
    is_dual = token.endswith("]") & (F.size(F.split(token, r"[\[\]]")) == 3) & (F.size(F.split(token, r"\[")) == 2) & (form(before) == WHOLE) & (F.length(inside) > 1)
    return is_dual, before, within


def parse_dual(c: Column) -> Column:
    """struct<mm, inch, refusal>: a whole number of millimetres, and the inches in brackets where they are given."""

    def read(token: Column) -> Column:
        dual, before, within = dual_parts(token)
        single = form(token) == WHOLE
        facts = F.struct(token.alias("token"), dual.alias("dual"), single.alias("single"), F.when(single, token).when(dual, before).alias("mm"), parse_imperial(within).alias("inch"))
        return R.let(facts, parsed)

    def parsed(x: Column) -> Column:
        mm = R.rational(number(numbers(x["mm"]), 1))
        refusal = F.when(x["token"].isNull() | (x["token"] == ""), "empty").when(~x["single"] & ~x["dual"], "unsupported").when(x["dual"], F.when(x["inch"]["refusal"].isNotNull(), "alternate"))
        return F.struct(mm.alias("mm"), F.when(x["dual"], x["inch"]["value"]).alias("inch"), refusal.alias("refusal"))

    return R.let(F.trim(c), read)


def drawn_denominator(den: Column) -> Column:
    """Halves, quarters and so on down to the finest that is drawn."""
    return den.isin([2**k for k in range(1, MAXIMUM_DENOMINATOR.bit_length())])


def inch_part(shape: Column, found: Column, k: int) -> Column:
    """struct<value, refusal>: inches after feet, under a foot, with a proper fraction over a power of two."""
    split = shape.isin(FRACTION, MIXED, JOINED)
    top = F.when(shape == FRACTION, number(found, k)).otherwise(number(found, k + 1))
    bottom = F.when(shape == FRACTION, number(found, k + 1)).otherwise(number(found, k + 2))
    value = quantity(shape, found, k)
    refusal = (
        F.when(~split & ~shape.isin(WHOLE, DECIMAL), "inch_part")
        .when(split & ~drawn_denominator(bottom), "denominator")
        .when(split & (top >= bottom), "improper")
        .when(R.le(R.rational(12), value), "over_a_foot")
    )
    return F.struct(F.when(refusal.isNull(), value).alias("value"), refusal.alias("refusal"))


def normalise_to_inches(c: Column, unmarked_is_inch: bool = False) -> Column:
    """struct<value, refusal>: millimetres, feet, feet and inches, or marked inches, in inches."""

    def read(token: Column) -> Column:
        return R.let2(form(token), numbers(token), lambda shape, found: ruled(token, shape, found))

    def ruled(token: Column, shape: Column, found: Column) -> Column:
        is_yard = F.arrays_overlap(F.split(F.lower(token), "[^a-z0-9_]+"), F.array(*map(F.lit, YARDS)))
        is_mm = shape.isin("#M", "#.#M")
        mm = quantity(F.rtrim(shape, F.lit("M")), found)
        after = F.regexp_replace(F.when(shape.startswith("#F"), F.substring(shape, 3, 1000)), "^-", "")
        rest = F.regexp_replace(after, "I$", "")
        plain = lambda x: F.length(F.translate(x, "#/. -", "")) == 0
        is_feet = (shape == "#F") | F.coalesce(rest.startswith("#") & plain(rest), F.lit(False))
        feet, part = R.rational(number(found, 1) * 12), inch_part(rest, found, 2)
        marked = shape.rlike("[IJ]$")
        body = F.regexp_replace(shape, "[IJ]$", "")
        is_inch = (body != "") & plain(body) & ~body.contains("-")
        inch = quantity(F.when(body != JOINED, body), found)
        refusal = (
            F.when(token.isNull() | (token == ""), "empty")
            .when(is_yard, "yards")
            .when(is_mm, F.lit(None).cast("string"))
            .when(is_feet, F.when(shape != "#F", part["refusal"]))
            .when(is_inch & ~marked & F.lit(not unmarked_is_inch), "unmarked")
            .when(is_inch, F.when(inch.isNull(), "unreadable"))
            .otherwise("no_unit")
        )
        value = F.when(is_mm, R.mul(mm, R.rational(5, 127))).when(is_feet, F.when(shape == "#F", feet).otherwise(R.add(feet, part["value"]))).when(is_inch, inch)
        return F.struct(F.when(refusal.isNull(), value).alias("value"), refusal.alias("refusal"))

    return R.let(plain_marks(F.trim(c)), read)


def written_fractions(c: Column) -> Column:
    """array<struct<whole, top, bottom>>: the fractions of a text, as digits; chains of several slashes are none."""
    found = F.filter(F.regexp_extract_all(c, F.lit(r"[0-9]+|\S"), F.lit(0)), lambda x: x != "")
    of = lambda t, k: F.when(k >= 1, F.try_element_at(t, F.greatest(k, F.lit(1))))
    is_number = lambda x: F.coalesce(x.rlike("^[0-9]"), F.lit(False))

    def at(t: Column, k: Column) -> Column:
        before = of(t, k - 2)
        whole = F.when(is_number(before), before).when(before == "-", F.when(is_number(of(t, k - 3)), of(t, k - 3)))
        chain = F.coalesce(before == "/", F.lit(False)) | F.coalesce(of(t, k + 2) == "/", F.lit(False))
        good = (of(t, k) == "/") & is_number(of(t, k - 1)) & is_number(of(t, k + 1)) & ~chain
        return F.when(good, F.struct(whole.alias("whole"), of(t, k - 1).alias("top"), of(t, k + 1).alias("bottom")))

    every = R.let(found, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda k: at(t, k)))
    return F.filter(every, lambda x: x.isNotNull())


def fraction_refusal(c: Column, drawn: bool) -> Column:
    """Why a written fraction is refused, of the first one that is: its denominator (drawn text only), or a top not under
    its bottom. ``squeezed`` says that the space after a whole number may be missing.
    """

    def read(x: Column) -> Column:
        t, b = x["top"].try_cast("long"), x["bottom"].try_cast("long")
        # the last k digits of the top, not begun by a zero, may be a proper numerator
        tails = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x["top"]) - 1, F.lit(1))), lambda k: F.struct(F.pow(F.lit(10), k).cast("long").alias("over"), k.alias("k")))
        fits = F.exists(tails, lambda p: (p["k"] < F.length(x["top"])) & (t % p["over"] >= p["over"] / 10) & (t % p["over"] < b))
        improper = F.when(x["whole"].isNull() & ~x["top"].startswith("0") & fits, "squeezed").otherwise("improper")
        wrong = F.when(~drawn_denominator(b), "denominator") if drawn else F.when(b == 0, F.lit(None).cast("string"))
        return wrong.when(t >= b, improper)

    refusals = F.filter(F.transform(written_fractions(plain_marks(c)), read), lambda r: r.isNotNull())
    return F.try_element_at(refusals, F.lit(1))


def is_compound(c: Column) -> Column:
    """Whether a number follows a marked one after a plus or minus."""
    return F.regexp_replace(plain_marks(c), r"\s", "").rlike('"[-+−][0-9]')


def without_note(c: Column) -> Column:
    """The text before a note in parentheses at its end."""
    body = F.substring(c, F.lit(1), F.length(c) - 1)
    last = F.substring_index(body, ")", -1)
    opens = F.instr(last, "(")
    return F.when(c.endswith(")") & (opens > 0), F.rtrim(F.substring(body, F.lit(1), F.length(body) - F.length(last) + opens - 1))).otherwise(c)


def canonical_notation(c: Column) -> Column:
    """struct<token, mm>: a dual label's inches, a trailing note dropped, `25-1/2` with a space."""

    def read(text: Column) -> Column:
        left = F.substring_index(text, "[", 1)
        worded = form(left) == "#M"
        unworded = F.trim(F.when(worded, F.concat(F.try_element_at(numbers(left), F.lit(1)), F.substring(text, F.length(left) + 1, F.length(text)))).otherwise(text))
        return R.let2(text, unworded, labelled)

    def labelled(text: Column, unworded: Column) -> Column:
        dual, mm, inch = dual_parts(unworded)
        facts = F.struct(text.alias("text"), (dual & parse_dual(unworded)["refusal"].isNull()).alias("dual"), mm.alias("mm"), inch.alias("inch"))
        return R.let(facts, lambda x: noted(F.when(x["dual"], F.concat(F.rtrim(x["inch"], F.lit('"')), F.lit('"'))).otherwise(x["text"]), F.when(x["dual"], x["mm"])))

    def noted(token: Column, mm: Column) -> Column:
        bare = R.let(F.trim(token), without_note)
        return F.struct(F.trim(F.regexp_replace(bare, r"(?<![\w'])([0-9]+)-(?=[0-9]+/[0-9])", "$1 ")).alias("token"), mm.alias("mm"))

    return R.let(plain_marks(c), read)


def quantum(raw: Column) -> Column:
    """The step in which a number was written; null where it cannot be told."""

    def read(token: Column) -> Column:
        shape, found = F.rtrim(form(token), F.lit("I")), numbers(token)
        decimal = R.rational(F.lit(1), F.rpad(F.lit("1"), F.length(F.try_element_at(found, F.lit(2))) + 1, F.lit("0")).try_cast("long"))
        bottom = F.when(shape == FRACTION, number(found, 2)).when(shape == MIXED, number(found, 3))
        return F.when(shape == DECIMAL, decimal).when(bottom.isNotNull(), R.rational(F.lit(1), bottom)).when(shape == WHOLE, R.rational(1))

    return R.let(F.trim(raw), read)


def rounding_band_mm(raw: Column, is_inch: bool) -> Column:
    """Half the written step, in millimetres."""
    half = R.mul(quantum(raw), R.rational(1, 2))
    return R.mul(half, R.rational(127, 5)) if is_inch else half


def check_dual(c: Column) -> Column:
    """Whether both halves of a dual label agree within half a step each."""

    def read(token: Column) -> Column:
        dual = parse_dual(token)
        _, mm_raw, inch_raw = dual_parts(token)
        gap = R.magnitude(R.sub(dual["mm"], R.mul(dual["inch"], R.rational(127, 5))))
        allowed = R.add(rounding_band_mm(mm_raw, False), rounding_band_mm(inch_raw, True))
        return F.when(dual["refusal"].isNull(), F.when(dual["inch"].isNull(), "not_corroborated").when(R.le(gap, allowed), "consistent_within_rounding").otherwise("inconsistent"))

    return R.let(F.trim(c), read)


#: Words that hold a whole row for a person, and what undoes the last of them.
FIELD_CUT, VIF = r"(?i)(?<![A-Za-z])INCLUDING\s+FIELD\s+CUT(?![A-Za-z])", r"(?i)(?<![A-Za-z])VIF(?![A-Za-z])"
COUNTER_BREAK = r"(?i)(?<![A-Za-z0-9])(?:REFRIGERATOR|FRIDGE|WASHER|DRYER|RANGE|STOVE|PANTRY|OVEN|TALL|REF|W/D)(?![A-Za-z0-9])"
UNDERCOUNTER = r"(?i)(?<![A-Za-z0-9])(?:UNDER(?:-|\s)?COUNTER|U/C|UC)(?![A-Za-z0-9])"
MICROWAVE_OVEN = r"(?i)(?<![A-Za-z0-9])(?:MICROWAVE|MW)\s+OVEN(?![A-Za-z0-9])"


def row_hold(texts: Column) -> Column:
    """Why a row of texts goes to a person, null where none says so: a width that includes the field cut first, then one to
    be verified in the field. U14."""
    says = lambda pattern: F.exists(texts, lambda t: F.coalesce(t.rlike(pattern), F.lit(False)))
    return F.when(says(FIELD_CUT), "field-cut-included").when(says(VIF), "vif")


def counter_break(phrases: Column) -> Column:
    """The first phrase that names a tall appliance, but for undercounter ones and microwave ovens; null without one. U14."""
    breaks = lambda p: ~p.rlike(UNDERCOUNTER) & F.regexp_replace(p, MICROWAVE_OVEN, " ").rlike(COUNTER_BREAK)
    return F.try_element_at(F.filter(phrases, lambda p: F.coalesce(breaks(F.regexp_replace(p, r"\s+", " ")), F.lit(False))), F.lit(1))
