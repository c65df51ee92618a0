"""Dual labels, text beside lines, and trigram matches against plain rules over all pairs."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from planlark.functions import rational as R
from planlark.functions import units as U
from planlark.operators import evidence as E
from planlark.operators import geometry as G
from planlark.operators import retrieval as L


def readings(spark, groups):
    """groups: {label: [(extractor, vendor, value's text, raw text, unit or None without a value)]}."""
    rows = [(k, *r) for k, rs in groups.items() for r in rs]
    df = spark.createDataFrame(rows, "label string, extractor string, key string, token string, raw string, unit string")
    inches = F.when(F.col("unit") == "in", U.normalise_to_inches(U.canonical_notation(F.col("token"))["token"])["value"])
    df = df.withColumn("inches", inches).withColumn("value", F.when(F.col("unit") == "mm", F.regexp_extract("token", r"\d+", 0).cast("double")).otherwise(F.col("inches.num") / F.col("inches.den")))
    df = df.withColumns({"semantic": F.lit("width"), "stacked": F.lit(False), "system": E.authored_units(F.col("token"), F.col("raw"), F.col("unit")), "dual": E.dual_halves(F.col("token"), F.col("raw"), F.col("inches"))})
    return df.withColumn("value", F.when(F.col("unit").isNotNull(), F.col("value")))


def test_dual_labels_are_agreed_on_both_halves(spark):
    a = lambda text, unit="in", token=None: ("a", "v1", token or text, text, unit)
    b = lambda text, unit="in", token=None: ("b", "v2", token or text, text, unit)
    cases = {
        "both halves": ([a("914 [36]"), b("914 [36]")], E.CORROBORATED),
        "unit word": ([a('914mm [36"]'), b("914 [36]")], E.CORROBORATED),
        "token of the value": ([a("914 [36]", token='36"'), b("914 [36]")], E.CORROBORATED),
        "one vendor": ([a("914 [36]"), ("b", "v1", "914 [36]", "914 [36]", "in")], E.RAW),
        "other millimetres": ([a("914 [36]"), b("920 [36]")], E.RAW),
        "beside plain inches": ([a("914 [36]"), b('36"')], E.RAW),
        "beside millimetres": ([a("914 [36]"), b("914 mm", "mm")], E.RAW),
        "halves that disagree": ([a("950 [36]"), b("950 [36]")], E.RAW),
        "other inches": ([a("914 [36]"), b("914 [37]")], E.CONFLICTING),
        "other plain inches": ([a("914 [36]"), b('37"')], E.CONFLICTING),
        "plain inches": ([a('36"'), b('36"')], E.CORROBORATED),
        "a reading without a value abstains": ([a("914 [36]"), b("914 [36]"), ("c", "v3", "914", "914", None)], E.CORROBORATED),
        "one reading": ([a("914 [36]")], E.RAW),
        "two labels in one reading": ([a("914 [36]", token="915 [36]"), b("914 [36]")], E.RAW),
    }
    got = {r.label: r.status for r in E.corroborate(readings(spark, {k: v[0] for k, v in cases.items()}), "label").collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_one_dual_label_of_several_passes(spark):
    r = lambda *texts: [("a", "v", t, t, "in") for t in texts]
    groups = {"none": r('36"', '36"'), "same": r("914 [36]", '914mm [36"]'), "other": r("914 [36]", "915 [36]"), "plain": r("914 [36]", '36"'), "unread": r("914 [x]", "914 [x]")}
    got = {x.label: x.one for x in E.one_dual_label(readings(spark, groups), "label").collect()}
    assert got == {"none": True, "same": True, "other": False, "plain": False, "unread": False}


def test_rationals_of_a_label(spark):
    row = spark.range(1).select(E.dual_halves(F.lit("914 [36]"), F.lit("914 [36]"), R.rational(72, 2)).alias("a"), E.dual_halves(F.lit("914 [36]"), F.lit(None).cast("string"), R.rational(36)).alias("b")).first()
    assert row.a == row.b and row.a.mm == 914 and row.a.agree


def near(text, lines, limit, margin):
    """One number's line by exact distances."""
    _, _, x, y, along, lx, ly = text
    p = (Fraction(x if lx is None else lx), Fraction(y if ly is None else ly)) if x is not None or lx is not None else None
    if p is None:
        return "out_of_range", None
    seen = []
    for _, line, x0, y0, x1, y1 in lines:
        dx, dy = x1 - x0, y1 - y0
        t = max(Fraction(0), min(Fraction(1), ((p[0] - x0) * dx + (p[1] - y0) * dy) / Fraction(dx * dx + dy * dy))) if dx or dy else Fraction(0)
        d2 = (p[0] - x0 - t * dx) ** 2 + (p[1] - y0 - t * dy) ** 2
        if d2 <= limit * limit:
            seen.append((d2, line, "h" if abs(dx) > abs(dy) else "v" if abs(dy) > abs(dx) else None))
    if not seen:
        return "out_of_range", None
    if lx is None:
        if any(s[2] is None for s in seen):
            return "no_axis", None
        seen = [s for s in seen if s[2] == along]
    if not seen:
        return "other_way", None
    seen.sort()
    if len(seen) > 1:
        excess = seen[1][0] - seen[0][0] - margin * margin
        if excess <= 0 or excess * excess <= 4 * margin * margin * seen[0][0]:
            return "ambiguous", None
    return "associated", seen[0][1]


def test_numbers_beside_lines(spark):
    rng = random.Random(8)
    lines, texts = [], []
    for page in range(5):
        for n in range(12):
            x, y, long = rng.randint(0, 400), rng.randint(0, 400), rng.choice((5, 60, 300))
            lines.append((page, n, x, y, *rng.choice(((x + long, y), (x, y + long), (x - long, y + 2), (x + long, y + long) if n == 0 else (x + long, y)))))
        texts += [(page, n, rng.randint(0, 400), rng.randint(0, 400), rng.choice("hv"), *((rng.randint(0, 400), rng.randint(0, 400)) if rng.random() < 0.2 else (None, None))) for n in range(80)]
    lines += [(9, 1, 0, 10, 100_000, 10), (9, 2, 50, 0, 50, 0), (9, 3, 0, 40, 100_000, 40)]
    texts += [(9, 1, 70_000, 12, "h", None, None), (9, 2, 52, 3, "h", None, None), (9, 3, None, None, "h", None, None), (9, 4, 500, 25, "h", None, None), (9, 5, 500, 30, "v", None, None), (9, 6, 500, 30, "v", 500, 39)]
    t = spark.createDataFrame(texts, "page int, text int, x int, y int, along string, lx int, ly int").withColumn("n", F.lit(0))
    df = G.text_lines(t, spark.createDataFrame(lines, "page int, line int, x0 int, y0 int, x1 int, y1 int"), ["page"], 16.0, 3.0)
    got = {(r.page, r.text): (r.state, r.line) for r in df.collect()}
    want = {(x[0], x[1]): near(x, [s for s in lines if s[0] == x[0]], 16, 3) for x in texts}
    assert got == want and {s for s, _ in want.values()} == {"associated", "out_of_range", "no_axis", "other_way", "ambiguous"}


def grams(text):
    return {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() for i in range(len(w) + 1)}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_trigram_lane_equals_all_pairs(spark, threshold):
    rng = random.Random(9)
    name = lambda: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))
    left, right = [(i, name()) for i in range(90)] + [(500, ""), (501, None), (502, "!!")], [(i, name()) for i in range(90)] + [(600, "abc"), (601, "abc"), (602, None)]
    frames = [spark.createDataFrame(x, "id long, text string") for x in (left, right)]
    got = {(r.left_id, r.right_id): r.score for r in L.trigram_lane(*frames, threshold).collect()}
    alike = lambda a, b: len(a & b) / len(a | b)
    want = {(i, j): round(s, 6) for i, a in left for j, b in right if a and b and (ga := grams(a)) and (gb := grams(b)) and (s := alike(ga, gb)) >= threshold}
    assert got == want
    if threshold == 0.6:
        met = sum(1 for _, a in left for _, b in right if grams(a or "") & grams(b or ""))
        assert L.trigram_candidates(*frames, threshold).count() < met / 3


def test_best_identifier_of_each_item(spark):
    subjects = spark.createDataFrame([("s", "base cabinet"), ("t", "tall"), ("u", None)], "subject string, text string")
    found = L.best_identifiers(subjects, spark.createDataFrame([("i", "base cabinet"), ("i", "base cabinets"), ("j", "cabinet base"), ("j", "base cabinet "), ("k", "wall"), ("l", None)], "item string, text string"), 0.3)
    assert {(r.subject, r["item"]): (r.identifier, r.score) for r in found.collect()} == {("s", "i"): ("base cabinet", 1.0), ("s", "j"): ("base cabinet ", 1.0)}
