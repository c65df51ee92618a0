"""Labels by hand: plain dimensions, pairs of millimetres and inches, sums, shares, and what states inches."""

from fractions import Fraction

from pyspark.sql import functions as F

from planlark.functions import labels as L


def read(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def values(spark, f, cases):
    got = read(spark, f, list(cases))
    assert {t: v and Fraction(v["num"], v["den"]) for t, v in zip(cases, got, strict=True)} == {t: v if v is None else Fraction(v) for t, v in cases.items()}


def test_parse_inches(spark):
    values(spark, L.parse_inches, {
        "610 [24]": 24, "1067 [ 42 1/2 ]": "85/2", '31"': 31, '25 1/2"': "51/2", "5'-0\"": 60, "2' - 10 1/2": "69/2", "6'": 72, "6'-": 72, "787": None, "3 [4] [5]": None, "": None, " ": None,
        "24 in": 24, "24 in.": 24, "24.25 inches": "97/4", "24 inch": None, "24 mm": None, "1/0 in": None, "6'\"": None, "5’ 6″": 66, "[24.5]": "49/2", "[24-1/2]": None, "12345678901": None, "half": None,
    })


def test_plain_dimension(spark):
    values(spark, L.plain_dimension, {
        '14 3/8"': "115/8", "30": None, '4"+1"': None, "648 [25 1/2]": "51/2", "25 [635]": 25, '25" [635]': 25, "635 [25]": 25, "305 [10]": None, "2 [54]": None, "610 [24-3/4]": None, "629 [24-3/4]": "99/4",
        "7 [3/8]": None, "1372 [54]": 54, '163/8"': None, '5/4"': None, '3/5"': None, "305 mm [12]": None, "0 [0]": None, '610" [24]': None, "610 [24] x": None, "a": None, "": None, "1/0 [1]": None, "6'-2\"": 74,
    })
    values(spark, lambda c: L.plain_dimension(c, worded=True), {"305 mm [12]": 12, '12" [305MM]': 12, "305 [12 mm]": None})


def test_expand_label(spark):
    cases = {
        '4"+1" Filler': ("sum", 5, None), '4"+1"Filler': ("sum", 5, None), '2 1/2" + 1/2"': ("sum", 3, None), '4"+1" panel': None, '4+1"': None, '4"+0"': None, '4" VIF': None, '4"+1" vif': None, '36"(3 EQ)': ("equal-shares", 36, 3),
        '36 1/4" ( 2 eq )': ("equal-shares", "145/4", 2), '36"(1 EQ)': None, "36(3 EQ)": None, '36"(3 EQ) x': None, '14 3/8"': None, "": None, None: None, '+4"': None, '4"+': None, '4"+3/5"': None,
    }
    got = read(spark, L.expand_label, list(cases))
    assert [v and (v["how"], Fraction(v["value"]["num"], v["value"]["den"]), v["shares"]) for v in got] == [v and (v[0], Fraction(v[1]), v[2]) for v in cases.values()]


def test_pairs_that_disagree_say_so(spark):
    got = read(spark, L.pair, ["305 [10]", "305 [12]", "305", None, "305 mm [12]", "x [12]"])
    assert [v and v["refusal"] for v in got] == ["mm_and_inches_disagree", None, None, None, None, None]
    assert got[1]["inches"] == "12"
