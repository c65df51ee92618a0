"""The positional index against a scan of every text, and builds that write only what has changed."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from planlark.operators.text_index import TextIndex

TEXTS = "scope string, id long, text string"


def words(text):
    return [w for w in re.split(r"[^\w]+", text.lower()) if w]


def brute(rows, queries):
    """Ranks from every window of every text."""
    texts = {}
    for scope, i, text in rows:
        if i is not None and text is not None:
            texts[scope, i] = max(texts.get((scope, i), ""), text)
    out = {}
    for q, asked in queries:
        if asked is None:
            continue
        alts = [[]]
        for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', asked):
            if word.lower() == "or" and not sign:
                alts.append([])
            elif w := words(phrase or word):
                alts[-1].append((sign == "-", w))
        for key, text in texts.items():
            have, best = words(text), None
            if asked.strip() and asked.strip().lower() in text.lower():
                best = 0.0
            for alt in alts:
                starts = [[i for i in range(len(have)) if have[i : i + len(w)] == w] for _, w in alt]
                wanted = [(w, s) for (no, w), s in zip(alt, starts) if not no]
                if not wanted or any(s for (no, _), s in zip(alt, starts) if no) or not all(s for _, s in wanted):
                    continue
                ok = {(a, b) for a in range(len(have)) for b in range(a, len(have)) if all(any(a <= i and i + len(w) - 1 <= b for i in s) for w, s in wanted)}
                least = [(a, b) for a, b in ok if not any((x, y) != (a, b) and a <= x and y <= b for x, y in ok)]
                every = {t for w, _ in wanted for t in w}
                best = max(best or 0.0, sum(0.1 / (1 + (b - a + 1) - sum(have[i] in every for i in range(a, b + 1))) for a, b in least))
            if best is not None:
                out[q, *key] = round(best, 6)
    return out


def found(df):
    return {(r.query_id, r["scope"], r.id): round(r["rank"], 6) for r in df.collect()}


ROWS = [
    ("a", 1, "The red ring, the RED ring and a blue-ring."), ("a", 2, "blue ring red"), ("a", 3, "ring ring ring"), ("b", 1, "Glued tored ringing words"), ("b", 2, ""), ("b", 3, "   "), ("b", 4, "100% sure_thing \\ 50%"),
    ("b", 5, "Straße ÉCOLE 漢字 かな"), (None, 6, "red without scope"), ("b", 7, None), ("c", None, "red lost"), ("c", 8, "red ring"), ("c", 8, "blue ring"), ("d", 9, "x" * 50_000 + " red " + "ab " * 9000 + "ring"), ("d", 10, "or and -red \"ring\""),
]
QUERIES = [
    'red ring', '"red ring"', '"ring red"', "ring -blue", "-blue", "red or blue", '"blue ring" or glued -words', "ed rin", "g", "ri", "0% s", "%", "_", "\\", "ÉCOLE", "école", "straße", "漢", "字 か", "", "  ", "ring ring", '"ring ring"', "RED RING", "unknown", "red unknown", "red -\"red ring\"", "..., !",
    "  red  ", '"unclosed ring', "or", "blue-ring", "ab ab", "xx red",
]


def test_search_equals_a_scan(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), 3)
    index.build(spark.createDataFrame(ROWS, TEXTS).withColumns({"part": F.lit(9), "term": F.lit("t"), "words": F.lit("w")}))
    queries = [*enumerate(QUERIES), (99, None)]
    got = found(index.search(spark.createDataFrame(queries, "query_id int, text string").withColumn("id", F.lit(5))))
    want = brute([r for r in ROWS if r[1] != 9], queries)
    assert {k: v for k, v in got.items() if k[2] != 9} == want
    long = {k[0]: v for k, v in got.items() if k[2] == 9}
    assert {QUERIES[q] for q in long} == {"red ring", "red or blue", "g", "ri", "ab ab", "xx red", "ring -blue", "ring ring", "RED RING", "  red  ", 'red -"red ring"'}
    assert long[0] == round(0.1 / (1 + 9000), 6)


def test_search_in_one_scope(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), 3)
    index.build(spark.createDataFrame(ROWS[:10], TEXTS))
    got = found(index.search(spark.createDataFrame([(1, "red ring", "a"), (2, "red ring", "zz"), (3, "ed ring", "b")], "query_id int, text string, scope string")))
    assert set(got) == {(1, "a", 1), (1, "a", 2), (3, "b", 1)}


@pytest.mark.parametrize("seed", [1])
def test_random_texts(spark, tmp_path, seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice("ab abc b c cab".split()) for _ in range(n))
    rows = [(f"s{i % 3}", i, some(rng.randint(0, 14))) for i in range(40)]
    queries = [(i, rng.choice([some(2), f'"{some(2)}"', f'"{some(2)}" -{some(1)}', f"{some(1)} or {some(2)}", some(3)[1:-1], f'"{some(3)}" {some(1)}'])) for i in range(60)]
    index = TextIndex(spark, str(tmp_path / "i"), 2)
    index.build(spark.createDataFrame(rows, TEXTS).repartition(4))
    assert found(index.search(spark.createDataFrame(queries, "query_id int, text string"))) == brute(rows, queries)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_build_writes_what_has_changed(spark, tmp_path):
    path = str(tmp_path / "i")
    rows = [(f"scope {s}", i, f"text {s} {i} red") for s in range(12) for i in range(3)]
    build = lambda rs: TextIndex(spark, path, 6).build(spark.createDataFrame(rs, TEXTS))
    assert build(rows) == sorted(set(build_parts(spark, path, rows)))
    before = files(path)
    assert build(rows[::-1]) == [] and files(path) == before
    changed = [(s, i, t + " more" if (s, i) == ("scope 4", 1) else t) for s, i, t in rows]
    assert len(part := build(changed)) == 1
    after = files(path)
    assert {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)} == {f for f in before.keys() | after.keys() if f"part={part[0]}/" in f}
    search = lambda q: found(TextIndex(spark, path, 6).search(spark.createDataFrame([(1, q)], "query_id int, text string")))
    assert set(search("more")) == {(1, "scope 4", 1)}
    # a scope that is gone, the last one of its folder or not, is found no longer
    assert build([r for r in changed if r[0] != "scope 4"])
    assert search("more") == {} and len(search("red")) == 33
    assert build([]) and search("red") == {} and build([]) == []


def build_parts(spark, path, rows):
    index = TextIndex(spark, path, 6)
    return [r.part for r in spark.createDataFrame(rows, TEXTS).select(index.part_of(F.col("scope")).alias("part")).distinct().collect()]


def test_search_reads_no_texts(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), 2)
    index.build(spark.createDataFrame(ROWS, TEXTS))
    plan = index.search(spark.createDataFrame([(1, "red")], "query_id int, text string"))._jdf.queryExecution().toString()
    assert "/words" in plan and "/grams" in plan and not re.search(r"FileScan[^\n]*\btext\b", plan)
