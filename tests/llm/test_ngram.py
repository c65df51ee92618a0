"""The n-gram Jaccard join against every pair of sets."""

import random
import re
from itertools import combinations

import numpy as np

from planlark.llm import ngram_join
from planlark.llm.components import components
from tests.llm.texts import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (n_shingles, component_id) by all pairs of texts."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    return {(i, len(s), top(i)) for i, every in sets.items() for s in every}


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, cls string, n double")
    out = ngram_join.op4_ngram_join(spark, docs).collect()
    assert len(out) == len(rows)
    return {(r.doc_id, r.n_shingles, r.component_id) for r in out}


def changed(draw, words, rate, vocabulary):
    return [draw.choice(vocabulary) if draw.random() < rate else w for w in words]


def test_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"),
        (7, "One Two Three Four Five"), (8, "é É ü ß x"), (9, "É é ü ß x"), (10, "a b c d e f"), (11, "a b c d e f g"),
        (12, "one two three"), (13, "x" * 50_000),
    ]
    assert found(spark, rows) == brute(rows)


def test_families_of_near_copies(spark):
    draw = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(3000)]
    rows, i = [], 0
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(5, 200))]
        for _ in range(draw.randrange(1, 8)):
            rows.append((i, " ".join(changed(draw, base, draw.choice([0, 0.01, 0.02, 0.04, 0.08]), vocabulary))))
            i += 1
    draw.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_one_large_family_and_a_passage_that_many_share(spark):
    draw = random.Random(2)
    vocabulary = [f"v{k}" for k in range(4000)]
    base, passage = [draw.choice(vocabulary) for _ in range(120)], [draw.choice(vocabulary) for _ in range(60)]
    rows = [(i, " ".join(changed(draw, base, 0.015, vocabulary))) for i in range(60)]
    rows += [(100 + i, " ".join(passage + [draw.choice(vocabulary) for _ in range(draw.randrange(5, 60))])) for i in range(60)]
    rows += [(200 + i, " ".join(base)) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_pairs_at_the_bound(spark):
    words = [f"q{k}" for k in range(600)]
    rows = []
    for k, n in enumerate((7, 14, 28, 70, 140, 280)):
        base = words[: n + 4]  # n shingles
        for extra in range(3):  # sets of n and n - c or more with the rest in common
            rows.append((10 * k + extra, " ".join(base[: n + 4 - (n // 4 - 1 + extra)])))
        rows.append((10 * k + 5, " ".join(base)))
    assert found(spark, rows) == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here now"), (2, "other words are here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op4_ngram_join(spark, docs).collect()}
    assert got == {(None, 2, None), (1, 2, 1), (1, 1, 1), (2, 1, 1)}
    assert ngram_join.op4_ngram_join(spark, docs.limit(0)).count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def links_by_all_pairs(rows):
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    every = set(sets.values())
    near = {x: sum(x != y and 100 * len(x & y) >= 75 * len(x | y) for y in every) if x else 0 for x in every}
    return {i: near[x] for i, x in sets.items()}


def links_found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.links for r in ngram_join.op4_ngram_join(spark, docs).collect()}


def test_links_of_a_large_family(spark, monkeypatch):
    draw = random.Random(3)
    vocabulary = [f"v{k}" for k in range(4000)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join(changed(draw, base, draw.choice([0.005, 0.015, 0.03]), vocabulary))) for i in range(90)]
    rows += [(200 + i, " ".join(base)) for i in range(20)]
    rows += [(300 + i, " ".join(base[40:] + [draw.choice(vocabulary) for _ in range(k)])) for i, k in enumerate(range(5, 45))]
    rows += [(400 + i, t) for i, t in enumerate((None, "", "one two", "a b c d e f g h i", "a b c d e f g h i j"))]
    want = links_by_all_pairs(rows)
    assert max(want.values()) > 50
    assert links_found(spark, rows) == want
    monkeypatch.setattr(ngram_join, "TILE", 16)  # neighbourhoods of many blocks
    monkeypatch.setattr(ngram_join, "CROWD", 16)  # shingles of many blocks
    assert links_found(spark, rows) == want
    assert found(spark, rows) == brute(rows)


def test_trie_join_against_sets():
    draw, plainly = random.Random(5), ngram_join.Sets.plain
    for m, top in ((1, 5), (2, 3), (40, 60), (130, 400)):
        plain = [set(draw.sample(range(top), draw.randrange(1, min(top, 50)))) for _ in range(m)]
        plain += [x | {draw.randrange(top)} for x in plain]
        sets = [np.array(sorted(x), dtype=np.uint64) for x in plain]
        got = {(k, j) for k, own in ngram_join.trie_join(plainly(sets[: m + m // 2]), plainly(sets)) for j in own}
        want = {(k, j) for k in range(len(sets)) for j in range(m + m // 2) if 100 * len(plain[k] & plain[j]) >= 75 * len(plain[k] | plain[j])}
        assert got == want


def test_long_texts_are_hashed_alike_wherever_their_words_lie():
    shingler, draw = ngram_join.Shingler(), random.Random(6)
    words = ["".join(draw.choice("abcXYZé") for _ in range(draw.randrange(1, 30))) for _ in range(12_000)] + ["x" * 70_000, "Y" * 5000, "z"]
    got = shingler.words(np.frombuffer(" \n".join(words).encode(), dtype=np.uint8))
    alone = {w: shingler.words(np.frombuffer(w.encode(), dtype=np.uint8))[0] for w in words}
    assert [alone[w] for w in words] == got.tolist()
    assert len(set(alone.values())) == len({"".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words})


def test_two_sets_of_one_name(spark):
    x, y = np.array([1, 2], dtype=np.uint64), np.array([3, 4], dtype=np.uint64)
    (name, second), (_, other) = ngram_join.names(x), ngram_join.names(y)
    assert ngram_join.class_hash(x, {name: second}) == name
    assert ngram_join.class_hash(x, {name: other}) == second
    rows = [(1, 2, name, second, b"a"), (2, 2, name, other, b"b"), (3, 2, 7, 8, b"c")]
    sets = spark.createDataFrame(rows, "doc_id long, n_shingles long, cls long, second long, sketch binary")
    _, clashes = ngram_join.classes_of(sets)
    keeps = min(second, other)
    assert clashes == {name: keeps}
    got = {r.doc_id: r.cls for r in ngram_join.renamed(sets, clashes).collect()}
    assert got == {1: name if second == keeps else second, 2: name if other == keeps else other, 3: 7}
