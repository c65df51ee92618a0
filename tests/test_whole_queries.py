"""Queries over whole tables: no row of the input is left out."""

import random
import re

from pyspark.sql import functions as F

from planlark import plans
from planlark.operators import retrieval

SF = "/root/testdata/sf0.001"


def test_every_part_has_its_applicability(spark):
    got = {r.p_partkey: (r.applies, r.abstains) for r in plans.QUERIES["variant_applicability"](spark, SF).collect()}
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    assert set(got) == {r.p_partkey for r in parts}
    unknown = [r for r in parts if r.p_partkey % 17 == 0]
    assert {got[r.p_partkey] for r in unknown if r.p_type == "MEDIUM"} == {("R-M", None)}
    assert {got[r.p_partkey] for r in unknown if r.p_type in ("SMALL", "LARGE")} == {(None, "REVIEW_REQUIRED")}


def test_customers_and_suppliers_of_any_key_meet(spark, tmp_path):
    spark.range(0, 200).selectExpr("id * 50 AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(0, 9000).selectExpr("id AS c_custkey").union(spark.sql("SELECT 50L")).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.left_id: (r.lane, r.n, r.state) for r in plans.QUERIES["identifier_match"](spark, str(tmp_path)).collect()}
    want = {}
    for i in range(0, 10_000, 50):
        k, lane = (i + 5, "alias") if i % 3 == 0 else (i, "exact")
        n = (k < 9000) + (k == 50)
        want[i] = (lane if n else None, n, ("UNMATCHED", "MATCHED", "AMBIGUOUS")[n])
    assert got == want


def test_whole_items_are_asked_and_covers_ranked(spark, tmp_path):
    draw = random.Random(6)
    items = [(1, "a b c d e"), (2, "a, b; c and D"), (3, "a b c x")]
    docs = [(i, " ".join(draw.choice("abcdefgx") for _ in range(draw.randrange(3, 40))) + draw.choice([" and", ""])) for i in range(60)] + [(60, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.query_id, r.doc_id): r.cover for r in plans.QUERIES["lexical_documents"](spark, str(tmp_path)).collect()}
    want = {}
    for q, text in items:
        asked = set(re.findall(r"\w+", text.lower()))
        for i, doc in docs:
            w = re.findall(r"\w+", (doc or "").lower())
            whole = [(a, b) for a in range(len(w)) for b in range(a, len(w)) if asked <= set(w[a : b + 1])]
            least = [(a, b) for a, b in whole if (a + 1, b) not in whole and (a, b - 1) not in whole]
            if least:
                r = sum(1 / (b - a + 1) for a, b in least)
                want[q, i] = round(r / (r + 1), 6)
    assert len(want) > 20 and got == want
    one = spark.createDataFrame([(docs[0][1] + " a b c x",)], "text string").select(F.round(retrieval.cover_density(F.col("text"), F.array(*map(F.lit, "abcx"))), 6).alias("r"), retrieval.words_of(F.col("text")).alias("words"))
    row = one.select(F.lit(1).alias("query_id"), F.lit(1).alias("doc_id"), F.lit(0.0).alias("score"), "words", F.array(*map(F.lit, "abcx")).alias("terms"))
    assert retrieval.cover_ranks(row).first().cover == one.first().r
