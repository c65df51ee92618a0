"""A corpus from raw documents: toxic ones out, one of each text, one of each group of near copies, mixed, encoded.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of docs.

Cases: null texts are empty texts; an empty table passes every stage; columns beyond those of documents are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm import bpe_chunks, exact_dedup, mixing, ngram_join, toxicity
from planlark.llm.common import lower_ascii, table, work_path
from planlark.llm.queries import tokenizer_path

#: Mixing flattens the shares of language and quality by this power.
POWER = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score below 1/2 stay."""
    lexicon = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), 20_000))
    return toxicity.kept_rows(docs, lexicon)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the row with the largest doc_id stays, once."""
    found = exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, work_path(spark, "digest_index"), 32))
    keep = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    marked = docs.withColumn("__text_sha", F.sha2(lower_ascii("text").cast("binary"), 256))
    stay = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha")), "left_semi")
    return stay.dropDuplicates(["doc_id", "__text_sha"]).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, Jaccard 3/4 or more) the one with the smallest doc_id stays."""
    groups = ngram_join.near_duplicates(docs)
    gone = groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__id"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small domains are repeated until the expected shares match the tempered ones; no document goes."""
    labels = table(spark, sf_dir, "labels")
    members, names = mixing.soft_members(docs, mixing.labelled_domains(docs, labels, 20_000))
    totals = mixing.expected_totals(members, len(names))
    weights = mixing.tempered(totals, POWER)
    scale = max((t / w for t, w in zip(totals, weights, strict=True) if w > 1e-9), default=0.0)
    rates, _ = mixing.fit_rates(members, list(weights * scale), floor=1.0)
    times = rates.groupBy("doc_id").agg(F.max(mixing.copies(F.col("rate"), F.col("doc_id"))).alias("__times")).withColumnRenamed("doc_id", "__id")
    both = docs.join(times.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("__times", F.lit(1))))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids of each row, and the text that they decode to."""
    rows = bpe_chunks.encoded(docs, tokenizer_path("word_bpe_49k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Learned models and iterative fits are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None
