"""Exact dedup over a persistent digest index.

The index is a Parquet table at a path, bucketed and sorted by digest: one row per distinct text that was kept. New
documents are reduced to digests, grouped (map-side combine absorbs any number of copies), joined to the index by a
sort-merge anti join on the bucketing key, and the digests that are new are appended. Everything is JVM-side.

Skew: a group of copies may hold a third of all rows. Groups are counted with partial aggregation; the rows of the
largest groups (at least one row in HOT_SHARE, so HOT_SHARE groups at most) learn their keeper from a broadcast of at
most HOT_SHARE rows, all others by a sort-merge join.

Cases: a null text is empty; a null doc_id never wins against one that is set; repeated rows (same id, same text) are
reported once per row with the same answer; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm.common import join_groups, lower_ascii, work_path, written


class DigestIndex:
    """Digests of kept texts at ``path``, in ``buckets`` buckets, each sorted by digest."""

    SCHEMA = "text_sha256 string, keep_id long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + path.rstrip("/").rpartition("/")[2].replace("-", "_").replace(".", "_")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """Each bucket gets one file: the rows are dealt by the hash that also numbers the buckets."""
        view = f"{self.name}_new"
        new.select("text_sha256", "keep_id").repartition(self.buckets, "text_sha256").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT INTO {self.name} SELECT text_sha256, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; the index then holds the new digests.

    A text that the index already has keeps the earlier keeper; among new rows the largest id stays.
    """
    digests = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(lower_ascii(text_col).cast("binary"), 256).alias("text_sha256")),
        "digests",
    )
    groups = written(digests.groupBy("text_sha256").agg(F.max("doc_id").alias("new_id"), F.count("*").alias("group_size")), "digest_groups")
    known = index.rows().withColumnRenamed("keep_id", "old_id")
    fresh = groups.hint("merge").join(known, "text_sha256", "left_anti")
    # what was known is read before the append, so the keeper of a known text is the earlier one
    keepers = written(
        groups.hint("merge").join(known, "text_sha256", "left").select("text_sha256", "group_size", F.coalesce("old_id", "new_id").alias("keep_id")),
        "digest_keepers",
    )
    index.append(fresh.select("text_sha256", F.col("new_id").alias("keep_id")))
    rows = join_groups(digests, keepers, "text_sha256", "group_size")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, docs: DataFrame, buckets: int = 64) -> DataFrame:
    return dedup(docs, DigestIndex(spark, work_path(spark, "digest_index"), buckets))
