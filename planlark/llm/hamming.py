"""Exact top-k search over 64-bit binary codes by incremental multi-index hashing.

A vector's code holds the sign of each component. Codes are cut into four 16-bit segments, and each segment is an index
from its value to the codes that have it. A search probes every segment value within radius r of the query's, verifies
the full Hamming distance, and raises r until the k-th verified distance is provably covered: a code nearer than
4 * (r + 1) has a segment within r (pigeonhole), so it has been seen. Only unfinished queries go on.

Skew: equal codes are one index entry that carries its k + 1 smallest ids (no answer needs more), picked with a limit
before the shuffle, so a third of all rows with one vector is one entry. A candidate is kept only in the first segment
of least distance, so no distinct is needed over segments or radii.

Cases: a null vector has no code and is neither found nor answered; null or NaN components count as not positive;
ties go to the smaller id; a query does not find itself; ids are taken as they are, and repeated rows with one id are
one row; more than 64 components are an error; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlark.llm.common import written

SEGMENTS, BITS = 4, 16


def sign_code(vector: str) -> Column:
    """Bit i is 1 where component i is positive."""
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    folded = F.aggregate(F.transform(vector, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > 64, F.raise_error(F.lit("more than 64 components"))).when(F.col(vector).isNotNull(), folded)


def segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, BITS * s).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def first_by(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def topk(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows, queries: (id, code). Returns (query_id, rank, id, distance): the k nearest other rows of each query."""
    need = k + 1
    ids = first_by(rows.dropna().distinct(), "code", ["id"], need).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    codes = written(ids, "codes")
    parts = F.array(*[F.struct(F.lit(s).alias("seg"), segment(F.col("code"), s).alias("val")) for s in range(SEGMENTS)])
    index = written(codes.select("code", F.inline(parts)), "segments")
    asked = written(queries.dropna().distinct(), "queries")
    active = asked.select(F.col("code").alias("q")).distinct()
    best = rows.sparkSession.createDataFrame([], "q long, code long, distance int, id long")
    finished = best
    for r in range(BITS + 1):
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda m: F.bit_count(m) == r)  # folded to a constant
        probes = active.select("q", F.inline(F.array(*[F.struct(F.lit(s).alias("seg"), segment(F.col("q"), s).alias("own")) for s in range(SEGMENTS)])))
        probes = probes.select("q", "seg", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("own")))).alias("val"))
        far = [F.bit_count(segment(F.col("q"), s).bitwiseXOR(segment(F.col("code"), s))) for s in range(SEGMENTS)]
        first = F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1
        met = probes.join(index.hint("merge"), ["seg", "val"]).filter((F.array_min(F.array(*far)) == r) & (first == F.col("seg")))
        near = met.select("q", "code", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"))
        fresh = near.join(codes.hint("merge"), "code").select("q", "code", "distance", F.explode("ids").alias("id"))
        best = written(first_by(best.unionByName(fresh), "q", ["distance", "id"], need).drop("rank"), "best")
        covered = SEGMENTS * (r + 1) - 1
        state = active.join(best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("worst")), "q", "left")
        done = F.coalesce((F.col("n") >= need) & (F.col("worst") <= covered), F.lit(False)) | F.lit(r == BITS)
        state = written(state.select("q", done.alias("done")), "state")
        finished = finished.unionByName(best.join(state.filter("done"), "q", "left_semi"))
        active = state.filter("NOT done").select("q")
        best = best.join(active, "q", "left_semi")
        if active.isEmpty():
            break
    pairs = asked.withColumnsRenamed({"id": "query_id", "code": "q"}).join(finished, "q").filter(F.col("query_id") != F.col("id"))
    return first_by(pairs, "query_id", ["distance", "id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")


def op5_topk(spark: SparkSession, embeddings: DataFrame, k: int = 10) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), sign_code("embedding").alias("code"))
    return topk(rows, rows.filter(F.col("id") % 100 == 0), k).withColumnRenamed("id", "vec_id")
