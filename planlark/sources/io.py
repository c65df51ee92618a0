"""Sources and sinks: tables, rule files, prices, gold cases, content-addressed and append-only stores, exports."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.functions.checks import checked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns are pushed into the scan. S1."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule files, one JSON document each, under one strict schema; a malformed file fails the read. S2."""
    schema = "rule_id string, version string, product_type string, variant string, check_type string, severity string, operation string, inputs map<string,string>, on_missing string, on_ambiguous string"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_prices(path: str) -> dict[str, tuple[str, str]]:
    """A price file on the driver: {model: [input, output]} per 1000 tokens, decimals written as strings only. S3."""
    raw = json.loads(Path(path).read_text())
    for model, pair in raw.items():
        if len(pair) != 2 or not all(isinstance(x, str) and re.fullmatch(r"\d+(\.\d+)?", x) for x in pair):
            raise ValueError(f"rates of {model} must be two decimals written as strings")
    return {m: (a, b) for m, (a, b) in raw.items()}


def price_frame(spark: SparkSession, prices: dict[str, tuple[str, str]]) -> DataFrame:
    rows = [(m, a, b) for m, (a, b) in sorted(prices.items())]
    return spark.createDataFrame(rows, "model string, i string, o string").select("model", F.col("i").cast("decimal(12,6)").alias("input_per_1k"), F.col("o").cast("decimal(12,6)").alias("output_per_1k"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S4."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S5."""
    return spark.read.schema(schema).json(path)


def checked_cases(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Gold cases (case_id, path, content_hash) whose files (path, content) still have their bytes; others raise. S6."""
    found = cases.join(files.select("path", F.sha2("content", 256).alias("__sha")), "path", "left")
    same = F.coalesce(F.col("content_hash") == F.concat(F.lit("sha256:"), F.col("__sha")), F.lit(False))
    return found.filter(checked(F.lit(True), same, "a case's file has changed")).drop("__sha")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def unpacked(parts: DataFrame, most_files: int = 40, most_bytes: int = 300_000_000, most_total: int = 600_000_000) -> DataFrame:
    """Parts (portfolio, position, name, bytes) of portfolios with a refusal each. S7."""
    from pyspark.sql import Window

    w = Window.partitionBy("portfolio").orderBy("position")
    refusal = F.when(F.row_number().over(w) > most_files, "too_many").when(F.col("bytes") > most_bytes, "too_large").when(F.sum("bytes").over(w) > most_total, "total_too_large").when(F.col("bytes") == 0, "empty")
    return parts.withColumn("refusal", refusal)


def content_key(content: Column) -> Column:
    """Two levels of folders from the SHA-256. S8, S9."""
    sha = F.sha2(content, 256)
    return F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)


def put_once(df: DataFrame, path: str) -> None:
    """Write-once: an existing target is an error. S8."""
    df.write.mode("errorifexists").parquet(path)


def append_only(df: DataFrame, path: str) -> None:
    """S10, S12."""
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Every cell as text, and no cell that a sheet would run as a formula. S11."""
    safe = lambda c: F.when(F.col(c).cast("string").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    df.select(*map(safe, df.columns)).write.mode("errorifexists").option("header", True).csv(path)


def audit_rows(df: DataFrame, category: str, actor: Column, target: Column) -> DataFrame:
    """S12."""
    return df.select(F.lit(category).alias("category"), actor.alias("actor"), target.alias("target"), F.current_timestamp().alias("at"))


def write_scorecard(df: DataFrame, path: str, version: str) -> None:
    """An immutable version. S13."""
    df.write.mode("errorifexists").json(f"{path}/version={version}")
