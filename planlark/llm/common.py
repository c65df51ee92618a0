"""What the corpus operators share: reading tables, the shared work folder, tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    The setting is read from the session. Only a local session (tests) gets a folder of its own when it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="planlark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What an Arrow batch holds at most, in rows and bytes: a Python worker has a few batches of texts in memory at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches; smaller bounds that it already has are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if not now or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


#: A group is hot when it has at least 1 / HOT_SHARE of all rows; there can be no more than HOT_SHARE such groups.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with one row per group, where one group may hold a third of all rows.

    ``size`` is the groups' column with their number of rows. Hot groups (at most HOT_SHARE) are broadcast, so their
    rows stay where they are; all others meet in a sort-merge join.
    """
    least = F.greatest(F.lit(2), F.lit(rows.count() // HOT_SHARE))
    hot, lone = groups.filter(F.col(size) >= least), groups.filter(F.col(size) < least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(lone.hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def lower_ascii(text: str | Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put_file(path: str, data: bytes) -> None:
    """Write a file whole or not at all, so that a repeated task leaves the same file."""
    fs, at = file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


def get_file(path: str) -> bytes:
    fs, at = file_system(path)
    with fs.open_input_stream(at) as data:
        return data.read()


def move_file(old: str, new: str) -> None:
    """Rename a file; a repeated task finds it renamed already."""
    fs, at = file_system(old)
    to = file_system(new)[1]
    if fs.get_file_info(at).type == pafs.FileType.NotFound and fs.get_file_info(to).type == pafs.FileType.File:
        return
    fs.move(at, to)


def batches_of(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    return (x or "" for x in batch.column(name).to_pylist())
