"""Where snapshots and texts come from: JSON lines, Parquet, cached lines, pages, streams."""

from __future__ import annotations

import os
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "source_index long, displayed_url string, dom_snapshot string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, on whatever file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def in_split(spark: SparkSession, path: str, split: str | None) -> str:
    """The folder of a named split, where the data set has such folders."""
    folder = f"{path.rstrip('/')}/split={split}"
    return folder if split and exists(spark, folder) else path


def read_snapshots(spark: SparkSession, path: str, format: str = "json", split: str | None = "train") -> DataFrame:
    """Rows of a data set; a snapshot that is an object is kept as its JSON text, so that
    the schema is known beforehand and nothing is inferred."""
    rows = spark.read.format(format)
    if format == "json":
        rows = rows.schema(ROW)
    return rows.load(in_split(spark, path, split))


def read_lines(spark: SparkSession, path: str, column: str = "dom_snapshot") -> DataFrame:
    """One serialized snapshot a line, white space at the end taken off."""
    return spark.read.text(path).select(F.regexp_replace("value", r"[\s\p{Z}]+$", "").alias(column))


def stream_snapshots(spark: SparkSession, path: str, format: str = "json", files: int = 100) -> DataFrame:
    """The same rows from files as they arrive."""
    return spark.readStream.schema(ROW).format(format).option("maxFilesPerTrigger", files).load(path)


def cache_filename(dataset: str, split: str | None = None, folder: str = "") -> str:
    """Name of a data set's cache: a hash of its place (made absolute if local) and split."""
    if os.path.exists(dataset):
        dataset = os.path.realpath(dataset)
    return os.path.join(os.path.expanduser(folder), sha256(f"{dataset}\0{split or ''}".encode()).hexdigest() + ".jsonl")


def cached_lines(spark: SparkSession, dataset: str, folder: str, split: str | None = None, format: str = "json") -> DataFrame:
    """A data set's serialized snapshots by way of a cache of lines, made on first use, and
    again if it wasn't finished."""
    name = cache_filename(dataset, split, folder)
    if not exists(spark, f"{name}/_SUCCESS"):
        read_snapshots(spark, dataset, format, split).select(F.col("dom_snapshot").alias("value")).write.mode("overwrite").text(name)
    return read_lines(spark, name)
