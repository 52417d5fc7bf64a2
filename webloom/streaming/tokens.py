"""Tokens of snapshots as they arrive: stateless, row by row, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokenize import tokenize_snapshots
from ..sources.snapshots import stream_snapshots


def stream_tokens(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return tokenize_snapshots(stream_snapshots(spark, path, format))


def write_stream(tokens: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to Parquet; with ``once`` it ends when all files there are have been read."""
    writer = tokens.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
