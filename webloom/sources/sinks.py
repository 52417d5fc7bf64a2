"""Where results go."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What saved tokenizers are called by default.
PREFIX = "webloom-tokens-"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``; a local
    temporary one only where that is unset and there is no cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def compact_json(*columns: str | Column) -> Column:
    """One compact JSON object of the columns."""
    return F.to_json(F.struct(*columns))


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_if_any(df: DataFrame, path: str) -> int:
    """Writes Parquet only if there are rows; returns their number. They are made once."""
    kept = df.persist()
    try:
        n = kept.count()
        if n:
            kept.write.parquet(path)
    finally:
        kept.unpersist()
    return n


class LinesOut:
    """A local file of JSON lines that the driver writes, one object a call. It isn't made
    before there is something to write. The name is given, or made of a stem and, if asked
    for, the time."""

    def __init__(self, path: str | None = None, stem: str = "out", stamped: bool = False, suffix: str = ".jsonl", append: bool = True):
        self.path = path or stem + (datetime.now().strftime("-%Y%m%d%H%M%S%f") if stamped else "") + suffix
        self._how, self._out = "a" if append else "w", None

    def add(self, row: dict) -> None:
        self._out = self._out or open(self.path, self._how)
        print(json.dumps(row, separators=(",", ":")), file=self._out)

    def __enter__(self) -> LinesOut:
        return self

    def __exit__(self, *_) -> None:
        if self._out:
            self._out.close()
            self._out = None


def save_directory(size: int, prefix: str = PREFIX) -> str:
    """The working folder if it has the vocabulary's name, else a folder of that name in it."""
    name, here = pretty_name(size, prefix), os.getcwd()
    return here if os.path.basename(here) == name else os.path.join(here, name)


def pretty_name(size: int, prefix: str = PREFIX) -> str:
    return prefix + rounded(size)


def rounded(value: int) -> str:
    """314159 as 314k."""
    thousands = (len(str(int(value))) - 1) // 3
    return f"{round(value / 1000**thousands)}{['', *'kMBTQ'][thousands]}"
