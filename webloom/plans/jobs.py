"""Whole jobs: dump, diff, breaking inputs, profile, training."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.diff import diff
from ..operators.tokenize import tokenize_snapshots
from ..operators.vocabulary import DEFAULT_SIZE, encode, train


def dump(df: DataFrame, vocabulary: Iterable[str], lower: bool = True) -> DataFrame:
    """``source_index, dom_snapshot, tokenized``, shortest serialized snapshot first, then by
    number. Rows that can't be tokenized fail the job, as they do one by one."""
    rows = tokenize_snapshots(df.select("source_index", "dom_snapshot"))
    rows = rows.withColumn("tokens", F.when(F.col("error").isNull(), F.col("tokens")).otherwise(F.raise_error("error")))
    made = encode(rows, vocabulary, lower=lower)
    return made.orderBy(F.char_length("dom_snapshot"), "source_index").select("source_index", "dom_snapshot", "tokenized")


def dump_order(df: DataFrame, text: str, key: str) -> DataFrame:
    """``df`` with ``place``, each row's place in a dump: how many are shorter, and its rank
    among those as long, so that no task has to sort the whole table. Only the histogram of
    lengths, which is short, is summed in one place."""
    sized = df.withColumn("dump_length", F.char_length(text))
    shorter = sized.groupBy("dump_length").agg(F.count(F.lit(1)).alias("n"))
    shorter = shorter.select(F.col("dump_length").alias("as_long"), (F.sum("n").over(W.orderBy(F.col("dump_length").asc_nulls_last())) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("dump_length").orderBy(key))
    return sized.withColumn("rank", rank).join(shorter, F.col("dump_length").eqNullSafe(F.col("as_long"))).withColumn("place", F.col("rank") + F.col("before")).drop("dump_length", "as_long", "before", "rank")


def compare(dumped: DataFrame, vocabulary: Iterable[str], lower: bool = True) -> DataFrame:
    """Changes between saved tokenizations and those by another vocabulary."""
    rows = tokenize_snapshots(dumped)
    made = encode(rows.withColumnRenamed("tokenized", "saved"), vocabulary, lower=lower)
    return diff(made.withColumnRenamed("tokenized", "new"), "saved", "new")


def breaking(df: DataFrame) -> DataFrame:
    """The rows that can't be tokenized, as they were."""
    return tokenize_snapshots(df).where("error is not null").select(*(f"`{c}`" for c in df.columns))


def breaking_message(n: int) -> str:
    return f"Got {n} breaking input{'' if n == 1 else 's'}"


def corpus_size(df: DataFrame) -> int | None:
    """How many examples there are; None for a stream."""
    return None if df.isStreaming else df.count()


def corpus_message(size: int, examples: int | None) -> str:
    many = f"{examples:,}" if examples else "an unknown number of"
    return f"Generating up to {size:,} tokens from {many} examples:"


def profile(df: DataFrame, tokens: str = "tokens", text: str = "dom_snapshot") -> DataFrame:
    """``characters, pre_tokens, characters_per_token`` of each row; null for no tokens."""
    n = F.size(tokens).cast("long")
    return df.select("*", F.char_length(text).cast("long").alias("characters"), n.alias("pre_tokens")).withColumn("characters_per_token", F.when(F.col("pre_tokens") > 0, F.col("characters") / F.col("pre_tokens")))


def profile_line(number: int, characters: int, tokens: int, seconds: float) -> str:
    ratio = f"{characters / tokens:4.1f}" if tokens else "   -"
    return f"example {number:3}: {characters:7} bytes -> {tokens:7} pre-tokens; {ratio} bytes/pre-token in {seconds * 1e3:9.3f} ms"


def profile_total(profiled: DataFrame) -> DataFrame:
    """One row: examples, characters, tokens, and characters per token; 0 examples for none."""
    total = profiled.agg(F.count(F.lit(1)).alias("examples"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"), F.coalesce(F.sum("pre_tokens"), F.lit(0)).alias("pre_tokens"))
    return total.withColumn("characters_per_token", F.when(F.col("pre_tokens") > 0, F.col("characters") / F.col("pre_tokens")))


def train_vocabulary(df: DataFrame, size: int = DEFAULT_SIZE, lower: bool = True) -> list[str]:
    rows = tokenize_snapshots(df)
    return train(rows.where("error is null"), size, lower=lower)
