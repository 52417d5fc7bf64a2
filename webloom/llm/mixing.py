"""Mixing sources to target weights by repetition and hash-seeded Bernoulli copies.

Tokens of a published vocabulary (or what a column says) are counted exactly, per source and over
all documents, and added up where they are counted; a source's rate is its share of the target
divided by its share of the tokens. A document comes out ``floor(rate)`` times, and once more
if a hash of the seed and its ``doc_id`` falls below the fraction: the expected tokens per
source are in the target's proportion, and any rerun gives the same rows.

Defined results: a null source is a source of its own; a source without tokens (null or empty
texts only), or which ``weights`` doesn't name, has rate 0 and goes; null and empty texts of
other sources are repeated like any document; repeated rows (same ``doc_id``) share their
fate; a null ``doc_id`` hashes as the empty string; very long texts count whole; an empty table stays
empty. Output
columns ``copy`` and ``copies`` replace input columns of these names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import DEFAULT_VOCABULARY, fresh, small_or_none, vocabulary_bytes
from .token_counts import total_of

SEED = 20
#: So many rates at most are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def token_sums(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, source: str = "source", text: str = "text") -> DataFrame:
    """``source, tokens`` by exact encoding."""
    data = vocabulary_bytes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = total_of(data)
        for batch in batches:
            sums: Counter = Counter()
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[name] += sum(cache.parts(value)) if value else 0
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["source", "tokens"])

    counted = docs.select(F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")).mapInArrow(run, "source string, tokens long")
    return counted.groupBy("source").agg(F.sum("tokens").alias("tokens"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, tokens: Column | None = None, total: float | None = None, source: str = "source", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``source, tokens, rate``; ``tokens`` is each document's number where that is known. Without ``weights`` all sources that have tokens weigh alike;
    without ``total`` the target is as many tokens as the weighted sources have."""
    if tokens is None:
        sums = token_sums(docs, vocabulary, source, text)
    else:
        sums = docs.select(F.col(source).cast("string").alias("source"), tokens.alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    sums = sums.where("tokens > 0")
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.coalesce(*(F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()), F.lit(0.0))
    sums = sums.withColumn("weight", weight).where("weight > 0")
    whole = sums.agg(F.sum("weight").alias("w"), F.sum("tokens").cast("double").alias("t"))
    target = F.col("t") if total is None else F.lit(float(total))
    return sums.crossJoin(F.broadcast(whole)).select("source", "tokens", (F.col("weight") / F.col("w") * target / F.col("tokens").cast("double")).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = SEED,
    tokens: Column | None = None,
    total: float | None = None,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """All columns of ``docs`` and ``copy`` (from 1) of ``copies``."""
    rates = source_rates(docs, weights, tokens, total, source, text, vocabulary)
    few = small_or_none(rates, BROADCAST_SOURCES)
    if few is not None:
        rates = F.broadcast(docs.sparkSession.createDataFrame(few, T.StructType(rates.schema.fields)))
    docs = docs.drop("copy", "copies")
    key, tokens_, rate = fresh(docs, "mix_source", "mix_tokens", "mix_rate")
    rates = rates.toDF(key, tokens_, rate)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    copies = (F.floor(rate) + F.when(u < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")
    return (
        docs.join(rates, docs[source].cast("string").eqNullSafe(F.col(key)))
        .withColumn("copies", copies)
        .where("copies > 0")
        .select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "copies")
    )


def mixed_by_words(docs: DataFrame) -> DataFrame:
    """The mix where a token is a run of characters other than white space, which SQL can count."""
    return mix_sources(docs, tokens=word_count(F.col("text")))


MIX_SQL = f"""
WITH c AS (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM c GROUP BY source HAVING sum(tokens) > 0),
w AS (SELECT count(*)::DOUBLE AS w, sum(tokens)::DOUBLE AS t FROM s),
r AS (SELECT source, 1::DOUBLE / w * t / tokens::DOUBLE AS rate FROM s, w),
d AS (SELECT doc_id, text, lang, c.source, n_chars, rate, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source),
n AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy, copies FROM n WHERE copies > 0
"""
