"""Connected components of a graph of ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id that isn't the least of its component, from edges ``u, v``.

    Each round links every id to the least id among its neighbours, once among the greater
    and once among the smaller ones; rounds are logarithmic in the component's diameter, use
    aggregates with map-side combining only (so hubs do no harm), and cut their lineage with
    a reliable checkpoint. Null ids, loops and repeated edges count for nothing."""
    edges = edges.toDF("a", "b").where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = checkpointed(edges.distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select("v", "m")).distinct()
        edges = checkpointed(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
