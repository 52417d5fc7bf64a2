"""The queries of this subpackage, each an operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import ann, langid, line_dedup, minhash, mixing, packing, pii, simhash, token_counts, token_store

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


QUERIES: dict[str, Query] = {
    "op1_nearest_neighbours": over("embeddings", partial(ann.nearest_neighbours, queries=ann.DIVISIBLE)),
    "op2_language_id": over("documents", langid.identified),
    "op3_pseudonyms": over("documents", pii.pseudonymised),
    "op4_token_counts": over("documents", token_counts.prefix_token_counts),
    "op5_token_store": over("documents", token_store.token_store),
    "op6_line_dedup": over("documents", line_dedup.deduplicated),
    "op7_simhash": over("documents", simhash.simhash),
    "op8_mix_sources": over("documents", mixing.mix_sources),
    "mix_sources_by_words": over("documents", mixing.mixed_by_words),
    "op9_packing": over("documents", packing.pack),
    "op10_near_duplicates": over("documents", minhash.near_duplicates),
}

#: The others have no SQL: trained codebooks, keyed permutations, byte-pair merges, rolling
#: hashes, linear programs and graph components; tests hold them against brute force. The mix
#: has it where words are counted, and a test gives the same SQL the tokens.
ORACLES: dict[str, str] = {
    "op2_language_id": langid.LANGID_SQL,
    "op6_line_dedup": line_dedup.LINES_SQL,
    "op7_simhash": simhash.SIMHASH_SQL,
    "mix_sources_by_words": mixing.MIX_SQL,
}
