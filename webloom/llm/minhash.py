"""Near duplicates by b-bit MinHash.

Words are lower-cased runs of letters and digits; a document is its set of three-word
shingles (all its words, if there are fewer). Of ``PERMUTATIONS`` minima the full values make
the bands' keys; after that only the lowest ``BITS`` bits of each are kept, packed into
64-bit words. Two documents that share a band are compared by xor and bit counts on packed
words: of agreeing places, a share ``2**-BITS`` agrees by accident, so the similarity is
``(agreeing - c) / (1 - c)`` with that ``c``.

Documents with the same minima are one node. In each band's bucket every node is compared
with the bucket's least; what isn't in one component after that is compared pairwise, so no
candidate pair that could join two groups is left out, and a bucket of thousands of copies
costs a comparison for each, not for each pair. Those pairs are never written: a bucket is cut
into cells of about ``CELL`` nodes, each held against the whole bucket with the packed words
at hand, and only pairs that are near leave the task.

Defined results: a null text, an empty one and one without words is like nothing; a null
``doc_id`` is never grouped and always stays; rows of the same ``doc_id`` are one document,
of which one row stays (the first by text, then by the whole row); ties go to the least
``doc_id``; other columns are untouched, whatever their names; very long texts take linear
time; empty tables give no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import checkpointed, dropped, fresh, id_type, joined_small, written
from .components import components
from .words import digests

PERMUTATIONS, ROWS, BITS, SHINGLE, THRESHOLD = 256, 4, 2, 3, 0.4
#: So many ids at most are broadcast to take dropped documents out.
BROADCAST_IDS = 1_000_000
#: Nodes of a bucket that one task holds against all of its bucket, about.
CELL = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    words = _mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (words[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (words[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)


A, B = _coefficients()


def shingles(words: np.ndarray) -> np.ndarray:
    """32-bit hashes of the runs of ``SHINGLE`` words, given the words' 64-bit hashes."""
    width = min(SHINGLE, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)]
    return np.unique((_mixed(out) >> np.uint64(32)).astype(np.uint32))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 512):
        block = np.multiply.outer(hashes[at : at + 512], A)
        block += B
        np.minimum(out, block.min(axis=0), out=out)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest ``BITS`` bits of each minimum, ``64 // BITS`` to a word."""
    per = 64 // BITS
    words = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(words, axis=1).view(np.int64)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, same, words, bands``: a digest of all minima, the packed low bits, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.arange(PERMUTATIONS // ROWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            ids, same, words, bands = [], [], [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = digests.of(value)[:, 0].astype(np.uint64)
                if not len(found):
                    continue
                m = minima(shingles(found))
                rows = m.reshape(-1, ROWS).astype(np.uint64)
                key = seeds.copy()
                for i in range(ROWS):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
                ids.append(doc_id)
                same.append(int.from_bytes(hashlib.blake2b(m.tobytes(), digest_size=8).digest(), "big", signed=True))
                words.append(packed(m))
                bands.append(key.view(np.int64))
            lists = lambda rows, n: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(same, pa.int64()), lists(words, PERMUTATIONS * BITS // 64), lists(bands, PERMUTATIONS // ROWS)],
                ["doc_id", "same", "words", "bands"],
            )

    rows = docs.selectExpr("doc_id", f"cast(`{text}` as string) text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, same long, words array<long>, bands array<long>")


def similarity(a: str, b: str) -> Column:
    """Collision-corrected estimate from two columns of packed words."""
    ones = sum(1 << i for i in range(0, 64, BITS))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differ = F.lit(0)
    for i in range(PERMUTATIONS * BITS // 64):
        xor = F.get(a, i).bitwiseXOR(F.get(b, i))
        any_ = xor
        for shift in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(xor, shift))
        differ = differ + F.bit_count(any_.bitwiseAND(F.lit(ones)))
    c = 2.0**-BITS
    return ((1 - differ / F.lit(float(PERMUTATIONS))) - c) / (1 - c)


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``u, v, near`` for every pair."""
    words = nodes.select("doc_id", "words")
    return (
        pairs.join(words.toDF("u", "x"), "u")
        .join(words.toDF("v", "y"), "v")
        .select("u", "v", (similarity("x", "y") >= threshold).alias("near"))
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``doc_id_a, doc_id_b, similarity``: for every document that has an earlier one in its
    group the group's least ``doc_id`` (which stays), its own, and the two's estimate, which
    is below the threshold where they are linked through others only."""
    stage = written(signatures(docs, text), "minhash-signatures")
    same = stage.groupBy("same").agg(F.min("doc_id").alias("node"))
    members = checkpointed(stage.select("doc_id", "same").join(same, "same").select("doc_id", "node"))
    nodes = stage.join(same.toDF("s", "node"), (F.col("same") == F.col("s")) & (F.col("doc_id") == F.col("node")), "left_semi")
    nodes = written(nodes.select("doc_id", "words", "bands"), "minhash-nodes")
    keyed = nodes.select("doc_id", F.explode("bands").alias("key"))
    bucket = W.partitionBy("key")
    shared = keyed.withColumn("least", F.min("doc_id").over(bucket)).withColumn("most", F.max("doc_id").over(bucket)).where("least != most").drop("most")
    shared = written(shared, "minhash-buckets")
    stars = written(_verified(shared.where("doc_id != least").select(F.col("doc_id").alias("u"), F.col("least").alias("v")).distinct(), nodes, threshold), "minhash-stars")
    first = components(stars.where("near").select("u", "v"))
    # pairs within a bucket that the stars have not put into one component
    root = F.coalesce("root", "doc_id")
    placed = shared.select("key", "doc_id").join(first, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", root.alias("root"))
    mixed = placed.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket)).withColumn("n", F.count(F.lit(1)).over(bucket)).where("low != high")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    mixed = written(mixed.select("key", "doc_id", "root", cells.alias("cells")).join(nodes.select("doc_id", "words"), "doc_id"), "minhash-mixed")
    a = mixed.select("key", F.pmod(F.xxhash64("doc_id"), "cells").cast("int").alias("cell"), F.col("doc_id").alias("u"), F.col("root").alias("ru"), F.col("words").alias("x"))
    b = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("doc_id").alias("v"), F.col("root").alias("rv"), F.col("words").alias("y"))
    more = a.join(b, ["key", "cell"]).where((F.col("ru") < F.col("rv")) & (similarity("x", "y") >= threshold)).select("u", "v").distinct()
    copies = members.where("doc_id != node").select("doc_id", "node")
    groups = components(first.union(more).union(copies)).toDF("doc_id", "kept")
    words = stage.select("doc_id", "words").dropDuplicates(["doc_id"])
    out = (
        groups.join(words.toDF("doc_id", "x"), "doc_id")
        .join(words.toDF("kept", "y"), "kept")
        .select(F.col("kept").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), similarity("x", "y").alias("similarity"))
    )
    out = checkpointed(out)
    dropped(docs.sparkSession, stage, nodes, shared, stars, mixed)
    return out


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one document of each group."""
    gone = near_duplicates(docs, threshold, text).select(F.col("doc_id_b").alias("gone"))
    key, row = fresh(docs, "gone", "row")
    kept = joined_small(docs, gone.toDF(key), docs["doc_id"] == F.col(key), "left_anti", BROADCAST_IDS)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(key))
    repeated = checkpointed(repeated)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"] == F.col(key), "left_anti")
    twice = kept.join(repeated, kept["doc_id"] == F.col(key), "left_semi")
    order = [F.col(f"`{text}`"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))]
    first = twice.withColumn(row, F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where(f"{row} = 1").drop(row)
    return once.unionByName(first)
