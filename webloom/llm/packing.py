"""Packing documents into sequences of a fixed length as a cutting-stock problem.

Lengths are rounded up to size classes; the histogram of classes, which has a fixed size, is
all that the driver sees. A linear program over patterns (how many pieces of each class go
into one sequence) is solved by column generation: the duals of the pieces' rows price new
patterns by knapsack dynamic programming until none saves anything. The solution is rounded
down, what is left over is packed first-fit by decreasing size, and each pattern's sequences
take the next documents of each class in the order of a hash, by rank, without any search.

Defined results: a text longer than a sequence is cut into full sequences and a rest, which
are pieces of their own, however many; null and empty texts have no piece and no row; repeated rows are
pieces each; a null ``doc_id`` stays null; ties in rank are between pieces of equal id, number
and length, so either order gives the same rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import DEFAULT_VOCABULARY, id_type, joined_small, vocabulary_bytes, written
from .token_counts import total_of

CAPACITY, GRAIN, GAP = 2048, 16, 1e-5
#: Pieces that one rank task sorts, about.
RANK_ROWS = 1_000_000
#: Sizes of parts, of all classes, that are broadcast at most.
BROADCAST_PARTS = 100_000


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value within the capacity: an unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        best[room] = best[room - 1]
        if fits.any():
            worth = np.where(fits, best[np.maximum(room - sizes, 0)] + values, -1)
            k = int(worth.argmax())
            if worth[k] > best[room] + 1e-12:
                best[room], took[room] = worth[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), pattern


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in a fractional packing that is within
    ``GAP`` of the optimum or half a sequence of it, by the duals' bound."""
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    # slightly unlike demands keep degenerate bases from cycling
    demand = demand + 1e-5 * (1 + np.arange(len(sizes)) * 0.6180339887 % 1)
    use, bound = inverse @ demand, 0.0
    for step in range(1, 50 * len(sizes) + 1000):
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(duals, sizes, capacity)
        bound = max(bound, float(duals @ demand) / value)
        if value <= 1 + 1e-9 or use.sum() - bound <= max(0.5, GAP * bound):
            break
        move = inverse @ pattern
        ratio = np.full(len(sizes), np.inf)
        np.divide(use, move, out=ratio, where=move > 1e-9)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if step % 50 == 0:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        use = np.maximum(inverse @ demand, 0)
    return basis, use


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{class: pieces}`` and how many sequences have each; every piece has a place."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(k)] for k in sizes], dtype=np.int64)
    basis, use = fractional(sizes, demand.astype(float), capacity)
    found: Counter = Counter()
    left = demand.copy()
    for pattern, n in zip(np.rint(basis.T).astype(np.int64), np.floor(use + 1e-3).astype(np.int64)):
        n = int(min([n, *(left[pattern > 0] // pattern[pattern > 0])]))
        if n > 0:
            found[tuple(pattern.tolist())] += n
            left -= n * pattern
    rooms: list[list] = []
    for k in range(len(sizes) - 1, -1, -1):
        for room in rooms:
            fit = min(int(left[k]), int(room[0] // sizes[k]))
            room[0] -= fit * sizes[k]
            room[1][k] += fit
            left[k] -= fit
        while left[k]:
            fit = min(int(left[k]), int(capacity // sizes[k]))
            row = [0] * len(sizes)
            row[k] = fit
            rooms.append([capacity - fit * sizes[k], row])
            left[k] -= fit
    for _, row in rooms:
        found[tuple(row)] += 1
    return [({int(s): a for s, a in zip(sizes, row) if a}, n) for row, n in sorted(found.items(), reverse=True)]


def entries(patterns: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """``class, low, high, each, bin, place, unit``: pieces of a class ranked low to high go
    ``each`` at a time into sequences from ``bin`` on, from ``place`` and ``unit`` in it."""
    out, given, bin_ = [], Counter(), 0
    for pattern, n in patterns:
        place = unit = 0
        for size in sorted(pattern, reverse=True):
            each = pattern[size]
            out.append((size, given[size], given[size] + n * each, each, bin_, place, unit))
            given[size] += n * each
            place += each
            unit += each * size
        bin_ += n
    return out


def token_lengths(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` by exact encoding, one row for each document."""
    data = vocabulary_bytes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = total_of(data)
        for batch in batches:
            n = [sum(cache.parts(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.selectExpr("doc_id", f"cast(`{text}` as string) text").mapInArrow(run, f"doc_id {id_type(docs)}, n_tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, vocabulary: str = DEFAULT_VOCABULARY, lengths: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``doc_id, piece, n_tokens, bin, place, start``: ``piece`` (from 0) of a document stands
    ``place``-th in sequence ``bin``, from token ``start``, a multiple of ``grain``.
    ``lengths``: ``doc_id, n_tokens`` if known; else texts are encoded."""
    if capacity % grain:
        raise ValueError("the grain must divide the capacity")
    spark = docs.sparkSession
    lengths = written(token_lengths(docs, vocabulary, text) if lengths is None else lengths.select("doc_id", "n_tokens"), "pack-lengths")
    pieces = lengths.where("n_tokens > 0").select(
        "doc_id",
        F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"),
        F.col("n_tokens").alias("whole"),
        F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece"),
    ).withColumn("n_tokens", F.least(F.lit(capacity), F.col("whole") - F.col("piece").cast("long") * capacity)).drop("whole")
    pieces = pieces.withColumn("class", F.ceil(F.col("n_tokens") / grain).cast("int"))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = max(0, (max(histogram.values(), default=0) // RANK_ROWS).bit_length())
    pieces = pieces.withColumn("part", F.shiftright("h", 63 - bits).cast("int") if bits else F.lit(0))
    spark_entries = spark.createDataFrame(
        entries(plan(histogram, capacity // grain)),
        "class int, low long, high long, each long, bin long, first int, unit int",
    )
    # ranks over the whole class, from ranks in each part and the sizes of the parts before it
    rank = F.row_number().over(W.partitionBy("class", "part").orderBy("h", "doc_id", "piece", "n_tokens")).cast("long") - 1
    ranked = pieces.withColumn("rank", rank)
    if bits:
        sizes = pieces.groupBy(F.col("class").alias("of"), F.col("part").alias("in")).agg(F.count(F.lit(1)).alias("size"))
        before = F.sum("size").over(W.partitionBy("of").orderBy("in")) - F.col("size")
        sizes = written(sizes.select("of", "in", before.alias("before")), "pack-parts")
        ranked = joined_small(ranked, sizes, (F.col("class") == F.col("of")) & (F.col("part") == F.col("in")), "inner", BROADCAST_PARTS).withColumn("rank", F.col("rank") + F.col("before"))
    at, e = F.col("rank") - F.col("low"), F.col("each")
    return (
        ranked.join(F.broadcast(spark_entries), "class")
        .where("rank >= low and rank < high")
        .select(
            "doc_id",
            "piece",
            "n_tokens",
            (F.col("bin") + F.floor(at / e)).cast("long").alias("bin"),
            (F.col("first") + at % e).cast("int").alias("place"),
            ((F.col("unit") + at % e * F.col("class")) * grain).cast("int").alias("start"),
        )
    )
