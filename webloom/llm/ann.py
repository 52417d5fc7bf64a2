"""Approximate nearest neighbours: inverted lists of product-quantised residuals.

Coarse centroids and the residuals' codebooks are trained by k-means on a bounded sample, the
``TRAIN`` rows of least hash. There are twice as many lists as the square root of the vectors'
number; as a bounded sample can't train more than ``TRAINED_LISTS``, centroids beyond that are
sums of such a one and one of a codebook of their residuals. Every vector goes to the list of its nearest centroid, with one
code for each of ``SUBSPACES`` parts of its residual. As a query it visits the lists of its
nearest centroids, as many as ``TARGET`` of the true neighbours of ``QUERIES`` sample queries
(found by brute force over all vectors) need. A query's asymmetric distance tables (products of
its parts with the codebooks, to which each list adds the query's distance to its centroid and
each code a constant) rank the codes, and the best ``RERANK``, with all that tie with the last
of them, are ranked again by exact distance. Equal vectors are one entry, the one of the least
``vec_id``; of its copies those of least ``vec_id`` are put in afterwards, so copies by the
thousand neither crowd out others nor lose their order.

Queries are the vectors whose ``vec_id`` meets a condition, all of them if there is none; each
is held against all vectors. Only codes in the lists that a query visits are scored for it.

Near lists share a shard of about ``CELL`` vectors, and a longer list is cut into several, so a
query travels once to each shard it visits, not once to each list. A shard meets its queries
in cells of about ``CELL`` queries: neither hot lists nor many queries grow a task.

Defined results: rows whose vector is null, empty, of another length than the longest common
one (the most frequent, then the longer), or holds nulls or numbers that aren't finite have no
neighbours and are nobody's; a null ``vec_id`` likewise; rows of one ``vec_id`` are one
vector, the least; ties in distance go to the lesser ``vec_id``; fewer than ``k`` others give
as many as there are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import joined_small, written

K, TRAIN, TRAINED_LISTS, SUBSPACES, CODES, QUERIES, TARGET, RERANK, CELL = 10, 16_384, 4096, 16, 256, 256, 0.98, 160, 20_000
#: Queries that are ranked at a time.
ASKED = 256
#: The queries of a search: every row whose id is divisible by 20, against all rows.
DIVISIBLE = "vec_id % 20 = 0"
BROADCAST_SHARDS = 100_000


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids after Lloyd's rounds from evenly spaced rows; empty ones keep their place."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        sizes = np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        centroids[full] = np.add.reduceat(x[order], starts, axis=0) / sizes[full, None]
    return centroids


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 2048):
        out[i : i + 2048] = squared(x[i : i + 2048], centroids).argmin(1)
    return out


class Index:
    """Centroids and codebooks; the former grow as the square root of the table."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = kmeans(sample, min(lists, TRAINED_LISTS))
        if lists > TRAINED_LISTS:
            steps = kmeans(sample - self.centroids[nearest(sample, self.centroids)], -(-lists // TRAINED_LISTS))
            self.centroids = (self.centroids[:, None] + steps[None]).reshape(-1, sample.shape[1])
        residuals = sample - self.centroids[nearest(sample, self.centroids)]
        dims = sample.shape[1]
        self.bounds = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int)
        self.books = [kmeans(residuals[:, a:b], CODES, 6) for a, b in zip(self.bounds, self.bounds[1:])]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centroids)
        residuals = x - self.centroids[lists]
        codes = [nearest(residuals[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)]
        return lists, np.stack(codes, 1).astype(np.uint8)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        d = squared(x, self.centroids)
        if probes >= d.shape[1]:
            return np.argsort(d, axis=1, kind="stable")
        near = np.argpartition(d, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)

    def constants(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What of a code's distance to a query depends on the code and its list alone."""
        out = np.zeros(len(codes))
        for j, (a, b, book) in enumerate(zip(self.bounds, self.bounds[1:], self.books)):
            r = book[codes[:, j]]
            out += (r * r).sum(1) + 2 * (r * self.centroids[lists, a:b]).sum(1)
        return out

    def ranked(self, queries: np.ndarray, visits: np.ndarray, starts: np.ndarray, codes: np.ndarray, constants: np.ndarray, keep: int) -> list[np.ndarray]:
        """For each query the places of the ``keep`` best codes by the asymmetric distance and
        of all that tie with the last; fewer where it visits too few. ``visits``: whether a
        query visits a list; ``starts``: where each list's codes begin, and where the last end."""
        tables = [(-2.0 * (book @ queries[:, a:b].T)).astype(np.float32) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)]
        coarse = squared(queries, self.centroids).astype(np.float32)
        places: list[list[np.ndarray]] = [[] for _ in queries]
        scores: list[list[np.ndarray]] = [[] for _ in queries]
        for at in np.flatnonzero((np.diff(starts) > 0) & visits.any(0)).tolist():
            part, rows = slice(starts[at], starts[at + 1]), np.flatnonzero(visits[:, at])
            # whole rows of a table are quicker to take where most queries want them
            whole = 2 * len(rows) > len(queries)
            block = np.repeat(constants[part, None].astype(np.float32), len(queries) if whole else len(rows), axis=1)
            for j, table in enumerate(tables):
                block += table[codes[part, j]] if whole else table[codes[part, j, None], rows]
            block = np.ascontiguousarray((block[:, rows] if whole else block).T) + coarse[rows, at, None]
            own = np.arange(starts[at], starts[at + 1])
            for i, row in zip(rows.tolist(), block):
                places[i].append(own)
                scores[i].append(row)
        out = []
        for own, found in zip(places, scores):
            place, score = np.concatenate(own or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.float32)])
            out.append(place[score <= np.partition(score, keep - 1)[keep - 1]] if len(score) > keep else place)
        return out

    def shards(self, rows: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Each list's first shard and how many it has, by the lists' numbers of vectors."""
        spread = self.centroids - self.centroids.mean(0)
        axis = np.linalg.svd(spread, full_matrices=False)[2][0]
        first, parts = np.zeros(len(rows), np.int64), np.maximum(1, -(-rows // cell))
        number, held = 0, 0
        for i in np.argsort(spread @ axis, kind="stable"):
            if held and (held + rows[i] > cell or parts[i] > 1):
                number, held = number + 1, 0
            first[i] = number
            held += rows[i]
            if parts[i] > 1:
                number, held = number + int(parts[i]), 0
        return first, parts


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, chosen: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query row, neighbour id, squared distance`` of each query's best ``k``, exactly."""
    rows, found, distances = [], [], []
    for i, q in enumerate(queries):
        at = slice(None) if chosen is None else chosen[i]
        others, them = ids[at], vectors[at]
        d = ((them - q) ** 2).sum(1)
        d[others == own[i]] = np.inf
        if len(d) > k:
            edge = np.partition(d, k - 1)[k - 1]
            near = np.flatnonzero(d <= edge)
        else:
            near = np.arange(len(d))
        near = near[np.lexsort((others[near], d[near]))][:k]
        near = near[np.isfinite(d[near])]
        rows.append(np.full(len(near), i))
        found.append(others[near])
        distances.append(d[near])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(distances)


RESULT = "vec_id long, neighbour_id long, distance double"


def _result(own: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own[found[0]], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["vec_id", "neighbour_id", "distance"])


def _top(pairs: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return pairs.withColumn("rank", place).where(f"rank <= {int(k)}")


def valid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    kind = "float" if table.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def exact_neighbours(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded set of queries over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _result(ids, _best(queries, np.asarray(batch.column(0)), _matrix(batch.column(1)), ids, k))

    return _top(vectors.select("vec_id", "v").mapInArrow(run, RESULT), k)


def nearest_neighbours(table: DataFrame, k: int = K, lists: int | None = None, probes: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding", queries: str | None = None) -> DataFrame:
    """``vec_id, neighbour_id, rank, distance`` (squared Euclidean): ``k`` others, out of all
    vectors, of each vector whose ``vec_id`` meets the condition ``queries``."""
    spark = table.sparkSession
    copies = W.partitionBy("v").orderBy("vec_id")
    members = valid_vectors(table, vec_id, embedding).withColumn("copy", F.row_number().over(copies)).withColumn("least", F.first("vec_id").over(copies))
    members = written(members.withColumn("v", F.when(F.col("copy") == 1, F.col("v"))), "ann-vectors")
    vectors = members.where("copy = 1").select("vec_id", "v")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN).collect()
    x = np.array([r["v"] for r in sample])
    index = Index(x, lists or max(1, round(2 * n**0.5)))
    ids = np.array([r["vec_id"] for r in sample])[:QUERIES]
    if probes is None:
        truth = exact_neighbours(vectors, ids, x[:QUERIES], k).select("vec_id", "neighbour_id").withColumnRenamed("vec_id", "q")
        homes = truth.join(vectors, F.col("neighbour_id") == F.col("vec_id")).select("q", "v").collect()
        order = np.argsort(np.argsort(squared(x[:QUERIES], index.centroids), axis=1, kind="stable"), axis=1)
        at = {int(q): i for i, q in enumerate(ids)}
        needed = order[[at[r["q"]] for r in homes], nearest(np.array([r["v"] for r in homes]), index.centroids)] if homes else np.zeros(1)
        probes = int(np.quantile(needed, TARGET, method="higher")) + 1

    kind = vectors.schema["v"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, codes = index.encoded(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "list", "codes"])

    coded = written(vectors.mapInArrow(encode, f"vec_id long, v {kind}, list int, codes binary"), "ann-lists")
    # a row for each list
    rows = np.zeros(len(index.centroids), np.int64)
    for r in coded.groupBy("list").count().collect():
        rows[r["list"]] = r["count"]
    first, parts = index.shards(rows, CELL)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                near = index.probed(_matrix(batch.column(1)), probes).astype(np.int32)
                at = np.repeat(np.arange(len(near)), near.shape[1])
                lists = near.ravel()
                copies = parts[lists]
                shard = np.repeat(first[lists], copies) + (np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
                at, lists = np.repeat(at, copies), np.repeat(lists, copies)
                order = np.lexsort((lists, shard, at))
                at, lists, shard = at[order], lists[order], shard[order]
                starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (shard[1:] != shard[:-1])]))
                visits = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(lists, pa.int32()))
                taken = pa.array(at[starts])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(shard[starts], pa.int32()), visits], ["query_id", "query", "at", "visits"])

    asking = coded.select("vec_id", "v")
    if queries is not None:
        # an entry is asked for if one of its copies is
        asking = asking.join(members.where(queries).select(F.col("least").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "v")
    asked = written(asking.mapInArrow(ask, f"query_id long, query {kind}, at int, visits array<int>"), "ann-asked")
    # a row for each list at most, and one for each CELL vectors
    grid = asked.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("columns"))
    homes = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts))], "cell int, first int, parts int")
    place = lambda id_, by: F.pmod(F.xxhash64(id_), F.col(by)).cast("int")
    base = coded.join(F.broadcast(homes), F.col("list") == F.col("cell")).withColumn("shard", F.col("first") + place("vec_id", "parts"))
    base = joined_small(base, grid, F.col("shard") == F.col("at"), "inner", BROADCAST_SHARDS).select("shard", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), "vec_id", "v", "list", "codes")
    asked = joined_small(asked, grid.toDF("home", "columns"), F.col("at") == F.col("home"), "inner", BROADCAST_SHARDS).select("at", place("query_id", "columns").alias("column"), "query_id", "query", "visits")

    def cell(key: tuple, queries: pa.Table, members: pa.Table) -> pa.Table:
        schema = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("distance", pa.float64())])
        if not queries.num_rows or not members.num_rows:
            return schema.empty_table()
        matrix = lambda column: _matrix(column.combine_chunks())
        members = members.sort_by("list")
        ids, own, lists = np.asarray(members.column("vec_id")), np.asarray(queries.column("query_id")), np.asarray(members.column("list"))
        starts = np.searchsorted(lists, np.arange(len(index.centroids) + 1))
        v, q, keep = matrix(members.column("v")), matrix(queries.column("query")), max(RERANK, 4 * k)
        codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        constants = index.constants(lists, codes)
        asked_lists = queries.column("visits").combine_chunks()
        out = []
        for at in range(0, len(q), ASKED):
            part = slice(at, at + ASKED)
            own_lists = asked_lists.slice(at, ASKED)
            visits = np.zeros((len(own_lists), len(index.centroids)), bool)
            visits[np.repeat(np.arange(len(own_lists)), np.asarray(own_lists.value_lengths())), np.asarray(own_lists.flatten())] = True
            chosen = index.ranked(q[part], visits, starts, codes, constants, keep)
            out.append(_result(own[part], _best(q[part], ids, v, own[part], k, chosen)))
        return pa.Table.from_batches(out, schema)

    found = asked.groupBy("at", "column").cogroup(base.groupBy("shard", "j")).applyInArrow(cell, RESULT)
    found = _top(found, k).select("vec_id", "neighbour_id", "rank", "distance")
    return found if members.where("copy > 1").isEmpty() else _with_copies(members, found, k, queries)


def _with_copies(members: DataFrame, found: DataFrame, k: int, queries: str | None) -> DataFrame:
    """The neighbours of ``members`` from those ``found`` among distinct vectors. ``k``
    distinct ones and as many copies of each are enough, and one more as nobody is its own."""
    near = found.select("vec_id", "neighbour_id", "distance").union(members.where("copy = 1").select("vec_id", "vec_id", F.lit(0.0)))
    ids = members.where(f"copy <= {int(k) + 1}").select(F.col("least").alias("neighbour_id"), F.col("vec_id").alias("id"))
    near = _top(near.join(ids, "neighbour_id").select("vec_id", F.col("id").alias("neighbour_id"), "distance"), k + 1)
    best = near.groupBy(F.col("vec_id").alias("least")).agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["neighbour_id"] != F.col("vec_id")), 1, k)
    asked = members if queries is None else members.where(queries)
    out = asked.select("vec_id", "least").join(best, "least").select("vec_id", F.posexplode(others).alias("at", "x"))
    return out.select("vec_id", "x.neighbour_id", (F.col("at") + 1).alias("rank"), "x.distance")
