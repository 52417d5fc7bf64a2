"""A content-addressed store of token-id streams.

Each document is encoded once; a rolling hash over windows of ids cuts its stream where the
content says so, so that equal passages give equal chunks wherever they stand. Each unique
chunk is stored once under the hash of its bytes; a document is a recipe, the list of its
chunks' keys, with the root of a Merkle tree over them. The documents' roots are the leaves
of a tree of manifest nodes up to one root for the corpus.

Defined results: a null text is stored as no recipe at all (``n_ids`` null, no keys); an
empty one as an empty recipe; repeated rows give repeated recipes, which share their chunks
and their entry in the manifest, which counts them; a null ``doc_id`` is kept; very long texts
are many chunks, in linear time; other columns are ignored; an empty table gives no rows but
the manifest's, if any.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import DEFAULT_VOCABULARY, ChunkCache, chunk_encoder, encoding_of, id_type, vocabulary_bytes, written

WINDOW, SHORTEST, LONGEST, CUT_BITS = 16, 32, 1024, 7
#: Documents under one lowest manifest node, about.
LEAVES = 4096


def _gear(size: int) -> np.ndarray:
    """One well mixed 64-bit word for each id."""
    with np.errstate(over="ignore"):
        x = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolled(words: np.ndarray) -> np.ndarray:
    """At each place the sum of the last ``WINDOW`` words, each shifted by its age."""
    out = words.copy()
    for age in range(1, WINDOW):
        out[age:] += words[:-age] << np.uint64(age)
    return out


def cuts_of(candidates: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids, from the places where the hash would cut."""
    out, start = [], 0
    for c in candidates:
        while c - start > LONGEST:
            start += LONGEST
            out.append(start)
        if c - start >= SHORTEST:
            start = c
            out.append(c)
    while n - start > LONGEST:
        start += LONGEST
        out.append(start)
    if n > start:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; leaves and inner nodes are hashed apart."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


_caches: dict[int, tuple[ChunkCache, np.ndarray, np.dtype]] = {}


def _tools(vocabulary: bytes) -> tuple[ChunkCache, np.ndarray, np.dtype]:
    key = hash(vocabulary)
    if key not in _caches:
        encoding = encoding_of(vocabulary)
        kind = np.dtype("<u2" if encoding.n_vocab <= 1 << 16 else "<u4")
        encode, code = chunk_encoder(vocabulary), "H" if kind.itemsize == 2 else "I"
        little = sys.byteorder == "little" and array(code).itemsize == kind.itemsize
        _caches[key] = ChunkCache(lambda chunk: array(code, encode(chunk)).tobytes() if little else np.array(encode(chunk), kind).tobytes()), _gear(encoding.n_vocab), kind
    return _caches[key]


def staged(docs: DataFrame, vocabulary: bytes, text: str = "text") -> DataFrame:
    """``doc_id, n_ids, root, chunks`` with keys and ids of each document's chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, gear, kind = _tools(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                streams = [None if t is None else b"".join(cache.parts(t)) for t in texts]
                joined = np.frombuffer(b"".join(s for s in streams if s), kind)
                marks = np.flatnonzero(rolled(gear[joined]) >> np.uint64(64 - CUT_BITS) == 0) + 1
                sizes = np.array([len(s or b"") // kind.itemsize for s in streams], np.int64)
                begins = np.cumsum(sizes) - sizes
                lows, highs = np.searchsorted(marks, begins + WINDOW), np.searchsorted(marks, begins + sizes)
                totals, roots, keys, ids, offsets = [], [], [], [], [0]
                for i, stream in enumerate(streams):
                    if stream is None:
                        totals.append(None)
                        roots.append(None)
                    else:
                        n, start, own = int(sizes[i]), 0, []
                        for end in cuts_of((marks[lows[i] : highs[i]] - begins[i]).tolist(), n):
                            piece = stream[start * kind.itemsize : end * kind.itemsize]
                            own.append(hashlib.blake2b(piece, digest_size=16).digest())
                            ids.append(piece)
                            start = end
                        keys += own
                        totals.append(n)
                        roots.append(merkle(own))
                    offsets.append(len(keys))
                chunks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], ["key", "ids"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(roots, pa.binary()), chunks], ["doc_id", "n_ids", "root", "chunks"])

    return docs.selectExpr("doc_id", f"cast(`{text}` as string) text").mapInArrow(run, f"doc_id {id_type(docs)}, n_ids long, root binary, chunks array<struct<key: binary, ids: binary>>")


def entry_of(doc_id: Column, root: Column, n: Column) -> Column:
    """What the manifest has of a document: a hash over its id, its root and how often the
    two occur together."""
    return F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.hex(doc_id.cast("string")), F.lit("-")), F.hex(root), n.cast("string")).cast("binary"), 256))


def _over(members: Column) -> Column:
    """A node's hash."""
    return F.unhex(F.sha2(F.array_join(F.transform(members, F.hex), "").cast("binary"), 256))


def _entries(recipes: DataFrame, width: int) -> DataFrame:
    """``doc_id, entry, path`` from ``doc_id, root``; the entry's first digits are its path."""
    counted = recipes.where("root is not null").groupBy("doc_id", "root").agg(F.count(F.lit(1)).alias("n"))
    found = counted.select("doc_id", entry_of(F.col("doc_id"), F.col("root"), F.col("n")).alias("entry"))
    return found.withColumn("path", F.lower(F.substring(F.hex("entry"), 1, width)))


def token_store(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text", width: int | None = None) -> DataFrame:
    """The whole store as one table of tagged rows.

    ``chunk``: ``hash`` is its key, ``ids`` its bytes (little-endian, 2 bytes an id, or 4 for
    a vocabulary of over 65,536), ``n`` how often it occurs. ``recipe``: ``doc_id``, ``hash``
    the document's root, ``members`` the chunks' keys in order, ``n`` the number of ids.
    ``node``: ``path`` its place in the manifest, ``hash`` over its ``members`` (documents'
    entries or lower nodes' hashes) in order, ``n`` their number; the path ``""`` is the root.
    The lowest nodes' paths have ``width`` digits: as many as keep about ``LEAVES`` documents
    under each, unless the caller fixes it so that stores of different sizes compare.
    """
    stage = written(staged(docs, vocabulary_bytes(vocabulary), text), "token-store")
    chunks = (
        stage.select(F.explode("chunks").alias("c"))
        .groupBy(F.col("c.key").alias("hash"), F.col("c.ids").alias("ids"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    recipes = stage.select("doc_id", "root", F.col("chunks.key").alias("members"), F.col("n_ids").alias("n"))
    if width is None:
        n, width = stage.count(), 1
        while 16**width * LEAVES < n:
            width += 1
    none, id_ = lambda kind: F.lit(None).cast(kind), id_type(docs)
    out = [
        chunks.select(F.lit("chunk").alias("kind"), none(id_).alias("doc_id"), none("string").alias("path"), "hash", "ids", none("array<binary>").alias("members"), "n"),
        recipes.select(F.lit("recipe").alias("kind"), "doc_id", none("string").alias("path"), F.col("root").alias("hash"), none("binary").alias("ids"), "members", "n"),
    ]
    nodes = _entries(stage.select("doc_id", "root"), width).select("path", F.struct(F.lit("").alias("at"), F.col("entry").alias("hash")).alias("member"))
    for _ in range(width + 1):
        nodes = nodes.groupBy("path").agg(F.sort_array(F.collect_list("member")).alias("m")).select("path", F.col("m.hash").alias("members"))
        nodes = nodes.select("path", _over(F.col("members")).alias("hash"), "members")
        out.append(nodes.select(F.lit("node").alias("kind"), none(id_).alias("doc_id"), "path", "hash", none("binary").alias("ids"), "members", F.size("members").cast("long").alias("n")))
        nodes = nodes.select(F.expr("left(path, length(path) - 1)").alias("path"), F.struct(F.col("path").alias("at"), "hash").alias("member"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def faults(store: DataFrame) -> DataFrame:
    """``path, doc_id, fault``: where the manifest and the recipes disagree; no rows if they
    don't. ``unlisted``: a document (``doc_id``) that the lowest node at ``path`` doesn't have,
    as it is new or was changed; ``missing``: the node has an entry that no recipe gives;
    ``hash``: a node's hash isn't that of its members; ``parent``: a node that its parent
    doesn't have with this hash."""
    nodes = store.where("kind = 'node'").select("path", "hash", "members")
    width = nodes.agg(F.max(F.length("path"))).first()[0] or 0
    here = _entries(store.where("kind = 'recipe'").select("doc_id", F.col("hash").alias("root")), width)
    listed = nodes.where(F.length("path") == width).select(F.col("path").alias("at"), F.explode("members").alias("member"))
    both = here.join(listed, (F.col("entry") == F.col("member")) & (F.col("path") == F.col("at")), "full").where("entry is null or member is null")
    both = both.select(F.coalesce("path", "at").alias("path"), "doc_id", F.when(F.col("member").isNull(), "unlisted").otherwise("missing").alias("fault"))
    none = F.lit(None).cast(id_type(store)).alias("doc_id")
    wrong = nodes.where(_over(F.col("members")) != F.col("hash")).select("path", none, F.lit("hash").alias("fault"))
    children = nodes.where("path != ''").select("path", "hash", F.expr("left(path, length(path) - 1)").alias("up"))
    parents = nodes.select(F.col("path").alias("up"), "members")
    lost = children.join(parents, "up", "left").where(~F.coalesce(F.array_contains("members", F.col("hash")), F.lit(False)))
    return both.unionByName(wrong).unionByName(lost.select("path", none, F.lit("parent").alias("fault")))


def reconstructed(store: DataFrame, id_bytes: int = 2) -> DataFrame:
    """``doc_id, root, n_ids, ids, intact``: every recipe's stream from its chunks, with
    ``intact`` false where a chunk is missing, is not what its key says, the keys don't give
    the root, or the count differs. :func:`faults` holds the roots against the manifest."""
    recipes = store.where("kind = 'recipe' and n is not null").select("doc_id", F.col("hash").alias("root"), "members", F.col("n").alias("n_ids"))
    recipes = recipes.withColumn("keys", F.sha2(F.array_join(F.transform("members", F.hex), ",").cast("binary"), 256))
    # recipes of equal keys share a stream
    parts = recipes.select("keys", "members").dropDuplicates(["keys"]).select("keys", F.posexplode("members").alias("place", "key"))
    parts = parts.join(store.where("kind = 'chunk'").select(F.col("hash").alias("key"), "ids"), "key", "left")
    streams = parts.groupBy("keys").agg(F.sort_array(F.collect_list(F.struct("place", "key", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sound, roots = [], [], []
            for parts in batch.column(1).to_pylist():
                pieces = [p["ids"] or b"" for p in parts]
                ids.append(b"".join(pieces))
                keys = [hashlib.blake2b(p, digest_size=16).digest() for p in pieces]
                sound.append(keys == [p["key"] for p in parts])
                roots.append(merkle(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(sound, pa.bool_()), pa.array(roots, pa.binary())], ["of", "ids", "sound", "over"])

    streams = streams.mapInArrow(run, "of string, ids binary, sound boolean, over binary")
    ids = F.coalesce("ids", F.lit(b""))
    intact = F.coalesce("sound", F.lit(True)) & (F.coalesce("over", F.lit(merkle([]))) == F.col("root")) & (F.length(ids) == F.col("n_ids") * id_bytes)
    return recipes.join(streams, F.col("keys") == F.col("of"), "left").select("doc_id", "root", "n_ids", ids.alias("ids"), F.coalesce(intact, F.lit(False)).alias("intact"))
