"""SimHash fingerprints and all their neighbours within a Hamming radius.

Terms are words, lower-cased runs of letters and digits. A term's hash is the first half of its
MD5 digest, and its weight the number of binary digits of how often it occurs (1, 2 for 2 or 3,
3 for 4 to 7), so that common words don't outvote the rest. With that weight it votes on each
of the 64 bits, and a bit is set where over half of the weight is for it.

Neighbours: the bits are cut into ``n`` blocks; two fingerprints within radius ``r`` agree in
at least ``n - r`` of them, so among the tables for all ways to choose these blocks, keyed by
the chosen bits, some table has both under one key. The search is exact for any ``n``; more
blocks make longer keys and more tables, so their number follows the table's size. Equal fingerprints are
one entry, so copies by the thousand cost no pairs.

Defined results: a null text or one without words has a null fingerprint and no neighbours;
repeated rows come out repeatedly; very long texts take 16 bytes a word;
an empty table gives no rows; a null ``doc_id`` gets its fingerprint and neighbours but
is nobody's neighbour; ties in votes clear the bit; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import id_type, written
from .words import digests

RADIUS = 6
#: Fingerprints that a key may have by chance before more, longer keys are made.
CROWD = 64


def fingerprint(text: str) -> int | None:
    """The 64-bit fingerprint as a signed integer."""
    words = digests.of(text)
    if not len(words):
        return None
    terms, often = np.unique(words[:, 0], return_counts=True)
    weights = np.frexp(often)[1].astype(np.float32)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(terms), 4096):
        bits = np.unpackbits(terms[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1)
        votes += (weights[at : at + 4096] @ bits.astype(np.float32)).astype(np.int64)
    return int(np.packbits(2 * votes > int(weights.sum(dtype=np.float64))).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.selectExpr("doc_id", f"cast(`{text}` as string) text").mapInArrow(run, f"doc_id {id_type(docs)}, fingerprint long")


def table_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each table: its number and the chosen blocks' bits."""
    sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    begins = [sum(sizes[:i]) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for b in chosen:
            key = F.shiftleft(key, sizes[b]).bitwiseOR(F.shiftrightunsigned(fp, begins[b]).bitwiseAND(F.lit((1 << sizes[b]) - 1)))
        keys.append(key)
    return F.array(*keys)


def blocks_for(rows: int, radius: int) -> int:
    """The least number of blocks, 3 more than the radius at least, at which a key has no more
    than ``CROWD`` of so many random fingerprints; at most twice the radius and 2."""
    most = max(radius + 3, 2 * radius + 2)
    return next((n for n in range(radius + 3, most) if rows <= CROWD << (64 * (n - radius) // n)), most)


def neighbouring(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``a, b, hamming`` with ``a < b`` for all pairs of distinct fingerprints within the radius."""
    if not 0 <= radius < blocks:
        raise ValueError("there must be more blocks than the radius")
    keyed = prints.select("fingerprint", F.explode(table_keys(F.col("fingerprint"), radius, blocks)).alias("key"))
    bucket = W.partitionBy("key")
    shared = keyed.withColumn("low", F.min("fingerprint").over(bucket)).withColumn("high", F.max("fingerprint").over(bucket)).where("low != high")
    a, b = shared.select("key", F.col("fingerprint").alias("a")), shared.select("key", F.col("fingerprint").alias("b"))
    hamming = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int")
    return a.join(b, "key").where(F.col("a") < F.col("b")).withColumn("hamming", hamming).where(F.col("hamming") <= radius).select("a", "b", "hamming").distinct()


def simhash(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None, text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, near_doc_ids``: for every document the least ``doc_id`` of each
    distinct fingerprint within the radius, its own included, itself left out, in order."""
    stage = written(fingerprints(docs, text), "simhash")
    prints = stage.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    pairs = neighbouring(prints, radius, blocks or blocks_for(stage.count(), radius)).drop("hamming")
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(prints.toDF("b", "least"), "b").where("least is not null").groupBy(F.col("a").alias("fingerprint")).agg(F.collect_list("least").alias("near"))
    none = F.array().cast(f"array<{id_type(docs)}>")
    known = prints.join(near, "fingerprint", "left").select(F.col("fingerprint").alias("f"), F.concat(F.array("least"), F.coalesce("near", none)).alias("near"))
    ids = F.array_sort(F.filter(F.coalesce("near", none), lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("doc_id"))))
    return stage.join(known, F.col("fingerprint") == F.col("f"), "left").select("doc_id", "fingerprint", ids.alias("near_doc_ids"))


_BITS = " + ".join(f"CASE WHEN 2 * sum(w * ((h >> {i})::UBIGINT & 1)::BIGINT) > sum(w) THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
SIMHASH_SQL = f"""
WITH t AS (SELECT doc_id, ('0x' || md5(x)[1:16])::UBIGINT AS h, length(bin(count(*)))::BIGINT AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS x FROM documents) GROUP BY doc_id, x),
v AS (SELECT doc_id, {_BITS} AS f FROM t GROUP BY doc_id),
f AS (SELECT doc_id, (CASE WHEN f >= 9223372036854775808::HUGEINT THEN f - 18446744073709551616::HUGEINT ELSE f END)::BIGINT AS fingerprint FROM v),
p AS (SELECT fingerprint, min(doc_id) AS least FROM f GROUP BY fingerprint),
n AS (SELECT a.fingerprint, list(b.least) AS near FROM p a, p b WHERE bit_count(xor(a.fingerprint, b.fingerprint)) <= {RADIUS} GROUP BY a.fingerprint)
SELECT d.doc_id, f.fingerprint, list_sort(list_filter(coalesce(n.near, []::BIGINT[]), lambda x: x <> d.doc_id)) AS near_doc_ids
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN n ON n.fingerprint = f.fingerprint
"""
