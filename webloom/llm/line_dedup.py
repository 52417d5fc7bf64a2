"""Removal of repeated lines, exact and within one edit, keeping the earliest.

Lines come from splitting texts at line ends; blank ones (spaces, tabs, carriage returns) are
layout and stay. Two lines, of whatever length, are alike if they are equal or if one
insertion, deletion or substitution makes them equal. A line is dropped if a line like it
stands earlier, by ``doc_id``, then place in the text, then the text's hash.

The search is a deletion-neighbourhood join, exact and without all-pairs work. Lines of m and
m or m + 1 characters that are one edit apart share their first or last half, so first the
hashed halves are joined; only lines with a partner there emit variants: for the other half
every deletion of one character as a hashed key (with its place for substitutions, which meet
where both delete at one place; without it for insertions, where one side deletes and the
other is whole). Equal variants are joined, each line with the group's earliest that counts,
the edit distance is verified on the texts, and the later line goes. Groups of any size cost
a candidate for each line in them. Equal lines meet by 128 bits of hash; 64 of them name a
line on its way to the verification, which a collision there doesn't survive.

Defined results: null and empty texts stay as they are; a null ``doc_id`` stands before all
others; repeated rows (same ``doc_id`` and text) keep the same lines, and of different texts
under one ``doc_id`` the one of lesser hash stands first where places are equal; a text that
loses lines keeps the line ends between those that stay; very long lines and very many lines
take linear time and space; ``n_chars``, where it is there, follows the new text; ``n_lines`` (not
blank) and ``n_dropped`` replace columns of these names; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import dropped, fresh, joined_small, written

#: Tables of more rows than this are joined by shuffle, not broadcast.
BROADCAST_ROWS = 1_000_000

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashed_deletions(text: str) -> tuple[np.uint64, np.ndarray]:
    """The hash of ``text``, and those of all texts with one character less, in linear time."""
    codes = _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers(n) if n else codes, out=sums[1:])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
    return _mixed(sums[-1:] + np.uint64(n))[0], _mixed(without + np.uint64(max(n - 1, 0)))


def blank(line: Column) -> Column:
    return ~line.rlike("[^ \t\r]")


def _half_keys(line: Column) -> Column:
    """Keys by which lines one edit apart meet: as the shorter or equal one (0, 1) and as the
    longer one (2, 3), by first and last half; null where the shorter one would be empty."""
    n = F.char_length(line)
    keys = []
    for less in (0, 1):
        m = n - less
        half = F.floor(m / 2).cast("int")
        for side, part in (("first", F.substring(line, F.lit(1), half)), ("last", F.substring(line, half + 1 + less, n))):
            keys.append(F.when(m >= 1, F.xxhash64(F.lit(side), m, part)))
    return F.array(*keys)


def _variants(flagged: DataFrame) -> DataFrame:
    """``vkey, id, side``: 0 a substitution's variant, 1 a whole half, 2 an insertion's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vkeys, ids, sides, rows, done = [], [], [], 0, 0
            for id_, line, roles in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = len(line)
                for role in roles:
                    less = role["role"] // 2
                    half = (n - less) // 2
                    part = line[half:] if role["role"] % 2 == 0 else line[: half + less]
                    whole, without = hashed_deletions(part)
                    key = np.uint64(role["key"] & 0xFFFFFFFFFFFFFFFF)
                    if less:
                        found = [(2, _mixed(np.unique(without) ^ key))]
                    else:
                        places = np.arange(1, len(without) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                        found = [(0, _mixed((without + places) ^ ~key)), (1, _mixed(np.array([whole]) ^ key))]
                    for side, values in found:
                        vkeys.append(values.view(np.int64))
                        ids.append(np.full(len(values), id_, np.int64))
                        sides.append(np.full(len(values), side, np.int8))
                rows += sum(map(len, vkeys[done:]))
                done = len(vkeys)
                if rows > 500_000:
                    yield _batch(vkeys, ids, sides)
                    vkeys, ids, sides, rows, done = [], [], [], 0, 0
            if vkeys:
                yield _batch(vkeys, ids, sides)

    return flagged.select("id", "line", "roles").mapInArrow(run, "vkey long, id long, side byte")


def _batch(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["vkey", "id", "side"])


def kept_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, hash, stays``: for each document that has any, by id and text, whether the
    lines, from the first to the last that stays, stay."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    exploded = lambda rows: rows.select("doc_id", "hash", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = exploded(source).where(~blank(F.col("line")))
    keys = _half_keys(F.col("line"))
    lines = lines.select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("id2"), F.struct("doc_id", "place", "hash").alias("first"), *(keys[i].alias(f"k{i}") for i in range(4)))
    distinct = written(lines.groupBy("id", "id2", "k0", "k1", "k2", "k3").agg(F.min("first").alias("first")), "lines")
    # lines that share a half with another line
    halves = distinct.select("id", "id2", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("role", "key")).where("key is not null")
    bucket = W.partitionBy("key")
    shared = halves.withColumn("low", F.min("id").over(bucket)).withColumn("high", F.max("id").over(bucket)).where("low != high")
    roles = shared.groupBy("id", "id2").agg(F.collect_list(F.struct("role", "key")).alias("roles"))
    flagged = written(roles.join(distinct.select("id", "id2", "first"), ["id", "id2"]), "lines-flagged")
    homes = flagged.select(F.col("first.doc_id").alias("home"), F.col("first.hash").alias("of")).distinct()
    texts = exploded(joined_small(source, homes, F.col("doc_id").eqNullSafe(F.col("home")) & (F.col("hash") == F.col("of")), "left_semi", BROADCAST_ROWS))
    texts = texts.select(F.xxhash64("line").alias("at"), F.struct("doc_id", "place", "hash").alias("there"), "line")
    same = (F.col("id") == F.col("at")) & (F.col("first.place") == F.col("there.place")) & (F.col("first.hash") == F.col("there.hash")) & F.col("first.doc_id").eqNullSafe(F.col("there.doc_id"))
    flagged_texts = flagged.join(texts, same).select("id", "id2", "first", "roles", "line").dropDuplicates(["id", "id2"])
    flagged_texts = written(flagged_texts, "lines-texts")
    # equal variants
    variants = _variants(flagged_texts)
    bucket = W.partitionBy("vkey")
    equal = variants.withColumn("low", F.min("id").over(bucket)).withColumn("high", F.max("id").over(bucket)).where("low != high").select("vkey", "id", "side")
    equal = equal.join(flagged_texts.select("id", "first"), "id")
    entry = F.struct("first", "id")
    earliest = lambda side: F.min(F.when(F.col("side") == side, entry)).over(bucket)
    partner = F.when(F.col("side") == 0, earliest(0)).when(F.col("side") == 1, earliest(2)).otherwise(earliest(1))
    candidates = equal.withColumn("partner", partner).where(F.col("partner.first") < F.col("first")).select("id", F.col("partner.id").alias("other")).distinct()
    line_of = flagged_texts.select("id", "id2", "first", "line")
    verified = (
        candidates.join(line_of, "id")
        .join(line_of.select("id", "first", "line").toDF("other", "other_first", "other_line"), "other")
        .where((F.col("other_first") < F.col("first")) & F.levenshtein("line", "other_line", 1).between(0, 1))
        .select(F.col("id").alias("later"), F.col("id2").alias("later2"))
        .distinct()
    )
    later = written(verified, "lines-later")
    stay = joined_small(distinct.select("id", "id2", "first"), later, (F.col("id") == F.col("later")) & (F.col("id2") == F.col("later2")), "left_anti", BROADCAST_ROWS)
    dropped(spark, flagged)
    places = stay.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("hash")).agg(F.sort_array(F.collect_list("first.place")).alias("at"))
    run = lambda place, i: F.concat(F.array_repeat(F.lit(False), place - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
    return places.select("doc_id", "hash", F.flatten(F.transform("at", run)).alias("stays"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the lines that were there before, and ``n_lines``, ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    key, hash_, stays, lines, left = fresh(docs, "kept_doc_id", "kept_hash", "stays", "lines", "left")
    stay = kept_lines(docs, text, doc_id).toDF(key, hash_, stays)
    is_kept = lambda line, i: blank(line) | F.coalesce(F.get(stays, i), F.lit(False))
    count = lambda c: F.coalesce(F.size(F.filter(c, lambda line: ~blank(line))), F.lit(0))
    out = docs.join(stay, docs[doc_id].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text].cast("string")) == F.col(hash_)), "left")
    out = out.withColumn(lines, F.split(F.col(text).cast("string"), "\n", -1)).withColumn(left, F.filter(lines, is_kept))
    n = F.when(F.col(lines).isNull(), 0).otherwise(count(F.col(lines)))
    n_left = F.when(F.col(lines).isNull(), 0).otherwise(count(F.col(left)))
    columns = [F.array_join(left, "\n").alias(c) if c == text else F.when(n_left < n, F.char_length(F.array_join(left, "\n")).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, n.alias("n_lines"), (n - n_left).alias("n_dropped"))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines and without documents of which no line was left; their
    columns as they were."""
    plain = docs.toDF(*(f"own {c}" if c.lower() in ("n_lines", "n_dropped") else c for c in docs.columns))
    out = deduplicated(plain).where("n_dropped = 0 or n_dropped < n_lines").drop("n_lines", "n_dropped")
    return out.toDF(*docs.columns)


#: DuckDB counts edits in bytes, of which a character has up to four, so the characters are compared after that.
LINES_SQL = """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM s) WHERE regexp_matches(line, '[^ \\t\\r]')),
d AS (SELECT line, length(line) AS n, min([doc_id, i]) AS f FROM l GROUP BY line),
x AS (SELECT DISTINCT a.line FROM d a JOIN (SELECT *, unnest([n - 1, n, n + 1]) AS m FROM d) b ON b.m = a.n AND b.f < a.f
  WHERE CASE WHEN levenshtein(a.line, b.line) <= 4 THEN len(list_filter(range(0, least(a.n, b.n) + 1), lambda i: a.line[1:i] = b.line[1:i] AND a.line[i + CASE WHEN a.n >= b.n THEN 2 ELSE 1 END:] = b.line[i + CASE WHEN b.n >= a.n THEN 2 ELSE 1 END:])) > 0 ELSE false END),
k AS (SELECT f[1] AS doc_id, f[2] AS i FROM d ANTI JOIN x USING (line)),
t AS (SELECT s.doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM s),
u AS (SELECT t.doc_id, t.i, t.line, NOT regexp_matches(t.line, '[^ \\t\\r]') AS blank, k.i IS NOT NULL AS kept FROM t LEFT JOIN k ON k.doc_id = t.doc_id AND k.i = t.i),
r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (blank OR kept), '') AS text, count(*) FILTER (NOT blank)::INTEGER AS n_lines, count(*) FILTER (NOT blank AND NOT kept)::INTEGER AS n_dropped FROM u GROUP BY doc_id)
SELECT doc_id, r.text, lang, source, CASE WHEN n_dropped > 0 THEN length(r.text) ELSE n_chars END::BIGINT AS n_chars, n_lines, n_dropped FROM documents JOIN r USING (doc_id)
"""
