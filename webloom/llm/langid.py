"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (1 to 5 letters; words are
lower-cased runs of letters, padded with a blank on either side). The languages' profiles
come from labelled rows: for each language the ``SAMPLE`` rows of least hash, a bounded
sample, whose n-grams are counted together. A document is compared with each profile by the
out-of-place distance: for each of its n-grams the difference of the two ranks, or
``PROFILE`` where the profile lacks it; n-grams of equal frequency share a rank. The least
distance (ties by name) is the language; the share of the greatest possible distance decides
whether it counts.

Defined results: texts that are null, empty or without letters have no language and are
rejected; languages with fewer than ``LEAST`` labelled rows have no profile; rows without a
label (null or empty) train nothing but are identified; with no profile at all everything is
rejected; repeated rows come out repeatedly; very long texts are counted whole, in blocks; an
empty table stays empty; other columns are untouched.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import fresh, joined_small

SAMPLE, LEAST, PROFILE, LONGEST = 2000, 5, 300, 5
#: Greatest share of the possible distance at which a language is accepted.
ACCEPT = 0.9
#: So many languages' bounds at most are broadcast.
BROADCAST_LANGUAGES = 10_000

#: Starts of n-grams that are hashed at a time, so that a text of any length takes bounded memory.
BLOCK = 1 << 19
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def stream(text: str) -> np.ndarray:
    """The code points of a text's words, each between blanks (0); words share the blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _letters()[codes]
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = codes
    padded[~inside] = 0
    inside[:-1] |= inside[1:]  # the blank before a word; the last word's is the last place
    found = padded[inside]
    return np.append(found, np.uint32(0)) if len(found) else found


def _blocks(found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``key, place * 8 + length`` of the n-grams, a block of places at a time."""
    for at in range(0, len(found), BLOCK):
        codes = found[at : at + BLOCK + LONGEST - 1].astype(np.uint64) + np.uint64(1)
        blank = codes == 1
        size = min(BLOCK, len(found) - at)
        key, open_ = codes[:size], np.ones(size, bool)
        keys, places = [key[~blank[:size]]], [np.flatnonzero(~blank[:size]) * 8 + 1]
        for n in range(2, LONGEST + 1):
            whole = min(size, len(codes) - n + 1)
            if whole <= 0:
                break
            if n > 2:  # no blank but at the ends
                open_ = open_[:whole] & ~blank[n - 2 : n - 2 + whole]
            key = key[:whole] * _FACTOR + codes[n - 1 : n - 1 + whole]
            own = open_[:whole]
            keys.append(key[own])
            places.append(np.flatnonzero(own) * 8 + n)
        yield np.concatenate(keys), np.concatenate(places) + at * 8


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams' 64-bit keys, in order, and how often each occurs."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for block, _ in _blocks(found):
        block.sort()
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        own, n = block[starts], np.diff(np.append(starts, len(block)))
        if len(keys):
            both, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
            n = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
            own = both
        keys, counts = own, n
    return keys, counts


def spelled(found: np.ndarray, known: dict[int, str]) -> None:
    """Adds the n-grams of a stream that ``known`` lacks, by key."""
    letters = found.copy()
    letters[found == 0] = 32
    text = letters.tobytes().decode("utf-32-le", "surrogatepass")
    for block, places in _blocks(found):
        keys, first = np.unique(block, return_index=True)
        for key, place in zip(keys.tolist(), places[first].tolist()):
            if key not in known:
                known[key] = text[place >> 3 : (place >> 3) + (place & 7)]


def key_of(gram: str) -> int:
    key = 0
    for i, c in enumerate(gram):
        code = 1 if c == " " else ord(c) + 1
        key = code if not i else (key * int(_FACTOR) + code) & 0xFFFFFFFFFFFFFFFF
    return key


def profiles(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST, size: int = PROFILE, text: str = "text", lang: str = "lang") -> dict[str, dict[str, int]]:
    """For each language its n-grams' ranks, from 1. What reaches the driver is ``size`` rows
    for each language."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), key.alias("key"), F.col(text).cast("string").alias("text")).where("lang is not null and lang != '' and text is not null")
    ranked = labelled.select("lang", "key").withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("key"))).where(f"n <= {int(sample)}")
    bounds = ranked.groupBy("lang").agg(F.max("key").alias("bound"), F.count(F.lit(1)).alias("rows")).where(f"rows >= {int(least)}").select("lang", "bound")
    chosen = joined_small(labelled, bounds.toDF("of", "bound"), F.col("lang") == F.col("of"), "inner", BROADCAST_LANGUAGES).where("key <= bound").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        names: dict[int, str] = {}
        for batch in batches:
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = stream(value)
                spelled(found, names)
                keys, counts = counted(found)
                totals.setdefault(label, Counter()).update(dict(zip(keys.tolist(), counts.tolist())))
        for label, counter in totals.items():
            rows = list(counter.items())
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(rows), pa.string()), pa.array([names[i] for i, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(f"rank <= {int(size)}")
    out: dict[str, dict[str, int]] = {}
    for row in best.select("lang", "gram", "rank").collect():
        out.setdefault(row["lang"], {})[row["gram"]] = row["rank"]
    return dict(sorted(out.items()))


def places_of(known: dict[str, dict[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all profiles' n-grams, in order, and for each language and key the rank, 0
    where the profile lacks it."""
    keys = np.array(sorted({key_of(g) for profile in known.values() for g in profile}), np.uint64)
    at = {int(k): i for i, k in enumerate(keys)}
    out = np.zeros((len(known), len(keys)), np.int64)
    for i, profile in enumerate(known.values()):
        for gram, rank in profile.items():
            out[i, at[key_of(gram)]] = rank
    return keys, out


def out_of_place(keys: np.ndarray, counts: np.ndarray, known: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The distance to each language, and how many n-grams were compared."""
    values, back, often = np.unique(counts, return_inverse=True, return_counts=True)
    above = len(counts) - np.cumsum(often)  # n-grams that are more frequent than each value
    ranks = (above + 1)[back]
    chosen = ranks <= size
    keys, ranks = keys[chosen], ranks[chosen]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    there = known[at] == keys
    at = places[:, at[there]]
    gaps = np.where(at > 0, np.minimum(np.abs(at - ranks[there]), size), size)
    return gaps.sum(axis=1) + size * int((~there).sum()), len(keys)


OUTPUT = ("detected_lang", "lang_distance", "lang_accepted")


def detected(docs: DataFrame, known: dict[str, dict[str, int]], accept: float = ACCEPT, size: int = PROFILE, text: str = "text", output: tuple[str, str, str] = OUTPUT) -> DataFrame:
    """``docs`` with the language, the share of the greatest possible distance and whether it
    is accepted, in place of any columns of the names in ``output``."""
    names = list(known)
    keep = [c for c in docs.columns if c.lower() not in output]
    schema = docs.select(*(f"`{c}`" for c in keep)).schema
    schema = type(schema)(list(schema.fields))
    for name, kind in zip(output, ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = places_of(known)
        for batch in batches:
            langs, distances, accepted = [], [], []
            for value in batch.column(place).to_pylist():
                found = stream(value) if value and names else ()
                if not len(found):
                    langs.append(None)
                    distances.append(None)
                    accepted.append(False)
                    continue
                d, n = out_of_place(*counted(found), keys, places, size)
                i = int(d.argmin())
                langs.append(names[i])
                distances.append(float(d[i]) / (n * size))
                accepted.append(distances[-1] <= accept)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(distances, pa.float64()), pa.array(accepted, pa.bool_())], [*keep, *output])

    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def identified(docs: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """``doc_id, detected_lang, lang_distance, lang_accepted`` of every row, by profiles from
    the labelled rows of ``docs``."""
    text = options.get("text", "text")
    return detected(docs.select("doc_id", text), profiles(docs, **options), accept, text=text).drop(text)


def accepted_documents(docs: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages; columns as they were."""
    output = tuple(fresh(docs, *OUTPUT))
    found = detected(docs, profiles(docs, **options), accept, text=options.get("text", "text"), output=output)
    return found.where(output[2]).select(*(f"`{c}`" for c in docs.columns))


LANGID_SQL = f"""
WITH l AS (SELECT lang, text, ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS key FROM documents WHERE lang <> '' AND text IS NOT NULL),
b AS (SELECT lang, max(key) AS bound FROM (SELECT lang, key, row_number() OVER (PARTITION BY lang ORDER BY key) AS n FROM l) WHERE n <= {SAMPLE} GROUP BY lang HAVING count(*) >= {LEAST}),
w AS (SELECT doc_id, ' ' || unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) || ' ' AS w FROM documents),
g AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, w[i:i + k - 1] AS g FROM w, range(1, {LONGEST} + 1) k(k), LATERAL (SELECT unnest(range(1, length(w) - k + 2)) AS i)) WHERE g <> ' ' GROUP BY doc_id, g),
t AS (SELECT l.lang, g.g, sum(g.n) AS n FROM g JOIN documents d USING (doc_id) JOIN l ON l.lang = d.lang AND l.key = ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 12))::BIGINT JOIN b ON b.lang = l.lang AND l.key <= b.bound GROUP BY l.lang, g.g),
p AS (SELECT lang, g, rank FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS rank FROM t) WHERE rank <= {PROFILE}),
r AS (SELECT doc_id, g, rank FROM (SELECT doc_id, g, rank() OVER (PARTITION BY doc_id ORDER BY n DESC) AS rank FROM g) WHERE rank <= {PROFILE}),
m AS (SELECT doc_id, count(*) AS m FROM r GROUP BY doc_id),
s AS (SELECT r.doc_id, p.lang, count(*) AS hits, sum(least(abs(p.rank - r.rank), {PROFILE})) AS d FROM r JOIN p ON p.g = r.g GROUP BY r.doc_id, p.lang),
a AS (SELECT m.doc_id, q.lang, m.m, coalesce(s.d, 0) + {PROFILE} * (m.m - coalesce(s.hits, 0)) AS d FROM m CROSS JOIN (SELECT DISTINCT lang FROM p) q LEFT JOIN s ON s.doc_id = m.doc_id AND s.lang = q.lang),
o AS (SELECT doc_id, lang, d::DOUBLE / (m * {PROFILE})::DOUBLE AS x, row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) AS n FROM a)
SELECT d.doc_id, o.lang AS detected_lang, o.x AS lang_distance, coalesce(o.x <= {ACCEPT}, false) AS lang_accepted
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id AND o.n = 1
"""
