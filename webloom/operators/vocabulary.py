"""Vocabularies of word pieces: counting, building, encoding, saving."""

from __future__ import annotations

import heapq
import json
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import with_columns

BASE_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
SPECIAL_TOKENS = ("[BASE64]", "[LONG]")
DEFAULT_SIZE, MAX_WORDS, MAX_LENGTH = 1024, 500_000, 1 << 27
#: Merges after which the cluster keeps the words as they are split by then.
KEPT_MERGES = 16
#: Words of a block, pairs that the driver sees of each count (and their ties), the number behind a word.
BLOCK_WORDS, PAIRS_AT_ONCE, END = 100_000, 256, -1
#: Pieces up to which a block's pairs are counted in a table of all.
TABLE_KINDS = 2048
#: Words whose pieces a task of encoding keeps before it forgets them.
KNOWN_WORDS = 200_000


def token_counts(df: DataFrame, tokens: str = "tokens", change: Callable[[Column], Column] | None = None) -> DataFrame:
    """``token, n`` over all rows, combined on the map side, of tokens as ``change`` makes them,
    one by one, as Spark compiles no expression over the items of an array. The outer explode keeps Spark from
    adding a filter for empty arrays, which would make the tokens twice more; rows without any
    have no place."""
    rows = df.select(F.posexplode_outer(tokens).alias("place", "token")).where(F.col("place").isNotNull())
    if change:
        rows = rows.select(change(F.col("token")).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tokens, ties in order of the token."""
    return counts.orderBy(F.desc("n"), "token").limit(k)


def split_word(word: str) -> list[str]:
    return [word[0], *(f"##{c}" for c in word[1:])]


def merged_at(parts: list[str], pair: tuple[str, str], merged: str) -> list[str]:
    """``parts`` with ``merged`` for each ``pair``, from the left."""
    new, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
            new.append(merged)
            i += 2
        else:
            new.append(parts[i])
            i += 1
    return new


def build(words: Iterable[tuple[str, int]], size: int = DEFAULT_SIZE, special: Iterable[str] = SPECIAL_TOKENS) -> list[str]:
    """A vocabulary of at most ``size`` entries: special tokens, the alphabet (continuations
    marked ``##``), then the results of merging the most frequent neighbouring pieces."""
    special = [*BASE_TOKENS, *sorted(special)]
    counts = Counter()
    for word, n in words:
        if word and word not in special:
            counts[word] += n
    pieces = {w: split_word(w) for w in counts}
    letters = Counter()
    for w, parts in pieces.items():
        for p in parts:
            letters[p] += counts[w]
    out = dict.fromkeys([*special, *sorted(letters, key=lambda p: (-letters[p], p))[: max(0, size - len(special))]])
    pairs, where = Counter(), defaultdict(set)
    for w, parts in pieces.items():
        for pair in zip(parts, parts[1:]):
            pairs[pair] += counts[w]
            where[pair].add(w)
    # the most frequent pair first; entries whose count has changed since are passed over
    queue = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(queue)
    while len(out) < size and queue:
        n, best = heapq.heappop(queue)
        if pairs.get(best, 0) != -n:
            continue
        merged = best[0] + best[1][2:]
        out.setdefault(merged)
        changed = set()
        for w in where.pop(best):
            parts = pieces[w]
            for pair in zip(parts, parts[1:]):
                pairs[pair] -= counts[w]
                changed.add(pair)
            new = merged_at(parts, best, merged)
            pieces[w] = new
            for pair in zip(new, new[1:]):
                pairs[pair] += counts[w]
                where[pair].add(w)
                changed.add(pair)
        for pair in changed:
            if pairs[pair] > 0:
                heapq.heappush(queue, (-pairs[pair], pair))
            else:
                del pairs[pair]
    return list(out)


def train(df: DataFrame, size: int = DEFAULT_SIZE, tokens: str = "tokens", lower: bool = True, max_words: int = MAX_WORDS) -> list[str]:
    """A vocabulary from tokenized rows. Words are counted by the cluster; the driver merges
    them where there are at most ``max_words``, else the cluster does, with the same result."""
    from .tokenize import normalized_token

    counts = token_counts(df, tokens, (lambda t: normalized_token(t, SPECIAL_TOKENS, F.lower)) if lower else None).persist()
    try:
        if counts.count() > max_words:
            return build_on_cluster(counts, size)
        return build([(r["token"], r["n"]) for r in counts.collect()], size)
    finally:
        counts.unpersist()


def build_on_cluster(counts: DataFrame, size: int = DEFAULT_SIZE, special: Iterable[str] = SPECIAL_TOKENS) -> list[str]:
    """What ``build`` gives for ``token, n`` of any number of words. The words are kept as
    numbers, one for each piece, in blocks of ``BLOCK_WORDS``; a job counts the pairs of all
    blocks, and the driver takes from the most frequent ones as many merges as are certain to
    follow each other (``certain_merges``)."""
    special = [*BASE_TOKENS, *sorted(special)]
    words = counts.where((F.length("token") > 0) & ~F.col("token").isin(special)).select("token", "n")
    chars = words.select(F.posexplode_outer(F.split("token", "")).alias("i", "c"), "n")
    letter = F.when(F.col("i") > 0, F.concat(F.lit("##"), "c")).otherwise(F.col("c"))
    letters = [r["p"] for r in chars.select(letter.alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").collect()]
    out = dict.fromkeys([*special, *letters[: max(0, size - len(special))]])
    numbers, names = {p: i for i, p in enumerate(letters)}, list(letters)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ns = array("i"), array("q")

        def block() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([parts.tobytes()], pa.binary()), pa.array([ns.tobytes()], pa.binary())], ["parts", "n"])
            del parts[:], ns[:]
            return made

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.extend(numbers[p] for p in split_word(word))
                parts.append(END)
                ns.append(n)
                if len(ns) >= BLOCK_WORDS:
                    yield block()
        if ns:
            yield block()

    def merging(rounds: list[list[tuple[int, int, int]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    parts = np.frombuffer(batch.column(0)[i].as_py(), np.int32)
                    for merges in rounds:
                        parts = merged_numbers(parts, merges)
                    yield pa.RecordBatch.from_arrays([pa.array([parts.tobytes()], pa.binary()), batch.column(1).slice(i, 1)], ["parts", "n"])

        return run

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in counted_pairs(np.frombuffer(parts, np.int32), np.frombuffer(n, np.int64))], ["a", "b", "n"])

    schema = "parts binary, n binary"
    blocked = words.mapInArrow(blocks, schema).persist()
    tasks = counts.sparkSession.sparkContext.defaultParallelism
    rounds: list[list[tuple[int, int, int]]] = []
    while len(out) < size:
        now = blocked.mapInArrow(merging(list(rounds)), schema) if rounds else blocked
        if sum(map(len, rounds)) >= KEPT_MERGES:
            kept, before, rounds = now.persist(), blocked, []
            kept.count()
            before.unpersist()
            now = blocked = kept
        # few rows come of many words: no more tasks than can run at once
        pairs = now.mapInArrow(counting, "a int, b int, n long").repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
        # equal counts are in order of the pieces, so all that tie with the last one are needed
        found = [(r["n"], names[r["a"]], names[r["b"]]) for r in pairs.withColumn("place", F.rank().over(W.orderBy(F.desc("n")))).where(F.col("place") <= PAIRS_AT_ONCE).select("a", "b", "n").collect()]
        if not found:
            break
        rounds.append([])
        for a, b in certain_merges(found, numbers):
            merged = a + b[2:]
            if merged not in numbers:
                numbers[merged] = len(names)
                names.append(merged)
            rounds[-1].append((numbers[a], numbers[b], numbers[merged]))
            out.setdefault(merged)
            if len(out) >= size:
                break
    blocked.unpersist()
    return list(out)


def certain_merges(pairs: list[tuple[int, str, str]], known: Container[str]) -> list[tuple[str, str]]:
    """The merges that surely come next, given the most frequent ``n, a, b`` with all their ties.

    Merging ``(a, b)`` lessens only counts of pairs that end with ``a`` or begin with ``b``, and
    those it makes are no more frequent than one of these was. So the pairs that follow it in
    order are the next merges up to the first that touches one before it so, or ties with one
    that does. A piece that is known already, or a pair of equal pieces, is the last."""
    out: list[tuple[str, str]] = []
    firsts, seconds, made = set(), set(), set()
    for _, tied in groupby(sorted(pairs, key=lambda p: (-p[0], p[1:])), key=lambda p: p[0]):
        group = [p[1:] for p in tied]
        left, right = firsts | {a for a, _ in group}, seconds | {b for _, b in group}
        touching = any(b in left or a in right for a, b in group)
        if touching and out:
            break
        for a, b in group[:1] if touching else group:
            merged = a + b[2:]
            out.append((a, b))
            if merged in known or merged in made:
                return out
            firsts.add(a)
            seconds.add(b)
            made.add(merged)
        if touching:
            break
    return out


def merged_numbers(parts: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """``merged_at`` for pieces as numbers, of many words with ``END`` behind each, and for
    ``a, b, merged`` of which none begins with what another ends with, so at once."""
    kinds = int(parts.max(initial=0)) + 2
    first, second = np.zeros(kinds, bool), np.zeros(kinds, bool)  # END is the last place
    known = [m for m in merges if max(m[:2]) < kinds - 1]
    first[[m[0] for m in known]] = second[[m[1] for m in known]] = True
    at = np.flatnonzero(first[parts[:-1]] & second[parts[1:]])
    pairs, results = parts[at].astype(np.int64) << 32 | parts[at + 1], np.full(len(at), END, np.int32)
    for a, b, merged in known:
        results[pairs == a << 32 | b] = merged
    at, results = at[results != END], results[results != END]
    if len(merges) == 1 and merges[0][0] == merges[0][1]:  # of a run of equal pieces, every other pair
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        odd = (np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 1
        at, results = at[~odd], results[~odd]
    if not len(at):
        return parts
    new = parts.copy()
    new[at] = results
    return np.delete(new, at + 1)


def counted_pairs(parts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, n`` of the neighbours within words; ``n`` has a count for each word."""
    ends = np.flatnonzero(parts == END)
    weights = np.repeat(n, np.diff(ends, prepend=-1))[:-1]
    inside = (parts[:-1] != END) & (parts[1:] != END)
    a, b, weights = parts[:-1][inside].astype(np.int64), parts[1:][inside], weights[inside]
    kinds = int(parts.max(initial=0)) + 1
    if kinds <= TABLE_KINDS:
        table = np.bincount(a * kinds + b, weights, kinds * kinds)  # whole numbers to 2^53
        pairs = np.flatnonzero(table)
        sums = table[pairs].astype(np.int64)
    else:
        pairs, places = np.unique(a * kinds + b, return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, places, weights)
    return (pairs // kinds).astype(np.int32), (pairs % kinds).astype(np.int32), sums


def pieces_of(word: str, vocabulary: dict[str, int] | set[str], longest: int = 100) -> list[str]:
    """Greedy longest match from the left; ``[UNK]`` where some part isn't there, and, as in
    published tokenizers of this kind, for words of more than ``longest`` characters."""
    if len(word) > longest:
        return ["[UNK]"]
    out, start = [], 0
    while start < len(word):
        for end in range(len(word), start, -1):
            piece = word[start:end] if not start else f"##{word[start:end]}"
            if piece in vocabulary:
                out.append(piece)
                start = end
                break
        else:
            return ["[UNK]"]
    return out


def encode(df: DataFrame, vocabulary: Iterable[str], tokens: str = "tokens", lower: bool = True, special: Iterable[str] = SPECIAL_TOKENS) -> DataFrame:
    """``df`` with ``tokenized``, the word pieces, and ``ids``. A vocabulary's size is bounded
    by its training, so it travels with the function."""
    ids = {t: i for i, t in enumerate(vocabulary)}
    whole, unknown = frozenset(special), ids.get("[UNK]", 0)

    known: dict[str, list[str]] = {}

    def run(rows):
        out, numbers = [], []
        for row in rows:
            made = None if row is None else []
            for token in row or ():
                parts = known.get(token)
                if parts is None:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    parts = known[token] = [token] if token in whole else pieces_of(token.lower() if lower else token, ids)
                made.extend(parts)
            out.append(made)
            numbers.append(None if made is None else [ids.get(p, unknown) for p in made])
        return [out, numbers]

    return with_columns(df, [tokens], run, "tokenized array<string>, ids array<int>")


def save(spark: SparkSession, vocabulary: list[str], folder: str, lower: bool = True) -> None:
    """The vocabulary as a table, and what else a tokenizer has as JSON."""
    rows = spark.createDataFrame(list(enumerate(vocabulary)), "id int, token string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    meta = json.dumps({"model_max_length": MAX_LENGTH, "lower": lower, "special_tokens": sorted(SPECIAL_TOKENS)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/tokenizer")


def load_published(path: str) -> tuple[list[str], dict]:
    """A published vocabulary of word pieces as ``load`` gives one: the tokens by number and
    what else there is. ``path`` is a JSON file as the ``tokenizers`` library saves it, or
    a list of a token a line, which lower-cases if none has a capital but special ones."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        made = json.loads(text)
        model = made["model"]
        if model.get("type", "WordPiece") != "WordPiece" or model.get("continuing_subword_prefix", "##") != "##":
            raise ValueError("the vocabulary isn't of word pieces")
        tokens = sorted(model["vocab"], key=model["vocab"].get)
        lower = bool((made.get("normalizer") or {}).get("lowercase"))
    else:
        tokens = text.splitlines()
        lower = not any(t != t.lower() for t in tokens if not t.startswith("["))
    return tokens, {"model_max_length": MAX_LENGTH, "lower": lower, "special_tokens": sorted(SPECIAL_TOKENS)}


def load(spark: SparkSession, folder: str) -> tuple[list[str], dict]:
    rows = spark.read.parquet(f"{folder}/vocabulary").orderBy("id").collect()
    return [r["token"] for r in rows], json.loads(spark.read.text(f"{folder}/tokenizer").first()["value"])
