"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For a byte-pair vocabulary the encoding of a prefix ends in exactly one token ``t``, and
what stands before ``t`` is the encoding of the shorter prefix. So with ``last[i]`` the last
token of prefix ``i``, ``count[i] = count[i - len(last[i])] + 1``; a candidate token fits if
it and its predecessor, put together, encode to just these two. Pieces of the pre-splitting
rule are independent but for white space and contractions, which are handled apart.

The counts are kept as one signed byte per character (the change from the prefix before),
so questions such as "how many tokens do the first n characters have" or "how much text fits
in b tokens" need a running sum and no encoding.

Defined results: a null text gives nulls; an empty one 0 tokens and an empty table; repeated
rows give repeated results; other columns are ignored; very long texts take linear time; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import DEFAULT_VOCABULARY, ChunkCache, chunk_encoder, encoding_of, id_type, ranks_of, vocabulary_bytes

BUDGETS = (512, 2048)
PREFIX = 1000
#: Documents whose new pieces are solved together; results don't depend on it.
ROWS = 2000

#: A run of white space with the piece after it; only between such segments does the
#: pre-splitting rule cut alike for a text and all its prefixes.
SEGMENT = regex.compile(r"(\s*)((?<! )'(?:[stmd]|re|ve|ll)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|(\s+)")
LONG_CONTRACTIONS = {"'re", "'ve", "'ll"}


#: A chunk's pieces, where no other white space and no contraction can be in it.
PIECES = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
#: Pieces that are solved at a time; results don't depend on it.
GROUP = 1 << 16
#: Solved pieces that a worker remembers before it forgets all; results don't depend on it.
KNOWN = 300_000


class Pairs:
    """Which two tokens stay apart when put together, remembered in a table of fixed size
    that forgets what its slots are needed for."""

    def __init__(self, tokens: list[bytes], encode, bits: int = 20):
        self.tokens, self.encode, self.bits = tokens, encode, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)
        out = self.values[at]
        missing = np.flatnonzero(self.keys[at] != keys)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            tokens, encode = self.tokens, self.encode
            found = np.fromiter((encode(tokens[x] + tokens[y]) == [x, y] for x, y in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist())), bool, len(new))
            out[missing] = found[back]
            at = at[missing]
            self.keys[at] = keys[missing]
            # of two keys with one slot the one that is there counts
            held = self.keys[at] == keys[missing]
            self.values[at[held]] = out[missing][held]
        return out


class PrefixCounter:
    """Counts for one vocabulary. Pieces that are new in a batch are solved together, one
    place after another for all of them: at each place the vocabulary's trie, read from the
    place backwards, gives the tokens that may end there, the shortest first."""

    SHORT = 48

    def __init__(self, vocabulary: bytes):
        self.ranks = ranks_of(vocabulary)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.encode = encoding_of(vocabulary)._core_bpe.encode_single_piece
        self.pairs = Pairs(tokens, self.encode)
        self.pieces: dict[str, bytes] = {}
        self.cache = ChunkCache(self.deltas)
        edges: dict[int, int] = {}
        ends = [-1]
        for token, rank in self.ranks.items():
            state = 0
            for byte in reversed(token):
                edge = state << 8 | byte
                if edge not in edges:
                    edges[edge] = len(ends)
                    ends.append(-1)
                state = edges[edge]
            ends[state] = rank
        self.edges = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def solved(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece the change of the token count at each of its characters."""
        order = sorted(range(len(pieces)), key=pieces.__getitem__)
        sizes = np.array([len(pieces[i]) for i in order], np.int64)
        n, width = len(order), int(sizes.max(initial=0))
        mask = np.arange(width) < sizes[:, None]
        data = np.zeros((n, width), np.uint8)
        data[mask] = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)
        # what a piece shares with the one before it, in order, is solved there
        differ = (data[1:] != data[:-1]) | ~mask[:-1]
        shared = np.zeros(n, np.int64)
        if width:
            shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
        last, counts = np.full((width + 1, n), -1, np.int64), np.zeros((width + 1, n), np.int32)
        data = np.ascontiguousarray(data.T)
        for place in range(1, width + 1):
            rows = np.flatnonzero(sizes >= place)
            fresh = shared[rows] < place
            todo = rows[fresh]
            state = np.zeros(len(todo), np.int64)
            for start in range(place - 1, -1, -1):
                edge = state << 8 | data[start, todo]
                at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                if not (self.edges[at] == edge).all():
                    raise ValueError("the vocabulary lacks single bytes")
                state = self.targets[at]
                token = self.ends[state]
                ends = np.flatnonzero(token >= 0)
                if start and len(ends):
                    ends = ends[self.pairs.fit(last[start, todo[ends]], token[ends])]
                done = todo[ends]
                last[place, done], counts[place, done] = token[ends], counts[start, done] + 1
                left = np.ones(len(todo), bool)
                left[ends] = False
                todo, state = todo[left], state[left]
                if not len(todo):
                    break
            source = np.maximum.accumulate(np.where(fresh, rows, 0))
            last[place, rows], counts[place, rows] = last[place, source], counts[place, source]
        # a character ends where no continuation byte follows
        ends = mask.copy()
        ends[:, :-1] &= ~mask[:, 1:] | ((data.T[:, 1:] & 0xC0) != 0x80)
        flat = counts[1:].T[ends]
        stops = np.cumsum(ends.sum(1)).tolist()
        starts = [0, *stops[:-1]]
        before = np.concatenate([[0], flat[:-1]])
        before[starts] = 0
        changes = (flat - before).astype(np.int8).tobytes()
        out = [b""] * n
        for i, a, b in zip(order, starts, stops):
            out[i] = changes[a:b]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Solves pieces of at most ``SHORT`` bytes that aren't known yet."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > KNOWN:
            self.pieces.clear()
            new = list(pieces)
        for at in range(0, len(new), GROUP):
            group = new[at : at + GROUP]
            self.pieces.update(zip(group, self.solved([p.encode() for p in group])))

    def prepare(self, texts: list[str | None]) -> None:
        """Solves what is new in a batch of texts: chunks of the plain kind whole, of others
        their pieces. What it leaves out is solved alone when its turn comes."""
        rest = self.cache.rest
        chunks = set().union(*(t.split(" ") for t in texts if t))
        new = chunks.difference(rest)
        if len(rest) + len(new) > self.cache.entries:
            rest.clear()
            new = chunks
        words, plain, other, most = [], [], set(), self.SHORT // 4
        for chunk in new:
            if chunk.isascii() and chunk.isalpha():
                if len(chunk) < self.SHORT:
                    words.append(chunk)
                continue
            whole = " " + chunk
            parts = PIECES.findall(whole)
            if "'" not in chunk and (parts[0] == whole if len(parts) == 1 else "".join(parts) == whole):
                if len(chunk) < most or len(whole.encode()) <= self.SHORT:
                    plain.append((chunk, parts))
            elif chunk:
                other.update(p for p in (*parts, *(p.lstrip(" ") for p in parts)) if len(p) <= most)
        for at in range(0, len(words), GROUP):
            group = words[at : at + GROUP]
            rest.update(zip(group, self.solved([b" " + w.encode() for w in group])))
        for at in range(0, len(plain), GROUP):
            group = plain[at : at + GROUP]
            self.learn({p for _, parts in group for p in parts})
            get = self.pieces.__getitem__
            rest.update((chunk, get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))) for chunk, parts in group)
        self.learn(other)

    def changes(self, text: str) -> bytes:
        """The change of the token count at each character of one piece."""
        found = self.pieces.get(text)
        if found is None:
            counts = self.single(text)
            found = bytes((b - a) & 255 for a, b in zip([0, *counts], counts))
            if len(text) <= self.SHORT // 4:
                self.pieces[text] = found
        return found

    def single(self, text: str) -> list[int]:
        """Token counts of all prefixes of one piece of any length, in linear time."""
        data, ranks, encode, tokens = text.encode(), self.ranks, self.encode, self.pairs.tokens
        n, known = len(data), {}
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for i in range(1, n + 1):
            for start in range(i - 1, -1, -1):
                token = ranks.get(data[start:i])
                if token is None:
                    continue
                fits = start == 0 or known.get((last[start], token))
                if fits is None:
                    fits = known[last[start], token] = encode(tokens[last[start]] + tokens[token]) == [last[start], token]
                if fits:
                    counts[i], last[i] = counts[start] + 1, token
                    break
        if n == len(text):
            return counts[1:]
        return [counts[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]

    def deltas(self, text: str) -> bytes:
        out = []
        for space, word, rest in SEGMENT.findall(text):
            if run := space or rest:
                inside = self.changes(run)
                out.append(inside)
                if word:
                    # the last of the white space goes with the word, or stands alone before it
                    if run[-1] == " ":
                        after = self.changes(" " + word)
                        first, after = after[0] + after[1] - inside[-1], after[2:]
                    else:
                        after = self.word(word)
                        first, after = self.changes(run[-1])[0] + after[0] - inside[-1], after[1:]
                    out.append(bytes([first & 255]))
                    out.append(after)
            else:
                out.append(self.word(word))
        return b"".join(out)

    def word(self, word: str) -> bytes:
        changes = self.changes(word)
        if word in LONG_CONTRACTIONS:
            # without its last letter it is no contraction but a sign and a letter
            first, second = changes[0], self.changes(word[1])[0]
            changes = bytes([first, second, (sum(changes) - first - second) & 255])
        return changes

    def table(self, text: str) -> bytes:
        return b"".join(self.cache.parts(text))


_counters: dict[int, PrefixCounter] = {}


def counter_of(vocabulary: bytes) -> PrefixCounter:
    key = hash(vocabulary)
    if key not in _counters:
        _counters[key] = PrefixCounter(vocabulary)
    return _counters[key]


def running(table: bytes) -> np.ndarray:
    """Counts of the prefixes of 0, 1, 2 ... characters from a stored table."""
    out = np.zeros(len(table) + 1, np.int64)
    np.cumsum(np.frombuffer(table, np.int8), out=out[1:])
    return out


def tokens_at(table: bytes, characters: int) -> int:
    """Exact token count of the text's first ``characters`` characters (all, if fewer)."""
    return int(running(table)[min(max(characters, 0), len(table))])


def fitting(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(running(table) <= budget)[-1]) if budget >= 0 else 0


def prefix_token_counts(
    docs: DataFrame,
    vocabulary: str = DEFAULT_VOCABULARY,
    budgets: Iterable[int] = BUDGETS,
    prefix: int = PREFIX,
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, prefix_deltas``, and from that table alone ``tokens_at_<prefix>``
    and ``fits_<budget>`` (characters that fit in the budget) for every document."""
    data, budgets = vocabulary_bytes(vocabulary), tuple(budgets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(data)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            tables, totals, at, fit = [], [], [], [[] for _ in budgets]
            texts = batch.column(1).to_pylist()
            counter.prepare(texts)
            for value in texts:
                table = None if value is None else counter.table(value)
                tables.append(table)
                counts = None if table is None else running(table)
                totals.append(None if counts is None else int(counts[-1]))
                at.append(None if counts is None else int(counts[min(prefix, len(counts) - 1)]))
                for out, budget in zip(fit, budgets):
                    if counts is None:
                        out.append(None)
                    elif len(counts) - 1 <= budget:
                        # no token is shorter than a byte, but a character may have several
                        out.append(len(counts) - 1 if counts.max() <= budget else int(np.flatnonzero(counts <= budget)[-1]))
                    else:
                        out.append(int(np.flatnonzero(counts <= budget)[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(at, pa.int64()), *(pa.array(x, pa.int64()) for x in fit), pa.array(tables, pa.binary())],
                ["doc_id", "n_tokens", f"tokens_at_{prefix}", *(f"fits_{b}" for b in budgets), "prefix_deltas"],
            )

    schema = f"doc_id {id_type(docs)}, n_tokens long, tokens_at_{prefix} long, " + "".join(f"fits_{b} long, " for b in budgets) + "prefix_deltas binary"
    return docs.selectExpr("doc_id", f"cast(`{text}` as string) text").mapInArrow(run, schema)


_totals: dict[int, ChunkCache] = {}


def total_of(vocabulary: bytes) -> ChunkCache:
    """A worker's cache of whole-chunk token counts, for totals alone."""
    key = hash(vocabulary)
    if key not in _totals:
        encode = chunk_encoder(vocabulary)
        _totals[key] = ChunkCache(lambda chunk: len(encode(chunk)))
    return _totals[key]
