"""Operators without SQL, and the pipeline, against plain Python on small data."""

import random
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import base, langid, line_dedup, minhash, mixing, packing, simhash
from webloom.llm.words import WORD, digests

VOCABULARY = base.vocabulary_bytes()
ENCODING = tiktoken.Encoding("brute", pat_str=base.PATTERN, mergeable_ranks=base.ranks_of(VOCABULARY), special_tokens={})
FILLED = "doc_id long, text string, lang string, source string, n_chars long"


def groups_of(edges):
    """The least of its group for every id that isn't the least, by union-find."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root) if find(x) != x}


def near_by_brute_force(rows):
    """``later: kept`` by comparing all pairs that share a band."""
    words, bands = {}, defaultdict(list)
    for i, text in rows:
        found = digests.of(text or "")[:, 0].astype(np.uint64)
        if len(found):
            m = minhash.minima(minhash.shingles(found))
            words[i] = m & 3
            for band in range(0, minhash.PERMUTATIONS, minhash.ROWS):
                bands[band, m[band : band + minhash.ROWS].tobytes()].append(i)
    pairs = {p for bucket in bands.values() for p in combinations(sorted(bucket), 2)}
    c = 2.0**-minhash.BITS
    return groups_of((a, b) for a, b in pairs if ((words[a] == words[b]).mean() - c) / (1 - c) >= minhash.THRESHOLD)


def exact_jaccard(a, b):
    one, two = ({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (WORD.findall(x.lower()) for x in (a, b)))
    return len(one & two) / len(one | two)


def test_buckets_in_cells_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    shared = rng.choices(words, k=60)
    # documents that share a passage, so that bands have several roots, and some copies of each
    rows = [(i, " ".join(shared + rng.choices(words, k=rng.choice([20, 60, 90])))) for i in range(80)]
    rows += [(100 + i, rows[rng.randrange(80)][1] + " more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_by_brute_force(rows)
    for cell in (minhash.CELL, 3):
        monkeypatch.setattr(minhash, "CELL", cell)
        assert {r["doc_id_b"]: r["doc_id_a"] for r in minhash.near_duplicates(docs).collect()} == want


def test_near_duplicates_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = minhash.near_duplicates(docs).collect()
    assert {r["doc_id_b"]: r["doc_id_a"] for r in found} == near_by_brute_force(rows)
    texts = dict(rows)
    root = {r["doc_id_b"]: r["doc_id_a"] for r in found}
    pairs = {(a, b): exact_jaccard(texts[a], texts[b]) for a, b in combinations(sorted(i for i, t in rows if t and WORD.search(t)), 2)}
    assert all(root.get(a, a) == root.get(b, b) for (a, b), j in pairs.items() if j >= 0.6)
    close = {i for (a, b), j in pairs.items() if j >= 0.2 for i in (a, b)}
    assert {*root, *root.values()} <= close
    for r in found:
        j = exact_jaccard(texts[r["doc_id_a"]], texts[r["doc_id_b"]])
        assert abs(r["similarity"] - j) < 0.2


@lru_cache(None)
def fewest(pieces, capacity):
    """Sequences that the pieces (sorted, greatest first) need, by trying all ways to fill one."""
    if not pieces:
        return 0
    best, first, rest = len(pieces), pieces[0], pieces[1:]
    for n in range(len(rest) + 1):
        for chosen in set(combinations(rest, n)):
            if first + sum(chosen) <= capacity:
                left = list(rest)
                for x in chosen:
                    left.remove(x)
                best = min(best, 1 + fewest(tuple(left), capacity))
    return best


def test_packing_against_all_ways():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randint(6, 14)
        pieces = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        patterns = packing.plan(Counter(pieces), capacity)
        assert sum((Counter({s: a * n for s, a in p.items()}) for p, n in patterns), Counter()) == Counter(pieces)
        assert all(sum(s * a for s, a in p.items()) <= capacity for p, _ in patterns)
        assert sum(n for _, n in patterns) <= fewest(tuple(pieces), capacity) + 1


def test_packing_against_the_linear_program():
    rng = random.Random(6)
    for capacity in (32, 64):
        histogram = {s: rng.randint(1, 5000) for s in range(1, capacity + 1)}
        sizes = np.arange(1, capacity + 1)
        demand = np.array([histogram[s] for s in sizes], float)
        _, use = packing.fractional(sizes, demand, capacity)
        bins = sum(n for _, n in packing.plan(histogram, capacity))
        assert max(sizes @ demand / capacity, 0) <= bins <= 1.001 * use.sum() + 3


def test_ranks_in_parts_place_pieces_as_ranks_in_one(spark, monkeypatch):
    rng = random.Random(7)
    lengths = spark.createDataFrame([(i, rng.randint(0, 900)) for i in range(3000)], "doc_id long, n_tokens long")
    docs = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    whole = sorted(map(tuple, packing.pack(docs, capacity=512, lengths=lengths).collect()))
    monkeypatch.setattr(packing, "RANK_ROWS", 5)
    for bound in (packing.BROADCAST_PARTS, 0):
        monkeypatch.setattr(packing, "BROADCAST_PARTS", bound)
        assert sorted(map(tuple, packing.pack(docs, capacity=512, lengths=lengths).collect())) == whole


def test_fingerprints_and_neighbours_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    prints = {}
    for r in docs.collect():
        counts = Counter(WORD.findall((r["text"] or "").lower()))
        votes, total = [0] * 64, 0
        for word, n in counts.items():
            h, w = int(digests.of(word)[0, 0]), n.bit_length()
            total += w
            for bit in range(64):
                votes[bit] += w * (h >> bit & 1)
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * votes[b] > total) if counts else None
    least = {}
    for i, f in sorted(prints.items()):
        if f is not None:
            least.setdefault(f, i)
    assert simhash.blocks_for(10**5, 6) == 9 and simhash.blocks_for(10**9, 6) == 10 and simhash.blocks_for(10**10, 6) == 11
    for r in [*simhash.simhash(docs).collect(), *simhash.simhash(docs, blocks=8).collect()]:
        f = prints[r["doc_id"]]
        assert (None if r["fingerprint"] is None else r["fingerprint"] % (1 << 64)) == f
        assert r["near_doc_ids"] == ([] if f is None else sorted(i for g, i in least.items() if i != r["doc_id"] and (f ^ g).bit_count() <= simhash.RADIUS))


def pipeline_by_brute_force(sf):
    """The documents that go into packing."""
    con = duckdb.connect()
    con.execute(f"create table documents as select doc_id, text, lang, source, n_chars from read_parquet('{sf}/documents.parquet')")

    def now(sql):
        con.execute(f"create or replace table next as {sql}")
        con.execute("create or replace table documents as select doc_id, text, lang, source, n_chars from next")

    now(f"select d.* from documents d join ({langid.LANGID_SQL}) l using (doc_id) where lang_accepted")
    now(f"select * from ({line_dedup.LINES_SQL}) where n_dropped = 0 or n_dropped < n_lines")
    gone = near_by_brute_force(con.execute("select doc_id, text from documents").fetchall())
    now(f"select * from documents where doc_id not in ({','.join(map(str, gone)) or 'null'})")
    con.execute("create table lengths (doc_id bigint, tokens bigint)")
    con.executemany("insert into lengths values (?, ?)", [(i, len(ENCODING.encode_ordinary(t))) for i, t in con.execute("select doc_id, text from documents").fetchall()])
    now(mixing.MIX_SQL.replace("len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS tokens FROM documents)", "tokens FROM documents JOIN lengths USING (doc_id))"))
    return con.execute("select doc_id, text from documents").fetchall()


def test_pipeline_against_brute_force(spark, sf):
    docs = pipeline_by_brute_force(sf)
    rows = corpus_pipeline.run(spark, sf).collect()
    want = Counter()
    for i, text in docs:
        n = len(ENCODING.encode_ordinary(text or ""))
        want.update((i, piece, min(packing.CAPACITY, n - piece * packing.CAPACITY)) for piece in range(-(-n // packing.CAPACITY)))
    assert want and Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append((r["start"], r["start"] + r["n_tokens"]))
    for spans in bins.values():
        spans.sort()
        assert spans[-1][1] <= packing.CAPACITY and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert len(bins) == max(bins) + 1


# what each case gives, in each operator and stage


def cases(spark):
    """A null and an empty text, blanks, a null source, repeated rows, ties, and clashing columns."""
    prose = "the quick brown fox jumps over the lazy dog while many other words follow in this line of text"
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (4, prose, "en", "a", len(prose)), (4, prose, "en", "a", len(prose)), (5, prose, "en", None, len(prose)), (None, prose + " too", "en", "b", None)]
    return spark.createDataFrame(rows, FILLED).withColumn("N_PII", F.lit("x")).withColumn("n_dropped", F.lit("x")).withColumn("key", F.lit("x")), prose


def test_defined_values_of_odd_rows(spark):
    from webloom.llm import pii, token_counts, token_store

    docs, prose = cases(spark)
    n = len(ENCODING.encode_ordinary(prose))
    found = {r["doc_id"]: r for r in token_counts.prefix_token_counts(docs).collect()}
    assert found[1]["n_tokens"] is None and found[1]["prefix_deltas"] is None and found[2]["n_tokens"] == 0 and found[2]["prefix_deltas"] == b"" and found[4]["n_tokens"] == n and found[4]["fits_512"] == len(prose)
    found = [(r["doc_id"], r["text"], r["n_pii"]) for r in pii.pseudonymised(docs).collect()]
    assert Counter(found) == Counter([(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, prose, 0), (4, prose, 0), (5, prose, 0), (None, prose + " too", 0)])
    store = token_store.token_store(docs).where("kind = 'recipe'").collect()
    assert Counter((r["doc_id"], r["n"]) for r in store) == Counter([(1, None), (2, 0), (3, 3), (4, n), (4, n), (5, n), (None, n + 1)])
    lines = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.deduplicated(docs).collect())
    assert lines == Counter([(1, None, 0, 0), (2, "", 0, 0), (3, " \n\t", 0, 0), (4, prose, 1, 0), (4, prose, 1, 0), (5, "", 1, 1), (None, prose + " too", 1, 0)])
    prints = {r["doc_id"]: r for r in simhash.simhash(docs).collect()}
    assert prints[1]["fingerprint"] is None and prints[1]["near_doc_ids"] == [] and prints[3]["fingerprint"] is None and prints[4]["near_doc_ids"] == [] and prints[5]["near_doc_ids"] == [4] and prints[None]["fingerprint"] is not None
    mixed = Counter((r["doc_id"], r["copy"]) for r in mixing.mix_sources(docs, {"a": 1.0, "b": 1.0}).collect())
    assert (5, 1) not in mixed and (3, 1) not in mixed and mixed[(4, 1)] in (0, 2) and mixed[(None, 1)] == 1
    packed = Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in packing.pack(docs).collect())
    assert packed == Counter([(3, 0, 3), (4, 0, n), (4, 0, n), (5, 0, n), (None, 0, n + 1)])
    near = [(r["doc_id_a"], r["doc_id_b"]) for r in minhash.near_duplicates(docs).collect()]
    assert near == [(4, 5)]
    left = Counter((r["doc_id"], r["text"]) for r in minhash.without_near_duplicates(docs).collect())
    assert left == Counter([(1, None), (2, ""), (3, " \n\t"), (4, prose), (None, prose + " too")])
    langs = {r["doc_id"]: r for r in langid.identified(docs, least=1).collect()}
    assert langs[1]["detected_lang"] is None and not langs[1]["lang_accepted"] and not langs[2]["lang_accepted"] and not langs[3]["lang_accepted"] and langs[4]["detected_lang"] == "en" and langs[4]["lang_accepted"]
    assert not any(r["lang_accepted"] for r in langid.identified(docs.limit(3), least=100).collect())


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    docs = spark.createDataFrame([(1, "a b c", "en", "a", 5)], FILLED)
    before = list(base._left)
    with base.scratch(spark):
        folder = base.shared_folder(spark)
        assert packing.pack(docs).count() == 1
        made = [p for p in base._left if p not in before]
        assert made and all(p.startswith(folder) for p in made)
    assert base._left == before and not any(os.path.exists(p) for p in made)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        base.shared_folder(Session())
