"""What keeps memory, tasks and jobs in proportion to the input, with the same results."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from webloom.operators import vocabulary


def steps_of_merging(words: dict[str, int], steps: int) -> tuple[list, int]:
    """Merges by blocks and certain merges, and how many rounds of counting they took."""
    numbers = {p: i for i, p in enumerate(sorted({p for w in words for p in vocabulary.split_word(w)}))}
    names = list(numbers)
    parts = np.array([x for w in words for x in [*(numbers[p] for p in vocabulary.split_word(w)), vocabulary.END]], np.int32)
    n, out, rounds = np.array(list(words.values()), np.int64), [], 0
    while len(out) < steps:
        rounds += 1
        found = [(int(k), names[a], names[b]) for a, b, k in zip(*vocabulary.counted_pairs(parts, n))]
        if not found:
            break
        merges = []
        for a, b in vocabulary.certain_merges(found, numbers):
            if (merged := a + b[2:]) not in numbers:
                numbers[merged] = len(names)
                names.append(merged)
            merges.append((numbers[a], numbers[b], numbers[merged]))
            out.append((a, b))
        parts = vocabulary.merged_numbers(parts, merges)
    return out, rounds


def merges_one_by_one(words: dict[str, int], steps: int) -> list:
    pieces, out = {w: vocabulary.split_word(w) for w in words}, []
    while len(out) < steps:
        pairs = Counter()
        for w, parts in pieces.items():
            for pair in zip(parts, parts[1:]):
                pairs[pair] += words[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        pieces = {w: vocabulary.merged_at(parts, best, best[0] + best[1][2:]) for w, parts in pieces.items()}
    return out


@pytest.mark.parametrize("table_kinds", [2048, 0])
def test_certain_merges_are_those_one_by_one(monkeypatch, table_kinds):
    monkeypatch.setattr(vocabulary, "TABLE_KINDS", table_kinds)
    rng, rounds, merges = random.Random(7), 0, 0
    for case in range(150):
        letters, most = rng.choice(["ab", "abc", "abcdefgh", "aé😀#"]), rng.choice([2, 9, 10**6])
        words = {"".join(rng.choices(letters, k=rng.randint(1, 9))): rng.randint(1, most) for _ in range(rng.randint(1, 60))}
        want = merges_one_by_one(words, 60)
        got, took = steps_of_merging(words, 60)
        assert got[: len(want)] == want[: len(got)] and len(got) >= len(want), case
        rounds, merges = rounds + took, merges + len(got)
    assert rounds < merges


def test_the_cluster_counts_pairs_less_often_than_it_merges(spark, monkeypatch):
    """A job for each merge took hours over the words of a large table."""
    rng = random.Random(3)
    rows = [([word := "".join(rng.choices("abcdefghijklmnopqrstuvwxyz😀", weights=range(27, 0, -1), k=rng.randint(2, 9)))] * rng.randint(1, 9),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    monkeypatch.setattr(vocabulary, "BLOCK_WORDS", 500)
    asked, real = [], vocabulary.certain_merges
    monkeypatch.setattr(vocabulary, "certain_merges", lambda *a: asked.append(1) or real(*a))
    whole = vocabulary.train(df, 140)
    assert vocabulary.train(df, 140, max_words=10) == whole
    assert 0 < len(asked) < (140 - 7 - 54) * 2 / 3


def test_tokenization_diff_trains_once(spark, sf, monkeypatch):
    """Pages were tokenized four times, and both vocabularies trained, one of them for nothing."""
    from webloom import queries
    from webloom.operators import diff, tokenize

    rows = tokenize.tokenize_pages(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "tokens").persist()
    half, whole = (vocabulary.encode(rows, vocabulary.train(rows, n)) for n in (512, 1024))
    both = half.select("page_id", half.tokenized.alias("saved")).join(whole.select("page_id", whole.tokenized.alias("new")), "page_id")
    want = sorted(map(str, diff.diff(both, "saved", "new", "page_id").collect()))
    trained, real = [], vocabulary.train
    monkeypatch.setattr(vocabulary, "train", lambda *a, **k: trained.append(1) or real(*a, **k))
    assert sorted(map(str, queries.QUERIES["tokenization_diff"](spark, sf).collect())) == want
    assert len(trained) == 1


def test_small_files_are_spread_over_tasks(spark):
    """One file of short rows was one task, however much is made of each row."""
    from webloom import crafted
    from webloom.operators.arrow import spread

    parts = spark.range(120_000).selectExpr("id p_partkey", "'t' p_type", "'n' p_name", "'b' p_brand").coalesce(1)
    assert crafted.crafted_snapshots(parts).rdd.getNumPartitions() >= 3
    assert sorted(r[0] for r in spread(parts, 1000).select("p_partkey").collect()) == list(range(120_000))
    few = spark.range(10).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == 1


def test_a_batch_is_worked_on_in_slices(spark, monkeypatch):
    """A worker held a whole batch, and what is made of it, as Python objects."""
    from webloom.operators import arrow

    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["x" * (90_000 if i % 50 == 7 else 10) for i in range(500)])], ["i", "t"])
    monkeypatch.setattr(arrow, "SLICE_BYTES", 100_000)
    parts = list(arrow.sliced(batch, [1]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(p.column(1).nbytes for p in parts) <= 100_000 and len(parts) > 5
    assert [p.num_rows for p in arrow.sliced(batch.slice(0, 0), [1])] == [0]
    df = spark.range(5000).selectExpr("id", "repeat('x', 500) t").coalesce(1)
    seen = arrow.with_columns(df, ["t"], lambda ts: [[len(ts)] * len(ts)], "n int").selectExpr("max(n)", "count(id)").first()
    assert seen[0] <= 1024 and seen[1] == 5000


def test_rows_that_are_written_if_any_are_made_once(spark, tmp_path):
    from webloom.sources import sinks

    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    assert sinks.write_if_any(spark.range(9).mapInArrow(one, "id long"), str(tmp_path / "some")) == 9
    assert made.value == 9 and spark.read.parquet(str(tmp_path / "some")).count() == 9


def test_words_are_made_once_and_by_all_tasks(spark, tmp_path):
    """Documents in one piece were one task's, whose words Spark made three times by three
    expressions; the words and their counts are the same."""
    from pyspark.sql import functions as F

    from webloom import crafted
    from webloom.operators.arrow import evened

    odd = [None, "", " ", "a" * 22, "b" * 44 + "c", "d" * 45, "é\u0000x\ty\U0001f600Z,.[\\]^_`{|}~\x7f\x80", "-/0:;<@A!\"#$%&'()*+", "x1y, z.", "￿\U0010ffff", "don't"]
    rows = spark.createDataFrame([(i, odd[i % 97] if i % 97 < len(odd) else f"w{i % 7} of Some") for i in range(60_000)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    table = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    assert table("documents").rdd.getNumPartitions() == 1
    assert crafted._letters(table).rdd.getNumPartitions() >= 8 and crafted._words(table).rdd.getNumPartitions() >= 8
    assert evened(rows.repartition(8), "doc_id").rdd.getNumPartitions() == 8 and evened(spark.range(0), "id").count() == 0

    plain = F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ,.]+", " "), "([A-Za-z]{22})", "$1 ")
    want = table("documents").select("doc_id", plain.alias("text"))
    assert crafted._letters(table).exceptAll(want).count() == 0 == want.exceptAll(crafted._letters(table)).count()
    counts = vocabulary.token_counts(crafted._words(table))
    split = want.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("token")).groupBy("token").count()
    assert sorted(counts.collect()) == sorted(split.collect())
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    nulls = spark.createDataFrame([(["a", None],), ([],), (None,), ([None],)], "tokens array<string>")
    assert {tuple(r) for r in vocabulary.token_counts(nulls).collect()} == {("a", 1), (None, 2)}


def test_training_normalizes_tokens_one_by_one(spark, sf, monkeypatch):
    """Each row's array was normalized by an expression that Spark doesn't compile, thrice."""
    from webloom import crafted

    seen, real = [], vocabulary.token_counts
    monkeypatch.setattr(vocabulary, "token_counts", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    rows = [(["The", "the", "[BASE64]", "ÉA", None, ""],), ([],), (None,), (["THE", "[LONG]", "[long]", "base"],)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    words = Counter(t if t in vocabulary.SPECIAL_TOKENS else t.lower() for (r,) in rows for t in r or () if t is not None)
    for size in (20, 60):
        assert vocabulary.train(df, size) == vocabulary.build(words.items(), size) == vocabulary.train(df, size, max_words=0)
    assert "a" not in vocabulary.train(df, 60) and "A" in vocabulary.train(spark.createDataFrame([(["AB"],)], df.schema), 60, lower=False)
    crafted.first_merge(lambda t: spark.read.parquet(f"{sf}/{t}.parquet"))
    plans = [c._jdf.queryExecution().analyzed().toString() for c in seen]
    assert len(plans) == 7 and not any("lambda" in p for p in plans)
    assert plans[-1].count("regexp_") == 1
