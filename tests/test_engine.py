import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from webloom import queries
from webloom.functions.dom import BreakingInput, walk
from webloom.functions.html import snapshot_of
from webloom.functions.splitter import Splitter
from webloom.operators import diff, nodes, tokenize, vocabulary
from webloom.plans import jobs
from webloom.sources import sinks, snapshots
from webloom.streaming import tokens as streaming

SPLITTER = Splitter()


@pytest.mark.parametrize("letter", list('bfnrtv0"'))
def test_script_escapes_are_boundaries(letter):
    assert SPLITTER.split(f"left\\{letter}right") == ["left", "right"]


@pytest.mark.parametrize(
    "text,want",
    {
        r"it\x27s": "it's",
        r"Abc": "Abc",
        "a&apos;b": "a'b",
        "a&nbsp;b": "a b",
        "a%20b %C3%A9t%C3%A9": "a b ete",
        "100% sure": "100 sure",
        "café": "cafe",
        "snake_case": "snake case",
        "0xdeadbeef": "0x [LONG] hex digits",
        "12345678901": "[LONG] digits",
        "x" * 40: "[LONG] alphabetic",
        "iVBORw0KGgoAAAANSUhEUgAAAAUA": "[BASE64] png",
        "eyJhIjogMSwgImIiOiBbMSwgMl19": "[BASE64] json",
        "": "",
    }.items(),
)
def test_splitting(text, want):
    assert " ".join(SPLITTER.split(text)) == want


def test_escapes_at_the_end_and_empty_items():
    assert SPLITTER.split("word\\") == ["word"]
    assert SPLITTER.split("_ \\_ z") == ["z"]


def page(body: str) -> dict:
    return snapshot_of(f"<!DOCTYPE html><html><head></head><body>{body}</body></html>", "http://x.test/")


def test_walk_closes_all_but_void_elements():
    got = walk(page("<p class=a>one<br>two</p>"), SPLITTER.split)
    assert " ".join(got) == "<!DOCTYPE html > < html > < head > </ head > < body > < p _ class = a > one < br > two </ p > </ body > </ html >"


def test_a_response_is_unwrapped():
    assert walk({"id": 1, "result": page("x")}, SPLITTER.split) == walk(page("x"), SPLITTER.split)


def test_only_the_last_document_is_closed_at_the_end():
    one = page("x")
    two = {"strings": one["strings"], "documents": one["documents"] * 2}
    assert walk(two, SPLITTER.split).count("</") == walk(one, SPLITTER.split).count("</") * 2 - 2
    assert walk(two, SPLITTER.split, close_all=True).count("</") == walk(one, SPLITTER.split).count("</") * 2


def test_breaking_snapshots():
    broken = page("x")
    broken["documents"][0]["nodes"]["parentIndex"][-1] = 99
    for snapshot in (broken, {"strings": [], "documents": []}):
        with pytest.raises(BreakingInput):
            walk(snapshot, SPLITTER.split)


def test_relational_and_row_wise_forms_agree(spark, sf):
    rows = tokenize.snapshots_of_pages(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "dom_snapshot")
    one = {r[0]: r[1] for r in tokenize.tokenize_snapshots(rows).select("page_id", "tokens").collect()}
    assert one == {r[0]: r[1] for r in nodes.linearized(nodes.parsed(rows), "page_id").collect()}


def test_subtree_ends_against_search():
    rng = random.Random(5)
    for _ in range(200):
        parents, path = [], []
        for i in range(rng.randint(0, 30)):
            path = path[: rng.randint(0, len(path))]
            parents.append(path[-1] if path else -1)
            path.append(i)
        want = [next((j for j in range(i + 1, len(parents)) if parents[j] < i), len(parents)) for i in range(len(parents))]
        assert nodes.ends_of(parents) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(str, got[order].astype(str).values.tolist())) == sorted(map(str, want[order].astype(str).values.tolist()))


def test_changes():
    assert diff.changes(["a", "b"], ["a", "c"]) == [{"op": "replace", "a": "b", "b": "c"}]
    assert diff.changes(["a", "x", "##y"], ["a", "x", "##z"]) == [{"op": "replace", "a": "xy", "b": "xz"}]
    assert diff.changes(["a"], ["a"]) == []


def test_vocabulary_is_saved_and_used(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["low", "lower", "[LONG]"]), (2, None), (3, ["low"])], "source_index int, tokens array<string>")
    made = vocabulary.train(rows, 24)
    assert len(made) <= 24 and "low" in made
    vocabulary.save(spark, made, str(tmp_path / "v"))
    loaded, meta = vocabulary.load(spark, str(tmp_path / "v"))
    assert loaded == made and meta["lower"]
    out = {r["source_index"]: r["tokenized"] for r in vocabulary.encode(rows, made).collect()}
    assert out[2] is None and out[3] == ["low"] and "".join(out[1]).replace("##", "") == "lowlower[LONG]"


def test_training_counts_all_words_whatever_the_cap(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "KEPT_MERGES", 3)
    rng = random.Random(4)
    rows = [(["".join(rng.choices("abcaé", k=rng.randint(0, 7))) for _ in range(9)] + ["[PAD]", "aaaa"],) for _ in range(40)] + [(["zyß"],), (None,)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    whole = vocabulary.train(df, 40)
    assert "##ß" in whole and vocabulary.train(df, 40, max_words=3) == whole
    few = df.where("array_contains(tokens, 'zyß')")
    assert vocabulary.train(few, 500, max_words=0) == vocabulary.train(few, 500)


def test_jobs_sources_sinks_and_stream(spark, tmp_path):
    rows = [{"source_index": i, "displayed_url": "u", "dom_snapshot": page("word " * (3 - i))} for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    read = snapshots.read_snapshots(spark, str(tmp_path / "in"))
    made = jobs.train_vocabulary(read, 200)
    dumped = jobs.dump(read, made)
    assert [r[0] for r in dumped.select("source_index").collect()] == [2, 1, 0]
    assert jobs.compare(dumped, made).count() == 0
    assert jobs.breaking(read).count() == 0
    assert sinks.write_if_any(jobs.breaking(read), str(tmp_path / "none")) == 0
    assert not (tmp_path / "none").exists()
    for _ in range(2):
        cached = snapshots.cached_lines(spark, str(tmp_path / "in"), str(tmp_path))
        assert cached.count() == 3
    q = streaming.write_stream(streaming.stream_tokens(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    streamed = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "out")).select("source_index", "tokens").collect()}
    assert streamed == {r[0]: r[1] for r in tokenize.tokenize_snapshots(read).select("source_index", "tokens").collect()}
    total = jobs.profile_total(jobs.profile(tokenize.tokenize_snapshots(read))).first()
    assert total["examples"] == 3 and total["characters"] > 0
    assert jobs.profile_total(jobs.profile(tokenize.tokenize_snapshots(read.limit(0)))).first()["examples"] == 0


def test_a_null_or_broken_row_does_not_fail_the_job(spark):
    rows = spark.createDataFrame([(1, None), (2, "{"), (3, json.dumps(page("x")))], "source_index int, dom_snapshot string")
    out = {r["source_index"]: r for r in tokenize.tokenize_snapshots(rows).collect()}
    assert out[1]["tokens"] is None and out[1]["error"] is None
    assert out[2]["error"] and out[3]["tokens"]
    assert [r[0] for r in jobs.breaking(rows).select("source_index").collect()] == [2]
    assert rows.where(F.col("dom_snapshot").isNull()).count() == 1
