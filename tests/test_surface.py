"""The commands, the plug-in, and the rules that exist both as Python and as columns."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from webloom import cli, plugin
from webloom.functions import blobs
from webloom.functions import columns as C
from webloom.functions.html import snapshot_of
from webloom.functions.splitter import Splitter
from webloom.operators import diff
from webloom.sources import sinks


def page(body: str) -> dict:
    return snapshot_of(f"<!DOCTYPE html><html><body>{body}</body></html>", "http://x.test/")


@pytest.fixture
def dataset(tmp_path):
    folder = tmp_path / "data/split=train"
    folder.mkdir(parents=True)
    rows = [{"source_index": i, "displayed_url": "u", "dom_snapshot": page(f"<p>{'lower word ' * (4 - i)}</p>")} for i in range(4)]
    (folder / "part.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(tmp_path / "data")


def test_commands(spark, dataset, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    cli.main(["train", dataset, "-n", "120"])
    folder = str(tmp_path / "webloom-tokens-120")
    out = capsys.readouterr().out
    assert f"Output directory: {folder}" in out and "Generating up to 120 tokens from 4 examples:" in out and os.path.isdir(folder)
    cli.main(["dump", dataset, folder])
    lines = capsys.readouterr().out.splitlines()
    dumped = [json.loads(x) for x in lines]
    assert [r["source_index"] for r in dumped] == [3, 2, 1, 0] and dumped[0]["dom_snapshot"] == page("<p>lower word </p>")
    (tmp_path / "dumped.json").write_text("\n".join(lines) + "\n")
    cli.main(["compare", str(tmp_path / "dumped.json"), folder])
    assert capsys.readouterr().out == ""
    dumped[1]["tokenized"].remove("word")
    (tmp_path / "other.json").write_text("".join(json.dumps(r) + "\n" for r in dumped))
    cli.main(["compare", str(tmp_path / "other.json"), folder])
    assert capsys.readouterr().out == "\x1b[38;5;220m2:\x1b[0m\n\x1b[32m+word\x1b[0m\n"
    cli.main(["breaking", dataset, "-o", str(tmp_path / "none.parquet")])
    assert capsys.readouterr().out == "Got 0 breaking inputs\n" and not os.path.exists(tmp_path / "none.parquet")
    with open(f"{dataset}/split=train/part.json", "a") as f:
        f.write(json.dumps({"source_index": 9, "displayed_url": "u", "dom_snapshot": {"strings": [], "documents": []}}) + "\n")
    cli.main(["breaking", dataset, "-o", str(tmp_path / "some.parquet")])
    assert capsys.readouterr().out == "Got 1 breaking input\n" and [r[0] for r in spark.read.parquet(str(tmp_path / "some.parquet")).select("source_index").collect()] == [9]


def test_profile_command(dataset, tmp_path, capsys):
    stats = str(tmp_path / "x.prof")
    cli.main(["profile", dataset, "-o", stats, "--cache", str(tmp_path)])
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 7 and out[0].startswith("example   1:") and "pre-tokens" in out[0] and out[5].startswith("4 examples processed in ") and os.path.exists(stats)


def made_tokenizer(normalizer=None):
    from tokenizers import Tokenizer, models

    backend = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    if normalizer:
        backend.normalizer = normalizer
    return type("Holder", (), {"backend_tokenizer": backend})()


def test_plugin_gives_tokens_and_spares_special_ones():
    from tokenizers import NormalizedString, PreTokenizedString, normalizers

    tokenizer = made_tokenizer(normalizers.Lowercase())
    bound = plugin.SnapshotTokens.plug_into(tokenizer)
    serialized = json.dumps(page(f"<b>Big {'x' * 40}</b>"))
    text = PreTokenizedString(serialized)
    bound.pre_tokenize(text)
    got = [t[0] for t in text.get_splits()]
    assert got == "<!doctype html > < html > < body > < b > big [LONG] alphabetic </ b > </ body > </ html >".split(" ")
    assert bound.special_tokens == {"[BASE64]", "[LONG]"} and NormalizedString("x") is not None
    plain = plugin.TextTokens()
    assert plain.tokens("a&nbsp;b") == ["a", "b"]


def test_plugin_guards():
    tokenizer = made_tokenizer()
    bound = plugin.SnapshotTokens.plug_into(tokenizer)
    with pytest.raises(RuntimeError):
        bound.bind(made_tokenizer())
    with pytest.raises(RuntimeError):
        plugin.TextTokens().bind(tokenizer)
    with pytest.raises(TypeError):
        plugin.TextTokens().bind(object())
    with pytest.raises(TypeError):
        plugin.Tokens()


def test_columns_agree_with_the_splitter(spark):
    rng, splitter = random.Random(3), Splitter()
    texts = ["".join(rng.choices(rng.choice(["abcXYZ019", "0123456789abcdef", "0123456789", "aZ9_é", "AbcdEFGH0123456789xyzklm"]), k=rng.choice([3, 5, 7, 8, 9, 12, 20, 31, 33, 40]))) for _ in range(1500)]
    texts += ["0x12ab", "0x12abcdef==", "deadbeef", "12345678", "é" * 33, "1" * 33]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", C.skew(F.col("t")).alias("skew"), C.is_base64_like(F.col("t")).alias("like"), C.long_class(F.col("t")).alias("long"), C.phi(F.col("t")).alias("phi"), C.prefixed_hex(F.col("t")).alias("hex"), C.is_void(F.col("t")).alias("void")).collect()
    for r in got:
        t = r["t"]
        skew = blobs.skew(t)
        assert (r["skew"] is None) == (skew is None) and (skew is None or abs(r["skew"] - skew) < 1e-12)
        finished = list(splitter._finished([t]))
        # hexadecimal numbers come first, then what looks like base64, then other long runs
        if r["long"] and ("digits" in r["long"] or not r["like"]):
            assert finished == ["[LONG]", *r["long"].split(" ")], t
        else:
            assert finished == (["[BASE64]"] if r["like"] else [t]), t
        n = len(t)
        if n < 85 and t.isascii():
            assert (r["phi"] > 2 * n * (n - 1) / 64) == blobs.looks_monoalphabetic(t)
        if r["hex"] is not None:
            assert splitter.items(t) == r["hex"]


def test_lines_out_are_made_when_there_is_something_to_say(tmp_path):
    with sinks.LinesOut(str(tmp_path / "none.jsonl")):
        pass
    assert not os.path.exists(tmp_path / "none.jsonl")
    for _ in range(2):
        with sinks.LinesOut(str(tmp_path / "a.jsonl")) as out:
            out.add({"a": 1, "b": "é"})
    assert [json.loads(x) for x in open(tmp_path / "a.jsonl")] == [{"a": 1, "b": "é"}] * 2
    stamped = sinks.LinesOut(stem=str(tmp_path / "s"), stamped=True)
    assert stamped.path.startswith(str(tmp_path / "s-2")) and stamped.path.endswith(".jsonl")


def test_save_directory(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    want = sinks.save_directory(314_159)
    assert want == str(tmp_path / "webloom-tokens-314k")
    os.mkdir(want)
    monkeypatch.chdir(want)
    assert sinks.save_directory(314_159) == want


@pytest.mark.parametrize("a, b", [(["x", "##y"], ["##y"]), (["p", "##q"], ["z", "##q", "##r"])])
def test_changes_that_cannot_be_cut_at_words(a, b):
    try:
        assert all(c["op"] in ("replace", "insert", "delete") for c in diff.changes(a, b))
    except ValueError as e:
        assert "change" in str(e) or "sides" in str(e)


def test_published_vocabularies(spark, tmp_path):
    from tokenizers import Tokenizer, models, normalizers

    from webloom.operators import vocabulary

    backend = Tokenizer(models.WordPiece({"[UNK]": 0, "low": 1, "##er": 2}, unk_token="[UNK]"))
    backend.normalizer = normalizers.BertNormalizer(lowercase=True)
    backend.save(str(tmp_path / "t.json"))
    tokens, meta = vocabulary.load_published(str(tmp_path / "t.json"))
    assert tokens == ["[UNK]", "low", "##er"] and meta["lower"]
    (tmp_path / "vocab.txt").write_text("[UNK]\nLow\n##er\n")
    cased, meta = vocabulary.load_published(str(tmp_path / "vocab.txt"))
    assert cased == ["[UNK]", "Low", "##er"] and not meta["lower"]
    rows = spark.createDataFrame([(["Lower", "[LONG]", "x"],), (None,)], "tokens array<string>")
    assert [r["tokenized"] for r in vocabulary.encode(rows, tokens).collect()] == [["low", "##er", "[LONG]", "[UNK]"], None]
    assert [r["tokenized"] for r in vocabulary.encode(rows, cased, lower=False).collect()][0] == ["Low", "##er", "[LONG]", "[UNK]"]
    with pytest.raises(ValueError):
        (tmp_path / "u.json").write_text(json.dumps({"model": {"type": "BPE", "vocab": {}}}))
        vocabulary.load_published(str(tmp_path / "u.json"))


def test_a_normalizer_of_ones_own(spark):
    from webloom.operators.tokenize import normalized

    rows = spark.createDataFrame([(["Ab", "[LONG]"],)], "tokens array<string>")
    assert rows.select(normalized(F.col("tokens"), normalize=F.upper)).first()[0] == ["AB", "[LONG]"]
    assert rows.select(normalized(F.col("tokens"), lower=False)).first()[0] == ["Ab", "[LONG]"]
