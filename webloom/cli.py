"""Commands: train, dump, compare, breaking, profile. Each is a Spark job over a data set."""

from __future__ import annotations

import argparse
import cProfile
import json
import os
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .functions.dom import tokenized
from .functions.splitter import Splitter
from .operators import diff, vocabulary
from .plans import jobs
from .sources import sinks, snapshots

CACHE = "~/.cache/webloom"


def session() -> SparkSession:
    return SparkSession.builder.appName("webloom").getOrCreate()


def _data(spark: SparkSession, args: argparse.Namespace):
    return snapshots.read_snapshots(spark, args.dataset, args.format, args.split)


def train(args: argparse.Namespace) -> None:
    """Trains a vocabulary and saves it."""
    spark, folder = session(), args.output or sinks.save_directory(args.size)
    if args.output is None:
        print(f"Output directory: {folder}\n")
    rows = _data(spark, args)
    if args.base:
        base = (vocabulary.load_published(args.base) if os.path.isfile(args.base) else vocabulary.load(spark, args.base))[1]
    else:
        base = {"lower": not args.cased}
    print(jobs.corpus_message(args.size, args.examples or jobs.corpus_size(rows)))
    made = jobs.train_vocabulary(rows, args.size, lower=base["lower"])
    vocabulary.save(spark, made, folder, base["lower"])
    print(f"{len(made):,} tokens saved")


def dump(args: argparse.Namespace) -> None:
    """Tokenizations of a data set, shortest snapshot first: to a folder, or printed."""
    spark = session()
    made, meta = vocabulary.load(spark, args.tokenizer)
    rows = jobs.dump(_data(spark, args), made, meta["lower"])
    if args.output:
        sinks.write_json_lines(rows, args.output, "errorifexists")
        return
    for row in rows.toLocalIterator():
        print(json.dumps({"source_index": row["source_index"], "dom_snapshot": json.loads(row["dom_snapshot"]), "tokenized": row["tokenized"]}, separators=(",", ":")))


def compare(args: argparse.Namespace) -> None:
    """Lines that tell where saved tokenizations differ from a tokenizer's."""
    spark = session()
    made, meta = vocabulary.load(spark, args.tokenizer)
    saved = spark.read.schema(f"{snapshots.ROW}, tokenized array<string>").json(args.dumped)
    changed = jobs.compare(saved, made, meta["lower"])
    lines = diff.diff_lines(changed.where("error is null")).orderBy("source_index", "place", "at")
    for row in lines.toLocalIterator():
        print(row["line"])
    bad = changed.where("error is not null").select("source_index", "error").first()
    if bad is not None:
        sys.exit(f"source {bad['source_index']}: {bad['error']}")


def breaking(args: argparse.Namespace) -> None:
    """The rows of a data set that can't be tokenized, as Parquet."""
    n = sinks.write_if_any(jobs.breaking(_data(session(), args)), args.output)
    print(jobs.breaking_message(n))


def profile(args: argparse.Namespace) -> None:
    """Tokens and time of each snapshot, in this process and under a profiler."""
    spark, splitter, total, n = session(), Splitter(), 0.0, 0
    lines = snapshots.cached_lines(spark, args.dataset, args.cache, args.split, args.format)
    profiler = cProfile.Profile()
    for n, row in enumerate(lines.toLocalIterator(), 1):
        began = time.perf_counter()
        tokens = profiler.runcall(tokenized, row["dom_snapshot"], splitter)
        took = time.perf_counter() - began
        total += took
        print(jobs.profile_line(n, len(row["dom_snapshot"]), len(tokens), took))
    print(f"--\n{n} examples processed in {total:.2f} seconds")
    profiler.dump_stats(args.output)
    print(f'Now run "python -m pstats {args.output}"')


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="webloom", description="Tokens of web snapshots, on Spark.")
    commands = top.add_subparsers(required=True, dest="command")

    def command(run, dataset: bool = True) -> argparse.ArgumentParser:
        new = commands.add_parser(run.__name__, help=run.__doc__)
        new.set_defaults(run=run)
        if dataset:
            new.add_argument("dataset", help="folder or file of snapshots")
            new.add_argument("-s", "--split", default="train", help="folder split=NAME of the data set, if there is one")
            new.add_argument("--format", default="json", choices=("json", "parquet"))
        return new

    new = command(train)
    new.add_argument("--base", help="saved or published tokenizer whose normalization is taken over")
    new.add_argument("--cased", action="store_true", help="keep capitals")
    new.add_argument("-N", "--examples", type=int, help="size of the data set, if known")
    new.add_argument("-n", "--size", type=int, default=vocabulary.DEFAULT_SIZE, help="tokens, with special ones and the alphabet")
    new.add_argument("-o", "--output", help="folder to save in; by default named after the size")
    new = command(dump)
    new.add_argument("tokenizer", help="folder of a saved tokenizer")
    new.add_argument("-o", "--output", help="folder for the lines, instead of printing them")
    new = command(compare, dataset=False)
    new.add_argument("dumped", help="lines of a dump")
    new.add_argument("tokenizer", help="folder of a saved tokenizer")
    new = command(breaking)
    new.add_argument("-o", "--output", default="breaking-inputs.parquet")
    new = command(profile)
    new.add_argument("-o", "--output", default="webloom.prof", help="file of the profiler")
    new.add_argument("--cache", default=CACHE, help="folder for the cache of lines")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(args)


def _alone(name: str):
    """An entry point for one command."""

    def run() -> None:
        main([name, *sys.argv[1:]])

    return run


train_main, dump_main, compare_main, breaking_main, profile_main = map(_alone, ("train", "dump", "compare", "breaking", "profile"))

if __name__ == "__main__":
    main()
