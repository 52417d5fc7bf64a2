"""Tokens of snapshots, pages and texts: one crossing to Python for each batch of rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dom import tokenized, walk
from ..functions.html import snapshot_of
from ..functions.splitter import Splitter
from .arrow import with_columns

_splitters: dict[tuple[str, str], Splitter] = {}


def splitter_of(base64_token: str = "[BASE64]", long_token: str = "[LONG]") -> Splitter:
    """A worker's splitter, which keeps what it has split."""
    key = base64_token, long_token
    if key not in _splitters:
        _splitters[key] = Splitter(*key)
    return _splitters[key]


def _guarded(values, one: Callable) -> list[list]:
    tokens, errors = [], []
    for value in values:
        try:
            tokens.append(None if value is None else one(value))
            errors.append(None)
        except Exception as e:  # any failure marks the row as breaking
            tokens.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return [tokens, errors]


def split_texts(df: DataFrame, text: str = "text", mode: str = "full", **special: str) -> DataFrame:
    """``df`` and ``tokens``; a null text has null tokens."""
    return with_columns(df, [text], lambda texts: [[None if t is None else splitter_of(**special).split(t, mode) for t in texts]], "tokens array<string>")


def tokenize_snapshots(df: DataFrame, snapshot: str = "dom_snapshot", close_all: bool = False, **special: str) -> DataFrame:
    """``df`` with ``tokens`` and ``error``: rows that can't be tokenized say why instead of
    failing the job. The snapshot is serialized JSON or a struct."""
    text = snapshot
    if df.schema[snapshot].dataType.typeName() != "string":
        text = "serialized_snapshot"
        df = df.withColumn(text, F.to_json(snapshot))
    made = with_columns(df, [text], lambda rows: _guarded(rows, lambda s: tokenized(s, splitter_of(**special), close_all)), "tokens array<string>, error string")
    return made if text == snapshot else made.drop(text)


def tokenize_pages(df: DataFrame, html: str = "html", url: str = "url", **special: str) -> DataFrame:
    """``df`` with ``tokens`` and ``error`` for HTML source, by way of a snapshot of it."""

    def run(pages, urls):
        return _guarded(zip(pages, urls), lambda p: None if p[0] is None else walk(snapshot_of(p[0], p[1] or ""), splitter_of(**special).split))

    return with_columns(df, [html, url], run, "tokens array<string>, error string")


def snapshots_of_pages(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``df`` with ``dom_snapshot``, the serialized snapshot of each page."""
    return with_columns(df, [html, url], lambda pages, urls: [[None if p is None else json.dumps(snapshot_of(p, u or ""), separators=(",", ":")) for p, u in zip(pages, urls)]], "dom_snapshot string")


def normalized(tokens: Column, special: tuple[str, ...] = ("[BASE64]", "[LONG]"), lower: bool = True, normalize: Callable[[Column], Column] | None = None) -> Column:
    """Tokens as the base model wants them, lower-cased or by an expression of its own; special
    ones stay as they are."""
    change = normalize or (F.lower if lower else None)
    return F.transform(tokens, lambda t: normalized_token(t, special, change)) if change else tokens


def normalized_token(token: Column, special: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    return F.when(token.isin(*special), token).otherwise(change(token))


def resplit_text(tokens: Column) -> Column:
    """Training text: tokens cut at white space once more and joined by spaces."""
    return F.array_join(F.filter(F.split(F.array_join(tokens, " "), r"[\s\p{Z}\x1c-\x1f\x85]+"), lambda t: t != ""), " ")
