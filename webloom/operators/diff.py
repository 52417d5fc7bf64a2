"""Differences between two tokenizations of one row."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import with_columns


def glued(tokens: list[str]) -> list[str]:
    """Continuations joined to what they continue."""
    out: list[str] = []
    for t in tokens:
        if t.startswith("##"):
            if not out:
                raise ValueError("a change begins with a continuation")
            out[-1] += t[2:]
        else:
            out.append(t)
    return out


def _back(x: list[str], x0: int, y: list[str], y0: int, y1: int) -> tuple[int, int]:
    """Moves ``x0`` to the beginning of its word, and ``y0`` along unless ``y``'s side is empty."""
    while 0 < x0 < len(x) and x[x0].startswith("##"):
        x0 -= 1
        if y0 != y1:
            y0 = max(y0 - 1, 0)
            if x[x0] != y[y0]:
                raise ValueError("the two sides differ before the change")
    return x0, y0


def changes(a: list[str], b: list[str]) -> list[dict[str, str | None]]:
    """``op, a, b`` for each change from ``a`` to ``b``, in words; None for an empty side."""
    out = []
    for op, a0, a1, b0, b1 in SequenceMatcher(a=a, b=b).get_opcodes():
        if op != "equal":
            a0, b0 = _back(a, a0, b, b0, b1)
            b0, a0 = _back(b, b0, a, a0, a1)
            sides = [" ".join(glued(x)) if x else None for x in (a[a0:a1], b[b0:b1])]
            out.append({"op": op, "a": sides[0], "b": sides[1]})
    return out


def diff(df: DataFrame, saved: str = "tokenized", new: str = "new_tokenized", key: str = "source_index") -> DataFrame:
    """``key, place, op, a, b, error``: rows that are equal have none; a row whose change
    can't be cut at words has its error instead."""
    changed = df.where(~F.col(saved).eqNullSafe(F.col(new)))

    def run(left, right):
        rows, errors = [], []
        for a, b in zip(left, right):
            try:
                rows.append(changes(a or [], b or []))
                errors.append(None)
            except ValueError as e:
                rows.append([{"op": "error", "a": None, "b": None}])
                errors.append(str(e))
        return [rows, errors]

    made = with_columns(changed.select(key, saved, new), [saved, new], run, "changes array<struct<op: string, a: string, b: string>>, error string")
    return made.select(key, F.posexplode("changes").alias("place", "change"), "error").select(key, "place", "change.op", "change.a", "change.b", "error")


def diff_lines(df: DataFrame, key: str = "source_index") -> DataFrame:
    """``key, place, at, line``: coloured lines, each row's name before its first change;
    ``at`` orders a change's lines."""
    colour = lambda code, text: F.concat(F.lit(f"\x1b[{code}m"), text, F.lit("\x1b[0m"))
    head = F.when(F.col("place") == 0, colour("38;5;220", F.concat(F.col(key).cast("string"), F.lit(":"))))
    minus = colour("31", F.concat(F.lit("-"), F.col("a")))
    plus = colour("32", F.concat(F.lit("+"), F.col("b")))
    lines = F.filter(F.array(head, minus, plus), lambda x: x.isNotNull())
    return df.select(key, "place", F.posexplode(lines).alias("at", "line"))
