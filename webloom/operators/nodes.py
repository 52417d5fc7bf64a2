"""Snapshots as columns: parsed, exploded, decoded and linearized by built-in operators.

The same tokens as the row-wise walk for every snapshot that isn't breaking. Closing events
need no stack: an open node ``i`` closes just before the first later node whose parent stands
before ``i``, so sorting by (place, closings first, deepest first) gives document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMMENT, DOCTYPE, DOCUMENT, ELEMENT, RESPONSE, TEXT, VOID_TAGS
from .arrow import with_columns
from .tokenize import splitter_of

ARRAYS = ("parentIndex", "nodeType", "nodeName", "nodeValue", "attributes")


def parsed(df: DataFrame, snapshot: str = "dom_snapshot") -> DataFrame:
    """``df`` with ``strings`` and ``documents``, unwrapped from a response where neither
    is at the top."""
    row = F.from_json(snapshot, RESPONSE)
    bare = row["strings"].isNull() & row["documents"].isNull()
    return df.withColumn("strings", F.when(bare, row["result"]["strings"]).otherwise(row["strings"])).withColumn("documents", F.when(bare, row["result"]["documents"]).otherwise(row["documents"]))


def decoded(strings: Column, at: Column) -> Column:
    """The string at an index; null for a negative one."""
    return F.when(at >= 0, F.try_element_at(strings, at + 1))


def attribute_pairs(attributes: Column) -> Column:
    """``array<struct<name, value>>`` of a flat list of names and values."""
    n = F.floor(F.size(attributes) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.element_at(attributes, 2 * i + 1).alias("name"), F.element_at(attributes, 2 * i + 2).alias("value")))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<name: int, value: int>>"))


def exploded(df: DataFrame, key: str = "source_index") -> DataFrame:
    """One row for each node. The arrays are cut to the shortest of them."""
    each = df.select(key, F.posexplode("documents").alias("doc_index", "document"), F.size("documents").alias("doc_count"))
    arrays = [F.col(f"document.nodes.{a}") for a in ARRAYS]
    n = F.least(*(F.size(a) for a in arrays))
    zipped = F.arrays_zip(*(F.slice(a, F.lit(1), n).alias(name) for a, name in zip(arrays, ARRAYS)))
    return each.select(
        key, "doc_index", "doc_count", F.col("document.publicId").alias("public_id"), F.col("document.systemId").alias("system_id"), n.alias("node_count"), F.posexplode(zipped).alias("node_index", "node")
    ).select(
        key, "doc_index", "doc_count", "public_id", "system_id", "node_count", "node_index",
        F.col("node.parentIndex").alias("parent_index"), F.col("node.nodeType").alias("node_type"), F.col("node.nodeName").alias("name_index"),
        F.col("node.nodeValue").alias("value_index"), attribute_pairs(F.col("node.attributes")).alias("attrs"),
    )


def ends_of(parents: list[int]) -> list[int]:
    """For each node the first later one whose parent stands before it, or their number."""
    n, ends, open_ = len(parents), [len(parents)] * len(parents), []
    for j, parent in enumerate(parents):
        while open_ and open_[-1] > parent:
            ends[open_.pop()] = j
        open_.append(j)
    return ends


def subtree_ends(df: DataFrame, parents: str = "parents") -> DataFrame:
    """``df`` with ``ends`` for an array of parents in document order, in linear time."""
    return with_columns(df, [parents], lambda rows: [[None if p is None else ends_of(p) for p in rows]], "ends array<int>")


def _columns(df: DataFrame, key: str) -> DataFrame:
    """``key, strings, docs``: each document's arrays, cut to the shortest of them, and which
    strings are split in which mode; absent ones (negative) aren't."""

    def cut(d: Column) -> Column:
        n = F.least(*(F.size(d["nodes"][a]) for a in ARRAYS))
        parents, types, names, values, attributes = (F.slice(d["nodes"][a], F.lit(1), n) for a in ARRAYS)
        return F.struct(d["publicId"].alias("public"), d["systemId"].alias("system"), parents.alias("parents"), types.alias("types"), names.alias("names"), values.alias("values"), F.transform(attributes, attribute_pairs).alias("attrs"))

    return df.select(key, "strings", F.transform("documents", cut).alias("docs"))


def _uses(docs: str) -> dict[str, Column]:
    over = lambda pick: F.array_distinct(F.flatten(F.transform(docs, pick)))
    named = lambda d, doctype: F.filter(F.transform(d["types"], lambda t, i: F.when((t == DOCTYPE) == doctype, F.get(d["names"], i))), lambda x: x.isNotNull())
    pairs = lambda d, field: F.flatten(F.transform(d["attrs"], lambda a: F.transform(a, lambda p: p[field])))
    return {
        "basic": over(lambda d: F.concat(F.array(d["public"], d["system"]), named(d, True), pairs(d, "name"))),
        "full": over(lambda d: F.concat(d["values"], pairs(d, "value"))),
        "tag": over(lambda d: named(d, False)),
    }


def _split_at(strings: list[str], uses: list[int], mode: str) -> list[list[str] | None]:
    """The tokens of the used strings, each in its place."""
    out: list[list[str] | None] = [None] * len(strings)
    split = splitter_of().split
    for at in uses:
        if at is not None and 0 <= at < len(strings):
            out[at] = split(strings[at], mode)
    return out


def linearized(df: DataFrame, key: str = "source_index", close_all: bool = False) -> DataFrame:
    """``key, tokens`` for parsed snapshots, each within its row: strings are split in one
    crossing to Python, looked up by place, and put together by built-in operators, without a
    shuffle and in time linear in the snapshot (its events are sorted). A snapshot that is
    null or has no documents has null tokens."""
    rows = _columns(df, key)
    rows = rows.select(key, "strings", "docs", *(u.alias(f"use_{m}") for m, u in _uses("docs").items()), F.transform("docs", lambda d: d["parents"]).alias("parents"), F.transform("docs", lambda d: d["types"]).alias("kinds"))

    def run(strings, basic, full, tag, parents, kinds):
        out = [[], [], [], [], []]
        for s, uses, p, k in zip(strings, zip(basic, full, tag), parents, kinds):
            if s is None or not p:
                for column in out:
                    column.append(None)
                continue
            for column, use, mode in zip(out, uses, ("basic", "full", "tag")):
                column.append(_split_at(s, use, mode))
            ends = [ends_of(x) for x in p]
            out[3].append(ends)
            # the outermost node that is open at the end of each document
            out[4].append([next((i for i, (e, t) in enumerate(zip(x, y)) if e == len(x) and t in (ELEMENT, DOCUMENT)), -1) for x, y in zip(ends, k)])
        return out

    inputs = ["strings", "use_basic", "use_full", "use_tag", "parents", "kinds"]
    rows = with_columns(rows, inputs, run, "t_basic array<array<string>>, t_full array<array<string>>, t_tag array<array<string>>, ends array<array<int>>, outermost array<int>")
    none = F.array().cast("array<string>")
    tokens = lambda mode, at: F.coalesce(F.get(f"t_{mode}", at), none)
    word = lambda *t: F.array(*map(F.lit, t))

    def body(d: Column, type_: Column, i: Column) -> Column:
        name, value = F.get(d["names"], i), F.get(d["values"], i)
        attributes = F.flatten(F.transform(F.get(d["attrs"], i), lambda a: F.concat(word("_"), tokens("basic", a["name"]), word("="), tokens("full", a["value"]))))
        public = F.when(d["public"] >= 0, F.concat(word("PUBLIC"), tokens("basic", d["public"]))).otherwise(none)
        return (
            F.when(type_ == ELEMENT, F.concat(word("<"), tokens("tag", name), attributes, word(">")))
            .when(type_ == TEXT, tokens("full", value))
            .when(type_ == COMMENT, F.concat(word("<!--"), tokens("full", value), word("-->")))
            .when(type_ == DOCTYPE, F.concat(word("<!DOCTYPE"), tokens("basic", name), public, tokens("basic", d["system"]), word(">")))
            .otherwise(none)
        )

    def events(d: Column, number: Column) -> Column:
        event = lambda place, order, deep, t: F.struct(number.alias("doc"), place.alias("place"), F.lit(order).alias("order"), deep.alias("deep"), t.alias("tokens"))
        # at the end of input only the last document closes, and its outermost open node doesn't
        last = F.lit(close_all) | (number == F.size("docs") - 1)

        def close(type_: Column, i: Column) -> Column:
            end, tag = F.get(F.get("ends", number), i), tokens("tag", F.get(d["names"], i))
            open_ = type_.isin(ELEMENT, DOCUMENT) & ((end < F.size(d["types"])) | last & (i != F.get("outermost", number)))
            return F.when(open_ & ~F.lower(F.try_element_at(tag, F.lit(-1))).isin(*VOID_TAGS), event(end, 0, -i, F.concat(word("</"), tag, word(">"))))

        bodies = F.transform(d["types"], lambda type_, i: event(i, 1, F.lit(0), body(d, type_, i)))
        return F.concat(bodies, F.filter(F.transform(d["types"], close), lambda e: e.isNotNull()))

    ordered = F.array_sort(F.flatten(F.transform("docs", events)))
    return rows.select(key, F.when(F.col("ends").isNotNull(), F.flatten(F.transform(ordered, lambda e: e["tokens"]))).alias("tokens"))


def string_uses(df: DataFrame, key: str = "source_index") -> DataFrame:
    """``key, mode, at, text`` for the distinct uses of strings by parsed snapshots."""
    rows = _columns(df, key)
    uses = F.flatten(F.array(*(F.transform(u, lambda at, m=m: F.struct(F.lit(m).alias("mode"), at.alias("at"))) for m, u in _uses("docs").items())))
    return rows.select(key, "strings", F.explode(uses).alias("u")).where("u.at >= 0").select(key, "u.mode", "u.at", decoded(F.col("strings"), F.col("u.at")).alias("text"))
