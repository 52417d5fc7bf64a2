"""Column expressions of the text rules that Catalyst can compute by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VOID_TAGS

#: Letters, digits and underscore of all scripts, alike in Java and RE2.
W_CLASS = r"\p{L}\p{N}_"
APOSTROPHES = "'ʹʼʿˈ՚׳᾽᾿´‘’‛′❜＇"


def first_pieces(text: Column) -> Column:
    """Maximal runs inside and outside words, blobs' symbols and apostrophes."""
    c = f"{W_CLASS}{APOSTROPHES}+/="
    return F.regexp_extract_all(text, F.lit(f"([{c}]+|[^{c}]+)"), F.lit(1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"((?:[{W_CLASS}]+[{APOSTROPHES}]?)+)"), F.lit(1))


def share(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", "")) / F.length(text)


def skew(text: Column) -> Column:
    """Deviation from random base64 in capitals, small letters and digits; null if undecidable."""
    worst = F.greatest(F.abs(share(text, "A-Z") - F.lit(26 / 62)), F.abs(share(text, "a-z") - F.lit(26 / 62)), F.abs(share(text, "0-9") - F.lit(10 / 62)))
    return F.when(text.rlike(r"\A[A-Za-z0-9]+\z"), worst)


def is_base64_like(text: Column) -> Column:
    s = skew(text)
    return (F.length(text) > 4) & F.coalesce((s != 0) & (1 - s >= 0.92), F.lit(False))


def is_long_hex(text: Column) -> Column:
    return text.rlike(r"(?i)\A(?:0x|[0-9a-f]{2})[0-9a-f]{6,}\z")


def long_class(text: Column) -> Column:
    """``hex digits``, ``digits``, ``alphanumeric`` or ``alphabetic`` for tokens that are
    replaced by the long token; null for others."""
    return (
        F.when(is_long_hex(text) & text.rlike(r"\A[0-9]{1,4300}\z"), "digits")
        .when(is_long_hex(text), "hex digits")
        .when(F.char_length(text) > 32, F.when(text.rlike(r"\p{Nd}"), "alphanumeric").otherwise("alphabetic"))
    )


def is_void(tag: Column) -> Column:
    return F.lower(tag).isin(*VOID_TAGS)


def prefixed_hex(text: Column) -> Column:
    """``[0x, digits, tail]`` without empty parts; null if it isn't prefixed hex."""
    part = lambda i: F.regexp_extract(text, r"(?i)\A(0x)([0-9a-f]+)([+/=]*)\z", i)
    return F.when(part(1) != "", F.filter(F.array(part(1), part(2), part(3)), lambda x: x != ""))


def probably_word(text: Column) -> Column:
    return (F.char_length(text) % 4 != 0) & (F.char_length(text) < 32) & text.rlike(rf"\A[\p{{L}}\p{{N}}]+\z")


def entities_cut(text: Column) -> Column:
    """Named character references as boundaries, the apostrophe's aside."""
    return F.regexp_replace(F.replace(text, F.lit("&apos;"), F.lit("'")), "&[A-Za-z0-9]+;", " ")


def phi(text: Column) -> Column:
    """Sum of f(f - 1) over the text's symbols."""
    chars = F.array_sort(F.split(text, ""))
    distinct = F.array_distinct(chars)
    counts = F.transform(distinct, lambda c: F.size(F.filter(chars, lambda d: d == c)))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, f: s + f.cast("long") * (f - 1))


def round_and_prefix(value: Column) -> Column:
    """314159 as 314k, by thousands."""
    digits = F.floor(F.log10(value)).cast("int")
    unit = F.floor(digits / 3).cast("int")
    scaled = F.rint(value / F.pow(F.lit(1000.0), unit)).cast("long")
    return F.concat(scaled.cast("string"), F.element_at(F.array(*map(F.lit, ["", "k", "M", "B", "T", "Q"])), unit + 1))


def cache_key(dataset: Column, split: Column) -> Column:
    return F.concat(F.sha2(F.concat(dataset, F.lit("\0"), F.coalesce(split, F.lit(""))), 256), F.lit(".jsonl"))
