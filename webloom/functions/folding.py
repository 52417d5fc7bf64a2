"""ASCII spellings of words in other letters, from Unicode's own data and small tables."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

_APOSTROPHES = dict.fromkeys("ʹʼʿˈ՚׳᾽᾿´‘’‛′❜＇", "'")
_LATIN = dict(zip("ßÆæŒœØøĐđÐðÞþŁłĦħıĸŊŋŦŧſƒǝəʃʒ", ["ss", "AE", "ae", "OE", "oe", "O", "o", "D", "d", "D", "d", "Th", "th", "L", "l", "H", "h", "i", "k", "NG", "ng", "T", "t", "s", "f", "@", "@", "S", "Z"]))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", ["a", "b", "g", "d", "e", "z", "e", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "u", "ph", "kh", "ps", "o"]))
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёђєіїјљњћўџґ", ["a", "b", "v", "g", "d", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "'", "y", "'", "e", "iu", "ia", "io", "dj", "ie", "i", "yi", "j", "lj", "nj", "c", "u", "dz", "g"]))
_TABLE = _APOSTROPHES | _LATIN | _GREEK | _CYRILLIC

#: Scripts whose letters' names end in the sound.
_SYLLABLES = ("HIRAGANA", "KATAKANA", "HANGUL SYLLABLE", "ETHIOPIC SYLLABLE", "YI SYLLABLE", "CHEROKEE LETTER", "HEBREW LETTER", "ARABIC LETTER", "DEVANAGARI LETTER", "THAI CHARACTER", "ARMENIAN", "GEORGIAN")


@lru_cache(65536)
def _char(c: str) -> str:
    if c < "\x80":
        return c
    if c in _TABLE:
        return _TABLE[c]
    low = c.lower()
    if low != c and low in _TABLE:
        return _TABLE[low].capitalize()
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    if plain and plain != c:
        return "".join(map(_char, plain))
    if unicodedata.category(c)[0] == "N" and unicodedata.digit(c, None) is not None:
        return str(unicodedata.digit(c))
    name = unicodedata.name(c, "")
    if name.startswith(_SYLLABLES):
        return "".join(x for x in name.rpartition(" ")[2].lower() if x.isalnum() and x.isascii())
    if name.startswith("CJK UNIFIED"):
        return f"u{ord(c):x}"
    return ""


def folded(text: str) -> str:
    """``text`` in ASCII. Letters with marks lose them; Greek, Cyrillic and syllabic scripts
    are spelled by sound; ideographs by code point; what has no letter is left out."""
    return text if text.isascii() else "".join(map(_char, text))
