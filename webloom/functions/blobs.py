"""What an encoded blob is: base64 runs, their decoding and their kind."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections import Counter

RUN = re.compile(r"[A-Za-z0-9+/]+={0,2}")
PNG = re.compile(r"iVBORw0KGg[o-r]")
XML = re.compile(r"<([a-z]{3,})\s+[a-z]+")
#: First bytes and the name that goes with them.
SIGNATURES = [(b"GIF8", "GIF"), (b"\xff\xd8\xff", "JPEG"), (b"wOFF", "woff"), (b"wOF2", "woff"), *((b"x" + bytes([b]), "zlib") for b in (0x01, 0x5E, 0x9C, 0xDA))]
PHI_LENGTH = 85


class NotABlob(ValueError):
    """It looked like base64 but is text."""


def decoded(text: str) -> bytes:
    """Decodes base64, supplying the padding that is missing."""
    try:
        return base64.b64decode(text)
    except binascii.Error:
        bare = text.rstrip("=")
        return base64.b64decode(bare + "AA=="[len(bare) % 4 :])


def skew(text: str) -> float | None:
    """Greatest deviation of the shares of capitals, small letters and digits from those in
    random base64; None if empty or if there are other characters."""
    if not text or not text.isascii() or not text.isalnum():
        return None
    upper = sum(map(str.isupper, text))
    digit = sum(map(str.isdigit, text))
    n = len(text)
    return max(abs(upper / n - 26 / 62), abs((n - upper - digit) / n - 26 / 62), abs(digit / n - 10 / 62))


def likeness(text: str) -> float:
    """How much like random base64, 0 where that can't be said (or the skew is exactly 0)."""
    s = skew(text)
    return 1 - s if s else 0.0


def looks_monoalphabetic(text: str) -> bool:
    """The phi test: twice as many equal pairs of symbols as in random text."""
    n = len(text)
    return sum(f * (f - 1) for f in Counter(text).values()) > 2 * n * (n - 1) / 64


def kind(text: str) -> str | None:
    """Name of what is encoded, None for unknown binary data; :class:`NotABlob` for text."""
    if PNG.match(text):
        return "png"
    data = decoded(text)
    try:
        plain = data.decode("utf-8")
    except UnicodeDecodeError:
        return _binary(data, text)
    if header := XML.match(plain):
        return "svg" if header[1] == "svg" else "xml"
    try:
        json.loads(plain)
    except json.JSONDecodeError:
        return "utf-8"
    return "json"


def _binary(data: bytes, text: str) -> str | None:
    for start, name in SIGNATURES:
        if data.startswith(start):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if len(text) <= PHI_LENGTH and looks_monoalphabetic(text):
        raise NotABlob(text)
    return None
