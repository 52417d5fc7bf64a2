"""Words of a text as 128-bit digests, by a cache over what stands between white space."""

from __future__ import annotations

import hashlib

import numpy as np
import regex

from .base import CACHE_ENTRIES

#: A word is a run of letters and digits, lower-cased.
WORD = regex.compile(r"[\p{L}\p{N}]+")


class Digests(dict):
    """Raw token to the MD5 digests of its words, one after another."""

    def __missing__(self, token: str) -> bytes:
        value = b"".join(hashlib.md5(w.encode(), usedforsecurity=False).digest() for w in WORD.findall(token.lower()))
        if len(token) <= 64:
            self[token] = value
        return value

    def of(self, text: str) -> np.ndarray:
        """An n x 2 array of big-endian 64-bit halves of the words' digests."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), ">u8").reshape(-1, 2)


#: One cache for each worker process.
digests = Digests()
