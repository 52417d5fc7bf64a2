"""Binding the engine's splitting to a tokenizer of the ``tokenizers`` kind.

A :class:`SnapshotTokens` is bound to one tokenizer, and a tokenizer to one of them; the
tokenizer's backend then gets its tokens from serialized snapshots, and its own normalizer
sees all of them but the special ones. Other sources of tokens derive from :class:`Tokens`.
"""

from __future__ import annotations

import logging
import weakref
from abc import ABC, abstractmethod

from .functions.dom import tokenized
from .functions.splitter import Splitter

log = logging.getLogger(__name__)
#: Where a tokenizer keeps what it is bound to.
MARK = "snapshot_tokens"


class Tokens(ABC):
    """What is plugged into a tokenizer."""

    def __init__(self, splitter: Splitter | None = None):
        self.splitter = splitter or Splitter()
        self._bound = None

    @classmethod
    def plug_into(cls, tokenizer) -> Tokens:
        """Binds a new instance, which the tokenizer keeps alive through its backend."""
        made = cls()
        made.bind(tokenizer)
        return made

    def bind(self, tokenizer) -> None:
        """RuntimeError if either side is bound; TypeError if it has no backend."""
        backend = getattr(tokenizer, "backend_tokenizer", None)
        if self._bound is not None or getattr(tokenizer, MARK, None) is not None:
            raise RuntimeError("one of the two is bound to another")
        if backend is None:
            raise TypeError(f"{type(tokenizer).__name__} has no backend")
        from tokenizers.pre_tokenizers import PreTokenizer

        # marked before anything else can fail, so that a failure leaves both of no further use
        setattr(tokenizer, MARK, weakref.proxy(self))
        self._bound = weakref.proxy(tokenizer)
        backend.pre_tokenizer = PreTokenizer.custom(self)

    @property
    def special_tokens(self) -> frozenset[str]:
        return frozenset(self.splitter.special_tokens)

    def pre_tokenize(self, text) -> None:
        """The backend's entry: splits, then normalizes what isn't special."""
        text.split(self._pieces)
        normalizer = self._bound.backend_tokenizer.normalizer
        if normalizer is not None:
            special = self.special_tokens
            text.normalize(lambda piece: None if piece.original in special else normalizer.normalize(piece))

    def _pieces(self, _: int, piece) -> list:
        from tokenizers import NormalizedString

        try:
            return [NormalizedString(t) for t in self.tokens(piece.original)]
        except Exception as e:
            log.exception("%s while splitting", type(e).__name__)
            raise

    @abstractmethod
    def tokens(self, serialized: str) -> list[str]:
        """The tokens of one serialized input."""


class SnapshotTokens(Tokens):
    """Tokens of serialized snapshots."""

    def tokens(self, serialized: str) -> list[str]:
        return tokenized(serialized, self.splitter)


class TextTokens(Tokens):
    """Tokens of plain text."""

    def tokens(self, serialized: str) -> list[str]:
        return self.splitter.split(serialized)
