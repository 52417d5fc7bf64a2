"""Splits text into tokens, undoing escapes on the way and naming blobs.

Work is a pair of stacks: ``done`` holds what was accepted, ``todo`` what is still to be
looked at, next on top. Each step takes one item and applies the first rule that fits. Items
are strings or ``CUT``, a boundary over which nothing is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

from .blobs import RUN, NotABlob, kind, likeness
from .folding import folded

CUT = None
MODES = ("tag", "basic", "full")

APOSTROPHES = "'\u02b9\u02bc\u02bf\u02c8\u055a\u05f3\u1fbd\u1fbf\u1ffd\u2018\u2019\u201b\u2032\u275c\uff07"
PIECES = re.compile(rf"([^\w{APOSTROPHES}+/=]+)")
WORD = re.compile(rf"(?:\w+[{APOSTROPHES}]?)+")
PADDING = re.compile("[+/=]+")
HEX_PAIR = re.compile("[0-9A-Fa-f]{2}")
CODE_UNIT = re.compile("u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})")
ESCAPE_INSIDE = re.compile(r".(?=[&%\\])")
PREFIXED_HEX = re.compile(r"(0x)([0-9a-f]+)([+/=]*)\n?\Z", re.I)
LONG_HEX = re.compile(r"(?:0x|[0-9a-f]{2})[0-9a-f]{6,}\n?\Z", re.I)
DIGIT = re.compile(r"\d")
#: What makes the words of a text depend on each other: escapes, blobs, long or prefixed runs,
#: and apostrophes in text that isn't ASCII.
ENTANGLED = re.compile(r"[%\\&_+/=]|0[xX]|\w{24}")
ENTANGLED_WIDE = re.compile(rf"[%\\&_+/={APOSTROPHES}]|0[xX]|\w{{24}}")
LOOSE = re.compile(r"[\w']+")
SIMPLE = re.compile(r"[A-Za-z]{1,23}\Z")

MAX_WORD, MIN_BLOB, MAX_URL, URL_HITS, URL_BACK, MIN_LIKENESS = 32, 24, 1024, 2, 4, 0.92
URL_WORDS = frozenset("com css href http https recaptcha roboto src static url www".split())


class Splitter:
    """``split(text, mode)``; modes: ``tag`` lower-cases, ``full`` also decodes, ``basic``
    does neither. The special tokens are options."""

    def __init__(self, base64_token: str = "[BASE64]", long_token: str = "[LONG]"):
        self.base64_token, self.long_token = base64_token, long_token
        self.cached = lru_cache(200_000)(self._cached)

    @property
    def special_tokens(self) -> tuple[str, ...]:
        return self.base64_token, self.long_token

    def split(self, text: str, mode: str = "full") -> list[str]:
        if len(text) <= 32:
            return list(self.cached(text, mode))
        if mode == "tag":
            text, mode = text.lower(), "basic"
        if not (ENTANGLED if text.isascii() else ENTANGLED_WIDE).search(text):
            cached = self.cached
            return [token for word in LOOSE.findall(text) for token in cached(word, mode)]
        return list(self._finished(self.items(text, mode)))

    def _cached(self, text: str, mode: str) -> tuple[str, ...]:
        return tuple(self._finished(self.items(text, mode)))

    def items(self, text: str, mode: str = "full") -> list[str | None]:
        """The accepted items, boundaries among them."""
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}")
        work = _Work(self, mode == "full")
        work.run(text.lower() if mode == "tag" else text)
        return work.done

    def _finished(self, items: list[str | None]) -> Iterator[str]:
        for item in items:
            if item is CUT:
                continue
            token = item.rstrip("'")
            if LONG_HEX.match(token):
                yield self.long_token
                try:
                    int(token)
                except ValueError:
                    yield "hex"
                yield "digits"
            elif len(token) > 4 and likeness(token) >= MIN_LIKENESS:
                yield self.base64_token
            elif len(token) <= MAX_WORD:
                yield token
            else:
                yield self.long_token
                yield "alphanumeric" if DIGIT.search(token) else "alphabetic"


class _Work:
    def __init__(self, splitter: Splitter, decode: bool):
        self.splitter, self.decode = splitter, decode
        self.done: list[str | None] = []
        self.todo: list[str | None] = []

    def run(self, text: str) -> None:
        if SIMPLE.match(text):
            self.done.append(text)
            return
        self.todo.append(text)
        budget = 100 * (len(text) + 10)
        while self.todo:
            budget -= 1
            if budget < 0:
                raise RuntimeError("the rules make no progress")
            item = self.todo.pop()
            if item is CUT:
                self.done.append(CUT)
            else:
                self.step(item)

    def push(self, *items: str | None) -> None:
        self.todo.extend(reversed(items))

    def step(self, item: str) -> None:
        run = RUN.match(item)
        blob = run is not None and run.end() == len(item)
        if run is None:
            if self.blank(item) or self.decode and self.escape(item):
                return
        elif not blob:
            end = run.end()
            after = item[end]
            if after in APOSTROPHES and (word := WORD.match(item)):
                spelled = folded(word[0])
                self.done.append(spelled)
                self.todo.append(item[len(spelled) :])
                return
            if after.isascii():
                self.push(item[:end], item[end:])
                return
        if blob and len(item) > 2 and (match := PREFIXED_HEX.match(item)):
            self.done.extend(filter(None, match.groups()))
        elif blob and self.decode and len(item) >= MIN_BLOB:
            self.sniff(item)
        elif "_" in item:
            self.push(*item.split("_", 1))
        else:
            self.words(item)

    def blank(self, item: str) -> bool:
        """Leading white space becomes a boundary, unless there is one already."""
        if item and not item[0].isspace():
            return False
        rest = item.lstrip()
        if self.done and self.done[-1] is not CUT:
            self.done.append(CUT)
        if rest:
            self.todo.append(rest)
        return True

    def words(self, item: str) -> None:
        words = WORD.findall(item)
        if words == [item]:
            spelled = folded(item)
            if spelled == item:
                self.done.append(item)
            else:
                self.todo.append(spelled)
            return
        pieces = PIECES.split(item)
        while pieces and not pieces[0]:
            del pieces[0]
        while pieces and not pieces[-1]:
            del pieces[-1]
        if len(pieces) > 1:
            self.push(*pieces)
        elif words:
            ahead = self.todo[-1] if self.todo else CUT
            if ahead and ahead[0] not in "%\\&":
                words.append(CUT)
            self.push(*words)
        elif len(item) > 1 and (inner := ESCAPE_INSIDE.search(item)):
            self.push(item[: inner.end()], item[inner.end() :])
        else:
            self.done.append(CUT)

    def escape(self, item: str) -> bool:
        if item == "%":
            self.percent()
        elif item[0] == "\\":
            self.backslash(item)
        elif item in ("&", "&#"):
            self.entity(item)
        else:
            return False
        return True

    def percent(self) -> None:
        """Consecutive ``%xx`` are decoded together; a stray percent sign is dropped."""
        codes = ""
        while self.todo and (ahead := self.todo[-1]) is not CUT and HEX_PAIR.match(ahead):
            codes += "%" + ahead[:2]
            self.todo.pop()
            if len(ahead) > 2:
                self.todo.append(ahead[2:])
                break
            if not self.todo or self.todo[-1] != "%":
                break
            self.todo.pop()
        if codes:
            text = unquote(codes)
            if self.done and self.done[-1] is not CUT:
                text = self.done.pop() + text
            if self.todo and self.todo[-1] is not CUT:
                text += self.todo.pop()
            self.todo.append(text)

    def backslash(self, item: str) -> None:
        """Script escapes; several backslashes count as one."""
        escaped = item.lstrip("\\")
        if len(escaped) < 2:
            if not self.todo:
                return
            if not self.todo[-1]:
                self.done.append(CUT)
                return
            escaped = self.todo.pop()
        first = escaped[0]
        unit = CODE_UNIT.match(escaped)
        if first == "'":
            self.join([escaped])
        elif first in 'bfnrtv0"\\':
            self.join([CUT, escaped[1:]])
        elif unit:
            self.join([chr(int(unit[1] or unit[2], 16)) + escaped[unit.end() :]])
        else:
            self.join([CUT, escaped])

    def entity(self, item: str) -> None:
        """Character references; all named ones but the apostrophe are boundaries."""
        if len(self.todo) < 2 or not self.todo[-1] or not (end := self.todo[-2]) or end[0] != ";":
            self.done.append(CUT)
            return
        name = self.todo[-1]
        if item == "&":
            result = ["'"] if name == "apos" else [CUT, ""] if name.isalnum() else None
        else:
            try:
                result = [chr(int(name[1:], 16) if name[0] in "xX" else int(name))]
            except ValueError:
                result = None
        if result is None:
            self.done.append(CUT)
            return
        del self.todo[-2:]
        if len(end) > 1:
            self.todo.append(end[1:])
        self.join(result)

    def join(self, result: list[str | None]) -> None:
        """Puts a result back to be looked at, joined to its neighbours where they are text."""
        if self.done:
            if result[0] is CUT:
                if self.done[-1] is CUT:
                    del result[0]
            elif self.done[-1] is not CUT:
                result[0] = self.done.pop() + result[0]
        if self.todo and self.todo[-1] is not CUT:
            result[-1] += self.todo.pop()
        self.push(*result)

    def sniff(self, item: str) -> None:
        try:
            if self.urlish(item) or len(item) % 4 and len(item) < MAX_WORD and item.isalnum():
                raise NotABlob(item)
            name = kind(item)
        except NotABlob:
            parts = PADDING.split(item, maxsplit=1)
            if len(parts) == 1:
                self.done.append(item)
            else:
                self.push(*parts)
            return
        self.done.append(self.splitter.base64_token)
        if name:
            self.todo.append(name)

    def urlish(self, item: str) -> bool:
        """Whether words of addresses are in it or just before it."""
        if len(item) > MAX_URL or item[-1] == "=" or "+" in item or "//" in item:
            return False
        hits = sum(w in URL_WORDS for w in WORD.findall(item.replace("_", " ")))
        for before in self.done[: -URL_BACK - 1 : -1]:
            if hits >= URL_HITS:
                break
            hits += before is not CUT and (before in URL_WORDS or before.endswith("cdn"))
        return hits >= URL_HITS
