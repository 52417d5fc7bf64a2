"""From one snapshot to its tokens: the walk in document order, row by row."""

from __future__ import annotations

import json
from collections.abc import Callable

from ..schema import COMMENT, DOCTYPE, DOCUMENT, ELEMENT, TEXT, VOID_TAGS
from .splitter import Splitter

FIELDS = ("parentIndex", "nodeType", "nodeName", "nodeValue", "attributes")
VOID = frozenset(VOID_TAGS)


class BreakingInput(ValueError):
    """A snapshot that can't be walked."""


def unwrapped(snapshot: dict) -> dict:
    """What a browser's response holds, or the snapshot itself."""
    if "documents" in snapshot or "strings" in snapshot:
        return snapshot
    return snapshot.get("result", snapshot)


def walk(snapshot: dict, split: Callable[[str, str], list[str]], close_all: bool = False) -> list[str]:
    """Tokens of a parsed snapshot.

    At the end of input the elements still open are closed once, for the last document, all
    but the outermost open node; earlier documents are left open unless ``close_all``. Nodes
    whose parent was never opened, names without tokens, odd attribute lists and indexes out
    of range raise."""
    snapshot = unwrapped(snapshot)
    strings, known = snapshot["strings"], {}

    def tokens(at: int, mode: str) -> list[str]:
        if at < 0:
            return []
        found = known.get((at, mode))
        if found is None:
            found = known[at, mode] = split(strings[at], mode)
        return found

    out: list[str] = []

    def close(name: int) -> None:
        tag = tokens(name, "tag")
        if not tag:
            raise BreakingInput("a tag without a name is closed")
        if tag[-1].lower() not in VOID:
            out.extend(("</", *tag, ">"))

    documents = snapshot["documents"]
    if not documents:
        raise BreakingInput("no documents")
    for number, document in enumerate(documents):
        strings[document["documentURL"]]  # noqa: B018  out of range breaks the row
        opened: list[tuple[int, int]] = []
        for index, (parent, type_, name, value, attributes) in enumerate(zip(*(document["nodes"][f] for f in FIELDS))):
            while (opened[-1][0] if opened else -1) != parent:
                if not opened:
                    raise BreakingInput(f"node {index} hangs on node {parent}, which isn't open")
                close(opened.pop()[1])
            if type_ == ELEMENT:
                if len(attributes) % 2:
                    raise BreakingInput("an attribute without a value")
                out.append("<")
                out += tokens(name, "tag")
                for i in range(0, len(attributes), 2):
                    out.append("_")
                    out += tokens(attributes[i], "basic")
                    out.append("=")
                    out += tokens(attributes[i + 1], "full")
                out.append(">")
                opened.append((index, name))
            elif type_ == TEXT:
                out += tokens(value, "full")
            elif type_ == DOCUMENT:
                opened.append((index, name))
            elif type_ == COMMENT:
                out += ["<!--", *tokens(value, "full"), "-->"]
            elif type_ == DOCTYPE:
                out += ["<!DOCTYPE", *tokens(name, "basic")]
                if (public := document["publicId"]) >= 0:
                    out += ["PUBLIC", *tokens(public, "basic")]
                if (system := document["systemId"]) >= 0:
                    out += tokens(system, "basic")
                out.append(">")
        if close_all or number == len(documents) - 1:
            for _, name in reversed(opened[1:]):
                close(name)
    return out


def tokenized(serialized: str, splitter: Splitter, close_all: bool = False) -> list[str]:
    return walk(json.loads(serialized), splitter.split, close_all)
