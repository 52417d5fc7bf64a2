"""Types of snapshots and of what is made from them."""

from __future__ import annotations

#: Only the fields that are read; everything else in a snapshot is skipped while parsing.
NODES = "struct<parentIndex: array<int>, nodeType: array<int>, nodeName: array<int>, nodeValue: array<int>, attributes: array<array<int>>>"
DOCUMENTS = f"array<struct<documentURL: int, publicId: int, systemId: int, nodes: {NODES}>>"
SNAPSHOT = f"struct<strings: array<string>, documents: {DOCUMENTS}>"
#: A snapshot or a browser's response around one.
RESPONSE = f"struct<strings: array<string>, documents: {DOCUMENTS}, result: {SNAPSHOT}>"

ELEMENT, TEXT, COMMENT, DOCUMENT, DOCTYPE = 1, 3, 8, 9, 10
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
