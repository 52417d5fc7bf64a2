"""What the operators of this package share: names, folders, written tables, word and token caches."""

from __future__ import annotations

import atexit
import base64
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's cache holds before it is emptied; results don't depend on it.
CACHE_ENTRIES = 400_000

_session_folder: str | None = None


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that clash with none of ``df``'s, case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``, else the
    one that was set for checkpoints. Where neither is, a temporary one is made if driver and
    executors are one process, as in tests; on a cluster that is an error."""
    global _session_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _session_folder is None or not os.path.isdir(_session_folder):
        _session_folder = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(_remove_local, _session_folder)
    spark.sparkContext.setCheckpointDir(_session_folder)
    return _session_folder


def _remove_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


#: Paths of the tables written and not yet deleted, in order.
_left: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: lineage ends there, and every
    later reader reads only the columns it needs. What a result still reads when an operator
    returns stays until :func:`clean` or the end of a :func:`scratch` block."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for file in paths:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if file in _left:
            _left.remove(file)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that operators of this process have written and left behind. Results
    that read them and haven't been saved can't be computed after that."""
    _delete(spark, list(_left))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """``with scratch(spark): operator(docs).write...`` deletes at its end the tables that were
    written inside it."""
    before = set(_left)
    try:
        yield
    finally:
        _delete(spark, [p for p in _left if p not in before])


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` once nothing will read them again."""
    names = {f.rsplit("/", 2)[1] for table in tables for f in table.inputFiles()}
    _delete(spark, [p for p in list(_left) if p.rsplit("/", 1)[1] in names])


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow table with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_none(df: DataFrame, bound: int) -> list | None:
    """The rows of ``df`` if there are at most ``bound``, else None; never collects more."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def joined_small(big: DataFrame, small: DataFrame, on: Column, how: str, bound: int) -> DataFrame:
    """Joins with a broadcast only if ``small`` has at most ``bound`` rows, else by shuffle."""
    if small.limit(bound + 1).count() <= bound:
        small = F.broadcast(small)
    return big.join(small, on, how)


DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-splitting rule of the byte-level vocabulary above.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_bytes(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The vocabulary file, read once on the driver. It goes to the executors inside the
    task's function, so that they need no such path; its size is fixed (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_encodings: dict[int, object] = {}


def encoding_of(data: bytes):
    """A worker's encoder for a vocabulary, made once per process."""
    import tiktoken

    key = hash(data)
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks_of(data), special_tokens={})
    return _encodings[key]


def chunk_encoder(data: bytes) -> Callable[[str], list[int]]:
    """Encodes a chunk of a text, the way the encoder does; a bare word without its rule."""
    encoding = encoding_of(data)
    single, whole = encoding._core_bpe.encode_single_piece, encoding.encode_ordinary

    def of(chunk: str) -> list[int]:
        word = chunk[1:] if chunk[:1] == " " else chunk
        return single(chunk.encode()) if word.isascii() and word.isalpha() else whole(chunk)

    return of


def id_type(docs: DataFrame, doc_id: str = "doc_id") -> str:
    """The type of the documents' ids, which operators leave as it is."""
    return docs.select(doc_id).schema[0].dataType.simpleString()


class ChunkCache:
    """Encodes a text as the concatenation of what its space-led chunks encode to.

    The pre-splitting rule always cuts before a single space between two characters that
    aren't white space, so the chunks of ``text.split(" ")`` can be encoded apart and kept
    in a cache; texts with other white space beside a space are cut at those safe places
    only. ``of(chunk)`` gives bytes or a number for one chunk."""

    def __init__(self, of: Callable[[str], object], entries: int = CACHE_ENTRIES):
        self.of, self.entries, self.first, self.rest = of, entries, {}, {}

    def parts(self, text: str) -> list:
        chunks = text.split(" ")
        head, last = chunks[0], len(chunks) - 1
        if last and (not head or head[-1].isspace()):
            return self._slow(chunks)
        out = list(map(self.rest.get, chunks))
        out[0] = self._first(head)
        if None in out:
            for i in range(1, last + 1):
                if out[i] is None:
                    c = chunks[i]
                    if not c or c[0].isspace() or i < last and c[-1].isspace():
                        return self._slow(chunks)
                    out[i] = self._miss(c)
        return out

    def _miss(self, chunk: str):
        if len(self.rest) >= self.entries:
            self.rest.clear()
        value = self.of(" " + chunk)
        if len(chunk) <= 64 and not chunk[-1].isspace():
            self.rest[chunk] = value
        return value

    def _first(self, chunk: str):
        if chunk not in self.first:
            if len(chunk) > 64:
                return self.of(chunk)
            if len(self.first) >= self.entries:
                self.first.clear()
            self.first[chunk] = self.of(chunk)
        return self.first[chunk]

    def _slow(self, chunks: list[str]) -> list:
        out, held = [], chunks[0]
        for c in chunks[1:]:
            if held and not held[-1].isspace() and c and not c[0].isspace():
                out.append(held)
                held = " " + c
            else:
                held += " " + c
        out.append(held)
        return [self.of(x) for x in out]
