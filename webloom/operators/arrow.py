"""Adding columns computed by Python to a DataFrame, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of input columns that are Python objects at a time, a row at least, and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 1024
#: Rows of a small table, and rows of long texts, that one task takes.
TASK_ROWS, TEXT_ROWS = 50_000, 8192


def sliced(batch: pa.RecordBatch, places: list[int]) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut until no slice of several rows has more than ``SLICE_ROWS`` rows
    or ``SLICE_BYTES`` in the columns at ``places``, however long its neighbours are."""
    todo = [batch]
    while todo:
        now = todo.pop()
        if now.num_rows > 1 and (now.num_rows > SLICE_ROWS or sum(now.column(i).nbytes for i in places) > SLICE_BYTES):
            half = now.num_rows // 2
            todo += [now.slice(half), now.slice(0, half)]
        else:
            yield now


def spread(df: DataFrame, per_task: int = TASK_ROWS) -> DataFrame:
    """A table of short rows from which much is made, over as many tasks as its rows are worth:
    a small file, or one written in one piece, would be read by a single task otherwise."""
    tasks = -(-df.count() // per_task)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism)) if tasks > 1 else df


def evened(df: DataFrame, key: str, per_task: int = TEXT_ROWS) -> DataFrame:
    """A table of long texts as it is read, unless one task would read more than twice its share,
    as with a file written in one piece: then dealt out by ``key``. Rows are counted without
    reading a column."""
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    at_once = df.sparkSession.sparkContext.defaultParallelism
    if max(rows, default=0) <= max(per_task, 2 * sum(rows) / at_once):
        return df
    return df.repartition(max(at_once, -(-sum(rows) // per_task)), key)


def with_columns(df: DataFrame, inputs: list[str], fn: Callable[..., list[list]], added: str) -> DataFrame:
    """``df`` and the columns ``added`` (a schema string) that ``fn`` makes of the input
    columns' values, given and returned as lists. Columns of these names are replaced. The
    batch's other columns pass through untouched, without being converted. ``fn`` sees a slice
    of the batch at a time, so that a worker's memory doesn't follow the batch."""
    new: StructType = _parse_datatype_string(added)
    names = {f.name.lower() for f in new}
    rows = df.select(*(f"`{c}`" for c in df.columns if c.lower() not in names or c in inputs))
    schema = StructType([f for f in rows.schema if f.name.lower() not in names] + list(new))
    keep = [i for i, c in enumerate(rows.columns) if c.lower() not in names]
    places = [rows.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new]
        for whole in batches:
            for batch in sliced(whole, places):
                made = fn(*(batch.column(i).to_pylist() for i in places))
                arrays = [pa.array(values, type_) for values, type_ in zip(made, types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], schema.names)

    return rows.mapInArrow(run, schema)
