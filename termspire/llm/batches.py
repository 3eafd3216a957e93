"""Arrow batches in Spark tasks: bounded parts of a batch, and the texts in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text that a task holds as Python objects at once; a longer text is a part of its own.
PART_BYTES = 12 << 20


def parts(batch: pa.RecordBatch, column: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut into parts with about `size` bytes of text each."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False))
    part = (ends - 1).clip(0) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, end - start)
    pa.default_memory_pool().release_unused()


class Numbers(dict):
    """Numbers from 0 for keys, in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def texts(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts of a column; a null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The texts of a column in UTF-8; a null counts as empty."""
    array = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def map_parts(
    df: DataFrame,
    columns: dict[str, str | Column],
    function: Callable[[pa.RecordBatch], dict | None],
    schema: str,
    size: int = PART_BYTES,
) -> DataFrame:
    """Rows made from bounded parts of a frame, without a shuffle.

    Only `columns` (own name: column of the frame) reach the function, the text last, so other
    columns of the frame may have any names. The function gets a part and returns arrays by name.
    """
    last = len(columns) - 1
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in parts(batch, last, size):
                made = function(part)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[n]) for n in names], names)

    source = df.select(
        *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    )
    return source.mapInArrow(run, schema)
