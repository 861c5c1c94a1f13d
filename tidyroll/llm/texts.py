"""Runs a function over whole texts inside Spark tasks, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed on together until they have so many bytes; a longer one goes alone.
CHUNK_BYTES = 4 << 20

Texts = list[bytes | None]
Columns = Sequence[pa.Array]


def chunks(values: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose values have about `most` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(values):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, end
        start = end


def per_text(
    docs: DataFrame,
    fields: str,
    make: Callable[[], Callable[[Texts], Columns]],
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Results of each text, beside the row it belongs to; no shuffle.

    `make` is called once in a task and gives a function from texts (UTF-8, None for null) to
    one Arrow array for each of `fields`. The row's columns named by `carry` come back in the
    struct `row`, so they can't clash with the results. Each row gives one row, repeated rows
    included.
    """
    result = T.StructType.fromDDL(fields)
    frame = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.col(f"`{text}`").cast("binary").alias("text"),
    )
    schema = T.StructType([frame.schema["row"], *result.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = make()
        for batch in batches:
            rows, values = batch.column(0), batch.column(1)
            for start, end in chunks(values):
                columns = process(values.slice(start, end - start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(start, end - start), *columns],
                    names=["row", *(f.name for f in result.fields)],
                )

    return frame.mapInArrow(run, schema)


def carried(frame: DataFrame, *results: str) -> DataFrame:
    """The carried columns as columns again, with the given results after them."""
    return frame.select("row.*", *results)
