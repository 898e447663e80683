"""Running per-page Python over a table of pages, in Arrow batches.

Only the named columns leave the JVM.  Pages are handed on in small slices of
bounded size, so a worker holds few parsed pages at a time, however long they
are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread
from .pages import Block, decode, page_blocks

#: Pages, and bytes of pages, that are parsed before their results are sent off.
SLICE_ROWS, SLICE_BYTES = 500, 8_000_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, cut so that no part has many rows or bytes in ``column``."""
    array = batch.column(column)
    start = size = 0
    for i, v in enumerate(array):
        size += len(v.as_buffer()) if v.is_valid else 0
        if i - start + 1 >= SLICE_ROWS or size >= SLICE_BYTES:
            yield batch.slice(start, i - start + 1)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def parsed(batch: pa.RecordBatch, column: str = "page") -> tuple[list[str], list[list[Block]]]:
    """The decoded pages of a batch and their text blocks."""
    html = [decode(p) for p in batch.column(column).to_pylist()]
    return html, [page_blocks(h) for h in html]


def map_batches(
    df: DataFrame,
    columns: list[str],
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    sliced_by: str = "page",
) -> DataFrame:
    """``work`` on each slice of the chosen ``columns``; rows without ``sliced_by`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sliced_by):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    ship_package(df.sparkSession)
    rows = df.select(*columns).where(F.octet_length(sliced_by) > 0)
    return spread(rows).mapInArrow(run, schema)
