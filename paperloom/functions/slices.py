"""Python functions of texts whose tasks hold a slice of a batch and what is made of it, whatever the batch's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text in a slice, and rows; a longer text is a slice of its own.
SLICE, ROWS = 1 << 20, 1000


def cuts(columns: list[pa.Array], most: int = SLICE, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """(first, after) of consecutive slices of equally long columns, of at most so many bytes or of one row."""
    sizes = [0] * len(columns[0])
    for column in columns:
        if pa.types.is_list(column.type):  # the bytes of a list's texts
            inner = pc.cast(pc.coalesce(pc.binary_length(column.flatten()), 0), pa.int64()).to_pylist()
            ends = pc.cumulative_sum(pc.coalesce(pc.list_value_length(column), 0)).to_pylist()
            own = [sum(inner[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        else:
            own = pc.coalesce(pc.binary_length(column), 0).to_pylist()
        sizes = [x + y for x, y in zip(sizes, own, strict=True)]
    first, held = 0, 0
    for at, size in enumerate(sizes):
        if at > first and (held + size > most or at - first == rows):
            yield first, at
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def by_slices(kind: str, make: Callable[..., pa.Array]):
    """An Arrow function of the DDL type: ``make`` gets the Python values of a slice, a list for each column, and gives its results."""

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for first, after in cuts([column]):
                yield make(column[first:after].to_pylist())

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for first, after in cuts(list(columns)):
                yield make(*[c[first:after].to_pylist() for c in columns])

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else two, kind)(*columns)  # made where it is used, as executors parse no DDL
