"""Arrow plumbing of the Python-side operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., list]], schema: str, rows: int | None = None) -> DataFrame:
    """Apply a batch function to the named columns.

    ``make`` runs once in each task and returns the function; this takes one Python list per
    column and returns one list or Arrow array per output field. Only the named columns cross to Python. ``rows``: so many at once at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn: Any = None
        for b in pieces(batches, rows) if rows else batches:
            if not b.num_rows:
                continue
            fn = fn or make()
            out = fn(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) if not isinstance(x, pa.Array) else x for x, f in zip(out, target)], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2500) -> Iterator[pa.RecordBatch]:
    """Batches cut smaller, for functions that hold arrays over all words of a batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About nine tenths of ``rows`` rows, ``rows`` at most, for training only; alike on every run.

    Rows are taken by the hash of their key under a limit from the table's count, so no task sends more than its part.
    """
    total = df.count()
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1 << 30))
    part = df if total <= rows else df.where(h < int(0.9 * rows / total * (1 << 30)))
    return part.limit(rows)
