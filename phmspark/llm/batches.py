"""Columns made from a text column, batch by batch, beside all columns that a table has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_BYTES = 4_000_000
BATCH_ROWS = 1000


def cuts(lengths: np.ndarray, most_bytes: int = BATCH_BYTES) -> list[int]:
    """Where to cut rows of these lengths so that no batch has over BATCH_ROWS rows, or over ``most_bytes`` but for one row."""
    at, size, rows = [0], 0, 0
    for k, n in enumerate(lengths.tolist()):
        if rows and (rows >= BATCH_ROWS or size + n > most_bytes):
            at.append(k)
            size = rows = 0
        size, rows = size + n, rows + 1
    return [*at, len(lengths)]


def with_text_columns(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str | None]], dict[str, list]]], new: str) -> DataFrame:
    """``df`` and the columns of the DDL ``new``. ``make`` is called once in each task; what it returns maps a batch of
    texts (null: None) to a list for each new column. A column of ``df`` with a new column's name is replaced; all other
    columns pass as Arrow data, unchanged."""
    fields = StructType.fromDDL(new)
    df = df.drop(*fields.names)
    schema = StructType([*df.schema.fields, *fields.fields])
    types = [f.type for f in to_arrow_schema(fields)]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            where = cuts(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()) if batch.num_rows else []
            for a, b in zip(where, where[1:]):
                some = batch.slice(a, b - a)
                made = f(some.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(made[n], t) for n, t in zip(fields.names, types, strict=True))], names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)
