"""Small helpers the text operators share: column selection, Arrow mapping, words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space; `bytes.split()` cuts UTF-8 at the same places.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slim(df: DataFrame, **columns: str | None) -> DataFrame:
    """Only the named input columns, under the names the operator uses; any other column is left behind."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items() if old))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a batch function inside the tasks, one Arrow batch at a time; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl)) if isinstance(ddl, str) else to_arrow_schema(ddl)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def remainder(id_column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def remainder_is(id_column: str, modulus: int, value: int) -> F.Column:
    """Whether the remainder is `value`; false for a null id."""
    return F.coalesce(remainder(id_column, modulus) == value, F.lit(False))
