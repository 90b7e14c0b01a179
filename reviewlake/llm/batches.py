"""Arrow batches of (key columns, text) in, rows out, for the operators that work on texts in Python tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from reviewlake.session import ship

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BATCH_BYTES = 4 << 20


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str | StructType) -> DataFrame:
    """Flat-map each row of df. make() runs once a task and returns row -> iterable of output tuples.

    Where that function has an attribute `end`, its rows follow the last row of the task: for walks along sorted rows. Output goes out in batches of bounded bytes, so that a row that yields much data never piles up with others.
    """
    ship(df.sparkSession)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def found(one, batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield from one(*row)
        yield from getattr(one, "end", tuple)()

    def run(batches):
        rows, held = [], 0
        for out in found(make(), batches):
            rows.append(out)
            held += 64 + sum(len(x) for x in out if isinstance(x, (bytes, str)))
            if held > BATCH_BYTES:
                yield _batch(rows, arrow)
                rows, held = [], 0
        if rows:
            yield _batch(rows, arrow)

    return df.mapInArrow(run, kind)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
