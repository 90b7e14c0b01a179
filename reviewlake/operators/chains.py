"""Which rows a walk along the rows visits, when each row says where the walk goes next: without walking all of them in turn.

Rows are numbered 0, 1, ...; a row's `next` is a larger number, and the walk begins at 0. Rows are cut into blocks. In each block,
all at once, every row that a pointer from another block leads to learns where the walk would leave the block. Along
these few rows the visited ones are marked by doubling: after round r the first 2 ** r of them are known, and each
jump is 2 ** r blocks long. Then every block knows its entry, and walks only inside itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructType

from reviewlake.session import materialize, ship

BLOCK_ROWS = 1 << 16


def _by_block(rows: DataFrame, schema: StructType, names: list[str], block_rows: int, one) -> DataFrame:
    """A block of rows in order at a time through one(table, its named columns as arrays) -> table."""
    ship(rows.sparkSession)

    def run(batches):
        held, now = [], None

        def close():
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                yield from one(table, *[table.column(n).to_numpy() for n in names]).to_batches(max_chunksize=8192)
            held.clear()

        for batch in filter(len, batches):
            block = batch.column(batch.schema.get_field_index(names[0])).to_numpy() // block_rows
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if block[a] != now:
                    yield from close()
                    now = block[a]
                held.append(batch.slice(a, b - a))
        yield from close()

    return rows.repartition(F.floor(F.col(names[0]) / block_rows)).sortWithinPartitions(names[0]).mapInArrow(run, schema)


def _leave(places: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Where the walk leaves a block, from each of its rows."""
    first, stop = int(places[0]), int(places[-1]) + 1
    out = next_.tolist()
    for i in range(len(out) - 1, -1, -1):
        if out[i] < stop:
            out[i] = out[out[i] - first]
    return np.array(out, np.int64)


def _walk(places: np.ndarray, next_: np.ndarray, entry: int | None) -> np.ndarray:
    first, stop, on = int(places[0]), int(places[-1]) + 1, np.zeros(len(places), bool)
    steps, now = next_.tolist(), entry
    while now is not None and now < stop:
        on[now - first] = True
        now = steps[now - first]
    return on


def visited(rows: DataFrame, place: str = "place", next_: str = "next", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `start`: whether the walk from row 0 comes by. place is 0, 1, ... without gaps; next is larger than place."""
    rows = materialize(rows, "chain-rows")
    block = lambda c: F.floor(F.col(c) / block_rows)
    steps = rows.select(F.col(place).alias("p"), F.col(next_).alias("q"))
    led = steps.where(block("p") != block("q")).select(F.col("q").alias("p")).distinct().withColumn("led", F.lit(True))
    asked = steps.join(led, "p", "left").select("p", "q", F.coalesce("led", F.col("p") == 0).alias("led"))

    def leave(table, p, q, led):
        return pa.table({"p": p[led], "out": _leave(p, q)[led]})

    jump = materialize(_by_block(asked, StructType.fromDDL("p long, out long"), ["p", "q", "led"], block_rows, leave), "chain-jumps")
    marked = materialize(jump.where("p = 0").select("p"), "chain-marked")
    while True:
        more = materialize(marked.join(jump, "p").select(F.col("out").alias("p")).join(jump, "p", "left_semi"), "chain-marked")
        if more.isEmpty():
            break
        marked = materialize(marked.unionByName(more).distinct(), "chain-marked", replaces=marked)
        far = jump.select(F.col("p").alias("out"), F.col("out").alias("far"))
        jump = materialize(jump.join(far, "out", "left").select("p", F.coalesce("far", "out").alias("out")), "chain-jumps", replaces=jump)

    entry = rows.join(marked.select(F.col("p").alias(place), F.lit(True).alias("_entry")), place, "left").select(*rows.columns, F.coalesce("_entry", F.lit(False)).alias("_entry"))

    def walk(table, p, q, entry):
        first = np.flatnonzero(entry)
        return table.drop_columns("_entry").append_column("start", pa.array(_walk(p, q, int(p[first[0]]) if len(first) else None)))

    schema = StructType([*rows.schema.fields]).add("start", BooleanType())
    return _by_block(entry, schema, [place, next_, "_entry"], block_rows, walk)
