"""Near duplicates among vectors by collision-counting projections.

All unit vectors are projected on LINES random lines. On every line the vectors are sorted, and around each a window is
laid; a pair collides on a line when one lies in the other's window. Pairs that collide on at least `min_count` lines
are verified by their cosine in double precision. Collisions of a pair at the threshold are binomial: window and count
are those that keep the wanted recall and let the fewest pairs of cosine FAR through.

Windows on single lines meet a share of all pairs, so what is sorted together is dealt first: in each of `tables`
rounds, signs of further projections put vectors into cells of some CELL_ROWS, and lines are sorted within a cell. Bits
follow the logarithm of the number of vectors, and rounds the recall. A pair is looked at in the first cell that it
shares, and nowhere else. Cells above BLOCK_ROWS are dealt over pairs of salts.

A cell emits a row for each linked vector, with the number of its links and one other vector of its group: a group of
near copies has all its links counted and none of its pairs written.

Equal vectors are compared once and counted as often as they occur; vectors of each length are a search of their own.
Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without vec_id, have no
links and are their own component; repeated rows link with each other; rows that share a vec_id are vectors of their own with the
same id; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from reviewlake.llm.graph import connected_components
from reviewlake.session import materialize, ship

THRESHOLD = 0.9
RECALL = 0.99
LINES = 48
FAR = 0.5
CELL_ROWS = 512
BLOCK_ROWS = 1000
STEP_ROWS = 256
CHECK_PAIRS = 50_000
HOT_SALTS = 16
SEED = 20240101


class Plan(NamedTuple):
    """Rounds of cells, sign bits of a cell, half width of a window on unit vectors, and lines on which a pair must collide."""

    tables: int
    bits: int
    width: float
    min_count: int


def at_least(m: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= m)."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m, n + 1))


def search_plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, lines: int = LINES) -> Plan:
    """The plan for n vectors. Half of what recall leaves may be missed by counting, half by cells."""
    miss = (1 - recall) / 2
    apart = lambda cosine: math.sqrt(2 - 2 * cosine)
    options = []
    for sigmas in np.arange(0.6, 2.5, 0.05):
        width = sigmas * apart(threshold)
        near, far = (math.erf(width / apart(c) / math.sqrt(2)) for c in (threshold, FAR))
        m = next((m for m in range(lines, 0, -1) if at_least(m, lines, near) >= 1 - miss), 1)
        options.append((at_least(m, lines, far), width, m))
    _, width, m = min(options)
    bits = max(0, round(math.log2(max(n, 1) / CELL_ROWS)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = 1 if meet >= 1 else math.ceil(math.log(miss) / math.log(1 - meet))
    return Plan(tables, bits, float(width), m)


def directions(dim: int, count: int, part: int) -> np.ndarray:
    """dim x count Gaussian directions: part 0 for lines, 1 for signs."""
    return np.random.default_rng([SEED, part, dim]).standard_normal((dim, count))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as doubles of length one; first scaled by their largest part, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def stacked(column: pa.Array, dtype: str) -> np.ndarray:
    """Binary values of equal length as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def keyed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """row, vec_id, dim, key (128 bits of the value) and v (its bytes) of every row; key is null where nothing may link."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    dtype = "<f4" if single else "<f8"
    ship(vectors.sparkSession)
    names = ["row", "vec_id", "dim", "key", "v"]

    def run(batches):
        for batch in batches:
            column, ids = batch.column(2), batch.column(1)
            values = column.values.to_numpy(zero_copy_only=False).astype(dtype) + 0.0
            at, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            dims, keys, data = [], [], []
            for i, ok in enumerate(there):
                x = values[at[i] : at[i + 1]] if ok else values[:0]
                ok = bool(np.isfinite(x).all() and x.any())
                data.append(x.tobytes() if ok else None)
                keys.append(hashlib.blake2b(data[-1], digest_size=16).digest() if ok else None)
                dims.append(len(x) if ok else None)
            cols = [batch.column(0), ids, pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("e"))
    return materialize(rows.mapInArrow(run, "row long, vec_id long, dim int, key binary, v binary"), "neardup-rows"), dtype


def unique_vectors(rows: DataFrame) -> DataFrame:
    """Rows of `keyed` that may link, with rep (a row that holds the value), n (rows that do) and least (smallest vec_id of them)."""
    valid = rows.where("key is not null")
    groups = valid.groupBy("key").agg(F.min("row").alias("rep"), F.count("*").alias("n"), F.min("vec_id").alias("least")).where("n > 1")
    groups = materialize(groups, "neardup-groups").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))))
    salted = valid.withColumn("salt", (F.col("row") % HOT_SALTS).cast("int"))
    out = salted.join(groups, ["key", "salt"], "left")
    return out.select("row", "vec_id", "dim", "v", F.coalesce("rep", "row").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("least", "vec_id").alias("least"))


def dealt(reps: DataFrame, plans: dict[int, Plan], dtype: str) -> DataFrame:
    """reps with their cells, a row for each round and, in hot cells, for each pair of salts that needs them."""

    def run(batches):
        signs: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cells: list = [None] * len(dims)
            for dim in np.unique(dims).tolist():
                plan, at = plans[dim], np.flatnonzero(dims == dim)
                if dim not in signs:
                    signs[dim] = directions(dim, plan.tables * plan.bits, 1)
                y = unit(stacked(batch.column(4).take(pa.array(at)), dtype)) @ signs[dim]
                found = (y > 0).reshape(len(at), plan.tables, plan.bits) @ (1 << np.arange(plan.bits, dtype=np.int32))
                for i, c in zip(at.tolist(), found.astype(np.int32)):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    cells = materialize(reps.mapInArrow(run, "rep long, least long, n long, dim int, v binary, cells array<int>"), "neardup-cells")
    spread = cells.select("*", F.posexplode("cells").alias("t", "cell"))
    key = ["dim", "t", "cell"]
    hot = spread.groupBy(*key).count().where(F.col("count") > BLOCK_ROWS).select(*key, F.ceil(F.col("count") / (BLOCK_ROWS / 2)).cast("int").alias("salts"))
    spread = spread.join(materialize(hot, "neardup-hot"), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    spread = spread.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return spread.select(*key, F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "salt", "rep", "least", "n", "v", "cells")


def runs(batches, keys: list[str]):
    """(values of keys, table) of each run of rows that are equal in keys, across batches."""
    held, now = [], None
    for batch in batches:
        ids = np.column_stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
        cuts = (np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist() if len(ids) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)]) if len(ids) else ():
            if (key := tuple(ids[lo].tolist())) != now:
                if held:
                    yield now, pa.Table.from_batches(held).combine_chunks()
                held, now = [], key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


class Windows:
    """Windows of queries on the sorted lines of others, as ranks: j is in i's window where rank[j] - start[i] < size[i]."""

    def __init__(self, queries: np.ndarray, others: np.ndarray, width: float):
        kind = np.uint16 if len(others) < 1 << 16 else np.uint32
        self.rank = np.empty((others.shape[1], len(others)), kind)
        self.start, self.size = (np.empty((others.shape[1], len(queries)), kind) for _ in range(2))
        for k, (q, y) in enumerate(zip(queries.T, others.T)):
            order = np.argsort(y, kind="stable")
            self.rank[k, order] = np.arange(len(y), dtype=kind)
            start, end = np.searchsorted(y[order], q - width, "left"), np.searchsorted(y[order], q + width, "right")
            self.start[k], self.size[k] = start, end - start

    def collisions(self, rows: slice, cols: slice) -> np.ndarray:
        out = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.uint8)
        for rank, start, size in zip(self.rank[:, cols], self.start[:, rows], self.size[:, rows]):
            out += (rank[None, :] - start[:, None]) < size[:, None]
        return out


def join_groups(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Let label, the root of each node, hold the links (i, j) too."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label == (up := label[label])).all():
            label[:] = up


def cell_links(u: np.ndarray, cells: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, t: int, plan: Plan, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector, root of its group) over pairs of left and right that meet in round t first; left may be right."""
    lines = u @ directions(u.shape[1], LINES, 0)
    left, right = (x[np.argsort(lines[x, 0], kind="stable")] for x in (left, right))
    same = np.array_equal(left, right)
    windows = Windows(lines[left], lines[right], plan.width)
    linked, label = np.zeros(len(u), np.int64), np.arange(len(u))
    for s in range(0, len(left), STEP_ROWS):
        rows = slice(s, min(s + STEP_ROWS, len(left)))
        # both sides are sorted by the first line, so what its windows reach is a range
        cols = slice(s if same else int(windows.start[0, s]), int((windows.start[0, rows].astype(np.int64) + windows.size[0, rows]).max()))
        i, j = np.nonzero(windows.collisions(rows, cols) >= plan.min_count) if cols.stop > cols.start else (np.zeros(0, int),) * 2
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), CHECK_PAIRS):
            a, b = left[s + i[at : at + CHECK_PAIRS]], right[cols.start + j[at : at + CHECK_PAIRS]]
            new = ~(cells[a, :t] == cells[b, :t]).any(axis=1)
            a, b = a[new], b[new]
            ok = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
            a, b = a[ok], b[ok]
            np.add.at(linked, a, n[b])
            np.add.at(linked, b, n[a])
            join_groups(label, a, b)
    return linked, label


def linked_groups(rows: DataFrame, plans: dict[int, Plan], dtype: str, threshold: float) -> DataFrame:
    """(rep, least, linked, other, other_least): per cell and linked vector, its links found there and one vector of its group."""
    keys = ["dim", "t", "cell", "lo", "hi"]
    names = ["rep", "least", "linked", "other", "other_least"]

    def run(batches):
        for (dim, t, _, lo, hi), block in runs(batches, keys):
            if len(block) < 2:
                continue
            col = {c: block.column(c).combine_chunks() for c in ("rep", "least", "n", "salt", "cells", "v")}
            rep, least, n, salt = (col[c].to_numpy() for c in ("rep", "least", "n", "salt"))
            cells = col["cells"].flatten().to_numpy().reshape(len(rep), -1)
            linked, label = cell_links(unit(stacked(col["v"], dtype)), cells, n, np.flatnonzero(salt == lo), np.flatnonzero(salt == hi), t, plans[dim], threshold)
            at = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[at], least[at], linked[at], rep[label[at]], least[label[at]])], names)

    together = rows.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(run, "rep long, least long, linked long, other long, other_least long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    rows, dtype = keyed(vectors)
    members = unique_vectors(rows)
    members = materialize(members.withColumn("v", F.when(F.col("row") == F.col("rep"), F.col("v"))), "neardup-members")
    reps = members.where("v is not null").select("rep", "least", "n", "dim", "v")
    plans = {r["dim"]: search_plan(r["count"], threshold, recall) for r in reps.groupBy("dim").count().collect()}  # a row a length
    found = materialize(linked_groups(dealt(reps, plans, dtype), plans, dtype, threshold), "neardup-links")
    # nodes are ordered by their smallest vec_id, so the least node of a component holds the component's
    node = lambda least, rep: F.struct(F.col(least).alias("least"), F.col(rep).alias("rep"))
    component = connected_components(found.where("rep <> other").select(node("least", "rep").alias("a"), node("other_least", "other").alias("b")))
    component = component.select(F.col("node.rep").alias("rep"), F.col("component.least").alias("component"))
    degree = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    known = reps.select("rep", "least", "n").join(degree, "rep", "left").join(component, "rep", "left")
    known = known.select("rep", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "least").alias("component"), "n")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 1, HOT_SALTS - 1).otherwise(0)))).drop("n")
    salted = members.select("vec_id", "rep", F.when(F.col("n") > 1, F.col("row") % HOT_SALTS).otherwise(0).cast("int").alias("salt"))
    out = salted.join(known, ["rep", "salt"]).select("vec_id", "links", "component")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    kept = F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True))
    return out.unionByName(alone).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"))


#: The result of near_duplicates for tables in DuckDB, by brute force.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS id, a AS seen FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT id, min(seen) AS component FROM r GROUP BY 1), d AS (SELECT a AS id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(d.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN d ON d.id = vec_id
"""
