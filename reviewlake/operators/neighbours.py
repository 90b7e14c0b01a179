"""Nearest rows of a catalogue for a stated set of queries, exactly: tiles of the catalogue meet queries as matrix products.

A task holds one tile of the catalogue (TILE_ROWS vectors) and streams the queries sent to that tile past it, some
hundreds at a time; what leaves the task is k rows a query. `retrieve` sends every query to every tile. `nearest` has an
index: vectors lie in lists around centres fitted on a bounded sample, a list of many rows is many tiles, and each list
knows the least and largest distance of its rows from the centre. A query meets its own list first, which bounds the
distance of its k-th neighbour; by the triangle inequality only lists that can hold a nearer row are met then. So the
result is exact, and the bound only decides how much is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewlake.functions.vectors import dot, doubles, is_finite
from reviewlake.session import materialize, ship

TILE_ROWS, QUERY_ROWS = 16_384, 128
#: Lists at most, and rows of the sample that their centres are fitted on.
MAX_LISTS, SAMPLE_ROWS = 1024, 20_000
DIGITS = 9
#: Room for rounding in bounds and matrix products; what passes is compared exactly.
ROOM = 1e-9
ANSWER = "query long, id long, value double, ahead long"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _units(rows: DataFrame, schema: str, eps: float = 0.0, least: float = 0.0) -> DataFrame:
    """Rows whose last column v is divided by the larger of its norm plus eps and least."""

    def run(batches):
        for batch in filter(len, batches):
            x = _matrix(batch.columns[-1])
            x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)) + eps, least)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], v], batch.schema.names)

    return rows.mapInArrow(run, schema)


def _best(value: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least values, ties by id."""
    if len(value) > 4 * k:
        few = np.flatnonzero(value <= np.partition(value, k - 1)[k - 1])
        return few[np.lexsort((ids[few], value[few]))[:k]]
    return np.lexsort((ids, value))[:k]


def _similar(rows, ids, q, queries, aims, targets, k) -> Iterator[tuple]:
    sims = np.round(q @ rows.T, DIGITS)
    for i, sim in enumerate(sims):
        for j in _best(-sim, ids, k):
            yield queries[i], ids[j], sim[j], None
        if not np.isnan(aims[i]):
            yield queries[i], None, None, int(((sim > aims[i]) & (ids != targets[i])).sum())


def _close(rows, ids, q, queries, aims, targets, k) -> Iterator[tuple]:
    """aims are the largest distances of interest."""
    rough = (q * q).sum(1)[:, None] + (rows * rows).sum(1)[None, :] - 2 * (q @ rows.T)
    rough[queries[:, None] == ids[None, :]] = np.inf
    size = 1 + float(np.abs(rough[np.isfinite(rough)]).max(initial=0))
    for i, near in enumerate(rough):
        most = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
        most = min(most, aims[i] ** 2 if np.isfinite(aims[i]) else np.inf)
        some = np.flatnonzero((near <= most + ROOM * size) & np.isfinite(near))
        gap = np.round(np.sqrt(((rows[some] - q[i]) ** 2).sum(1)), DIGITS)
        for j in _best(gap, ids[some], k):
            yield queries[i], ids[some[j]], gap[j], None


def _meet(catalog: DataFrame, queries: DataFrame, k: int, answer) -> DataFrame:
    """ANSWER rows of catalog (tile, id, v) and queries (tile, query, v, aim, target) that share a tile."""
    ship(catalog.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    rows = catalog.select("tile", F.lit(0).alias("tag"), "id", "v", none("double").alias("aim"), none("long").alias("target"))
    rows = rows.unionByName(queries.select("tile", F.lit(1).alias("tag"), F.col("query").alias("id"), "v", "aim", "target"))
    rows = rows.repartition("tile").sortWithinPartitions("tile", "tag")

    def run(batches):
        now, tile, ids, waiting = None, [], [], []

        def answers():
            if tile and waiting:
                if len(tile) > 1:
                    tile[:], ids[:] = [np.concatenate(tile)], [np.concatenate(ids)]
                q, query, aim, target = (np.concatenate(x) for x in zip(*waiting))
                for at in range(0, len(q), QUERY_ROWS):
                    part = slice(at, at + QUERY_ROWS)
                    out = list(zip(*answer(tile[0], ids[0], q[part], query[part], aim[part], target[part], k)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["query", "id", "value", "ahead"])
            waiting.clear()

        for batch in filter(len, batches):
            tiles, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(tags) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(tiles)]):
                if tiles[a] != now:
                    yield from answers()
                    tile.clear(), ids.clear()
                    now = tiles[a]
                one = batch.slice(a, b - a)
                v, id_ = _matrix(one.column(3)), one.column(2).to_numpy()
                if tags[a] == 0:
                    tile.append(v), ids.append(id_)
                else:
                    aim = one.column(4).to_numpy(zero_copy_only=False).astype(float)
                    target = one.column(5).fill_null(0).to_numpy(zero_copy_only=False)
                    waiting.append((v, id_, aim, target))
                    if sum(len(w[0]) for w in waiting) >= QUERY_ROWS:
                        yield from answers()
        yield from answers()

    return rows.mapInArrow(run, ANSWER)


def _deal(rows: DataFrame, tiles: Column) -> Column:
    """A tile for each row of a written table: by its place there, so that equal rows are dealt like others."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), tiles)


def retrieve(catalog: DataFrame, queries: DataFrame, key: str, vec: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(ranks, top) by cosine of unit vectors: per query the rank and similarity of its target, and its k most similar rows.

    queries has query, target and vec, whose keys are longs; vectors are of one length. Similarities are compared at
    DIGITS decimals, ties go to the smaller key. Rows without a key or a sound vector are left out, and so is the rank
    of a target that is not in the catalogue.
    """
    ship(catalog.sparkSession)
    v = lambda d: d.where(is_finite(doubles(F.col(vec)))).withColumn("v", doubles(F.col(vec)))
    rows = v(catalog).where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "v")
    rows = materialize(_units(rows, "id long, v array<double>", eps=1e-8), "retrieve-rows")
    asked = v(queries).where(F.col("query").isNotNull()).select(F.col("query").cast("long"), F.col("target").cast("long"), "v")
    asked = materialize(_units(asked, "query long, target long, v array<double>", eps=1e-8), "retrieve-asked")
    aims = asked.join(rows.select(F.col("id").alias("target"), F.col("v").alias("w")), "target").groupBy("query").agg(F.max(F.round(dot(F.col("v"), F.col("w")), DIGITS)).alias("aim"))
    asked = materialize(asked.join(aims, "query", "left"), "retrieve-queries")
    tiles = max(1, math.ceil(rows.count() / TILE_ROWS))
    sent = asked.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    found = materialize(_meet(rows.withColumn("tile", _deal(rows, F.lit(tiles))), sent, k, _similar), "retrieve-found")
    ahead = found.where("ahead IS NOT NULL").groupBy("query").agg((F.sum("ahead") + 1).alias("rank")).join(aims, "query").select("query", F.col("aim").alias("similarity"), "rank")
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("value"), "id"))
    top = found.where("ahead IS NULL").withColumn("nth", nth).where(F.col("nth") <= k).select("query", "nth", F.col("id").alias(key), F.col("value").alias("sim"))
    return ahead, top


def _around(centres, x: np.ndarray) -> np.ndarray:
    """Distances of vectors from all centres."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T), 0))


def _in_lists(rows: DataFrame, centres, schema: str) -> DataFrame:
    """Rows with `list`, the nearest centre, and `r`, the distance from it; v is the last column."""

    def run(batches):
        for batch in filter(len, batches):
            x = _matrix(batch.column(batch.num_columns - 1))
            home = _around(centres.value, x).argmin(1)
            r = np.sqrt(((x - centres.value[home]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int64)), pa.array(r)], [*batch.schema.names, "list", "r"])

    return rows.mapInArrow(run, schema)


def nearest(df: DataFrame, queries: DataFrame, key: str, vec: str, k: int, seed: int = 1, unit: bool = False) -> DataFrame:
    """(query, nth, key, distance): the k nearest other rows of each query in euclidean distance, all of them, fewer only where the table has fewer.

    With unit, vectors are divided by their norm (1e-12 at least) first. Keys are longs; a row is other if its key is. Distances are compared at DIGITS decimals, ties go to the smaller key.
    Rows without a key or a sound vector of the table's usual length are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    ship(spark)
    v = lambda d: d.withColumn("v", doubles(F.col(vec))).where(is_finite(F.col("v")))
    usual = v(df).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = usual["n"] if usual else 0

    def fits(d: DataFrame) -> DataFrame:
        rows = v(d).where((F.size("v") == length) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "v")
        return _units(rows, "id long, v array<double>", least=1e-12) if unit else rows

    rows = materialize(fits(df), "nearest-rows")
    n = rows.count()
    if not n:
        return queries.select(F.col(key).cast("long").alias("query"), F.lit(0).alias("nth"), F.col(key).cast("long").alias(key), F.lit(0.0).alias("distance")).limit(0)
    sample = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(SAMPLE_ROWS).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, min(MAX_LISTS, round(math.sqrt(n) / 2))), maxIter=4, initSteps=1, seed=seed).fit(sample)
    centres = spark.sparkContext.broadcast(np.array(model.clusterCenters()))

    lists = materialize(_in_lists(rows, centres, "id long, v array<double>, list long, r double"), "nearest-lists")
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect()  # MAX_LISTS rows at most
    tiles = F.broadcast(spark.createDataFrame([(r["list"], math.ceil(r["n"] / TILE_ROWS)) for r in sizes], "list long, tiles long"))
    place = F.col("list") * F.lit(1 << 32)
    catalog = lists.withColumn("row", F.xxhash64(F.monotonically_increasing_id())).join(tiles, "list").select((place + F.pmod("row", F.col("tiles"))).alias("tile"), "id", "v")
    sent = lambda q: q.join(tiles, "list").withColumn("nth_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select((place + F.col("nth_tile")).alias("tile"), "query", "v", "aim", F.lit(0).cast("long").alias("target"))

    asked = materialize(_in_lists(fits(queries).dropDuplicates(["id", "v"]), centres, "id long, v array<double>, list long, r double").withColumnRenamed("id", "query"), "nearest-queries")
    known = {r["list"]: (r["least"], r["most"]) for r in sizes}
    home = materialize(_meet(catalog, sent(asked.withColumn("aim", F.lit(float("inf")))), k, _close), "nearest-home")
    nth = F.row_number().over(W.partitionBy("query").orderBy("value", "id"))
    bound = home.withColumn("nth", nth).where(F.col("nth") == k).groupBy("query").agg(F.max("value").alias("aim"))
    asked = asked.join(bound, "query", "left").select("query", "list", F.coalesce("aim", F.lit(float("inf"))).alias("aim"), "v")

    def route(batches):
        least, most = (np.array([known.get(j, (np.inf, -np.inf))[i] for j in range(len(centres.value))]) for i in (0, 1))
        for batch in filter(len, batches):
            x, own, aim = _matrix(batch.column(3)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            d = _around(centres.value, x)
            bound = np.maximum(d - most, least - d)
            row, other = np.nonzero((bound <= aim[:, None] + ROOM * (1 + d)) & (own[:, None] != np.arange(d.shape[1])) & (least <= most))
            for at in range(0, len(row), 4096):
                r, o = pa.array(row[at : at + 4096]), other[at : at + 4096]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(r), pa.array(o.astype(np.int64)), batch.column(2).take(r), batch.column(3).take(r)], ["query", "list", "aim", "v"])

    others = asked.mapInArrow(route, "query long, list long, aim double, v array<double>")
    found = home.unionByName(_meet(catalog, sent(others), k, _close)) if len(known) > 1 else home
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "nth", F.col("id").alias(key), F.col("value").alias("distance"))
