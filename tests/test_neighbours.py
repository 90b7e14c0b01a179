"""Retrieval and nearest rows against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import neighbours as N

SCHEMA = "id long, v array<double>, query long, value double, tile long, list long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3, 4) for i, v in rows], SCHEMA)


def by_hand(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = set()
    for q, v in {(q, tuple(v)) for q, v in queries}:
        gap = np.round(np.sqrt(((x - np.array(v)) ** 2).sum(1)), N.DIGITS)
        best = sorted((g, i) for g, i in zip(gap.tolist(), ids.tolist()) if i != q)[:k]
        out |= {(q, n + 1, i, round(g, 6)) for n, (g, i) in enumerate(best)}
    return out


def clustered(seed, n, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, (12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.3, (n, dims))
    x[: n // 3] = x[0] + rng.normal(0, 1e-4, (n // 3, dims))  # a third are near copies
    x[n // 3 : n // 3 + 20] = x[0]  # and some are copies
    return list(enumerate(x.tolist()))


@pytest.mark.parametrize("tile, part, k", [(16_384, 128, 6), (50, 7, 1), (50, 7, 6)])
def test_nearest_are_all_found(spark, monkeypatch, tile, part, k):
    monkeypatch.setattr(N, "TILE_ROWS", tile)
    monkeypatch.setattr(N, "QUERY_ROWS", part)
    rows = clustered(1, 900)
    df = frame(spark, rows).repartition(5)
    got = {(r["query"], r["nth"], r["id"], round(r["distance"], 6)) for r in N.nearest(df, df.where("id % 20 = 0"), "id", "v", k).collect()}
    assert got == by_hand(rows, [r for r in rows if r[0] % 20 == 0], k)


def test_bounds_leave_most_lists_out(spark, monkeypatch):
    met, meet = [], N._meet
    monkeypatch.setattr(N, "_meet", lambda catalog, queries, *rest: met.append(queries.count()) or meet(catalog, queries, *rest))
    rows = clustered(2, 1200)
    df = frame(spark, rows)
    N.nearest(df, df.where("id % 20 = 0"), "id", "v", 3).count()
    assert met[0] == 60 and met[1] < 60 * 5  # of some 17 lists


def test_fewer_rows_than_asked_for_and_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0])]
    odd = [(4, None), (5, [1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [float("nan"), 0.0])]
    df = frame(spark, rows + odd)
    got = sorted((r["query"], r["nth"], r["id"], r["distance"]) for r in N.nearest(df, df, "id", "v", 5).collect())
    five = round(5**0.5, 9)
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 2.0), (1, 3, 3, 2.0), (2, 1, 1, 1.0), (2, 2, 3, five), (2, 3, 3, five), (3, 1, 1, 2.0), (3, 2, 2, five)]
    assert N.nearest(df.limit(0), df, "id", "v", 5).count() == 0 and N.nearest(df, df.limit(0), "id", "v", 5).count() == 0


@pytest.mark.parametrize("tile, part", [(16_384, 128), (40, 5)])
def test_retrieval_ranks(spark, monkeypatch, tile, part):
    monkeypatch.setattr(N, "TILE_ROWS", tile)
    monkeypatch.setattr(N, "QUERY_ROWS", part)
    rows = clustered(3, 400)
    x = np.array([v for _, v in rows])
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    df = frame(spark, rows).repartition(3)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query"), F.when(F.col("id") == 40, 10_000).otherwise(F.col("id") + 1).alias("target"), "v")
    ranks, top = N.retrieve(df, asked, "id", "v", 4)
    want_ranks, want_top = {}, set()
    for q in range(0, 400, 20):
        sims = np.round(u @ u[q], N.DIGITS)
        if q != 40:
            want_ranks[q] = (round(sims[q + 1], 6), 1 + int((np.delete(sims, q + 1) > sims[q + 1]).sum()))
        want_top |= {(q, n + 1, i, round(-s, 6)) for n, (s, i) in enumerate(sorted(zip((-sims).tolist(), range(400)))[:4])}
    assert {r["query"]: (round(r["similarity"], 6), r["rank"]) for r in ranks.collect()} == want_ranks
    assert {(r["query"], r["nth"], r["id"], round(r["sim"], 6)) for r in top.collect()} == want_top
