"""Density clusters against a plain search over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import density, ranking

SCHEMA = "id long, v array<double>, x double, cluster int, n long"


def by_hand(points, eps, min_points):
    """(cluster number or None, core) of each point: all pairs, distances summed in order of the dimensions."""
    p = np.array(points, float)
    gap = np.zeros((len(p), len(p)))
    for i in range(p.shape[1]):
        gap += (p[:, None, i] - p[None, :, i]) ** 2
    near = gap <= eps * eps
    core = near.sum(1) >= min_points
    label = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                new = np.flatnonzero(near[todo.pop()] & core & (label < 0))
                label[new] = i
                todo += new.tolist()
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[np.where(near[i] & core, gap[i], np.inf).argmin()]
    return label, core


def check(spark, points, eps, min_points):
    df = spark.createDataFrame([(i, list(map(float, p)), 1.0, 2, 3) for i, p in enumerate(points)], SCHEMA)
    got = {r["id"]: r for r in density.density_clusters(df, "id", "v", len(points[0]), eps, min_points).collect()}
    label, core = by_hand(points, eps, min_points)
    assert [got[i]["core"] for i in range(len(points))] == core.tolist()
    assert [got[i]["cluster"] is None for i in range(len(points))] == (label < 0).tolist()
    names = {(got[i]["cluster"], label[i]) for i in range(len(points)) if label[i] >= 0}
    assert len(names) == len({a for a, _ in names}) == len({b for _, b in names})  # the same up to renaming
    return len(names)


def blobs(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-3, 3, (7, dims))
    p = np.concatenate([centres[rng.integers(0, 7, n * 3 // 4)] + rng.normal(0, 0.25, (n * 3 // 4, dims)), rng.uniform(-4, 4, (n - n * 3 // 4 - n // 20, dims))])
    return np.concatenate([p, np.repeat(p[:1], n // 20, axis=0)]).tolist()  # a twentieth are copies of one point


@pytest.mark.parametrize("eps", [0.35, 0.8])
def test_two_thousand_points(spark, eps):
    assert check(spark, blobs(1, 2000, 5), eps, 8) > 1


@pytest.mark.parametrize("dims, eps", [(1, 0.01), (3, 0.3)])
def test_other_dimensions(spark, dims, eps):
    check(spark, blobs(dims, 600, dims), eps, 5)


def test_crowded_cells_that_almost_touch(spark, monkeypatch):
    """Two dense plates at a distance of eps and a bit, and two at a bit less: boxes alone don't decide."""
    monkeypatch.setattr(density, "LEAF_PAIRS", 8)
    rng = random.Random(4)
    eps, plates = 1.0, []
    for k, gap in enumerate((1.01, 0.99)):
        plates += [(rng.uniform(0, 0.6), 10.0 * k + rng.uniform(0, 0.02)) for _ in range(150)]
        plates += [(rng.uniform(0, 0.6), 10.0 * k + gap + rng.uniform(0, 0.02)) for _ in range(150)]
    assert check(spark, plates, eps, 20) in (3, 2)


def test_a_third_of_all_points_in_one_place(spark):
    points = [[0.5, 0.5]] * 300 + blobs(9, 600, 2)
    check(spark, points, 0.2, 10)


def test_odd_vectors_are_outliers(spark):
    rows = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [-0.0, 0.0]), (8, [0.0, -0.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0.0, 0, 0) for i, v in rows], SCHEMA)
    got = density.density_clusters(df, "id", "v", 2, 0.1, 3).collect()
    assert len(got) == len(rows) and {r["id"] for r in got if r["cluster"] is not None} == {None, 6, 7, 8, 9}
    assert len({r["cluster"] for r in got if r["cluster"] is not None}) == 2
    assert density.density_clusters(df.limit(0), "id", "v", 2, 0.1, 3).count() == 0
    with pytest.raises(ValueError):
        density.density_clusters(df, "id", "v", 8, 0.1, 3)


def test_topics_are_numbered_by_size(spark):
    rng = np.random.default_rng(3)
    base = np.eye(6)[:3] * 4
    rows = [(i, (base[0 if i < 120 else 1 if i < 180 else 2] + rng.normal(0, 0.05, 6)).tolist()) for i in range(200)] + [(200, (np.ones(6) * 9).tolist()), (201, None), (202, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    topics = ranking.density_topics(df, "id", "v", 0.5, 5, dims=3, min_size=10)
    got = {r["id"]: r["topic"] for r in topics.collect()}
    assert [got[i] for i in (0, 119, 120, 179, 180, 199, 200, 201, 202)] == [0, 0, 1, 1, 2, 2, -1, -1, -1]
    inner = ranking.density_subtopics(df, topics, "id", "v", 0, eps=0.5, min_points=5, dims=3).collect()
    assert len(inner) == 120 and {r["topic"] for r in inner} == {0}
    assert ranking.density_topics(df.limit(0), "id", "v", 0.5, 5).count() == 0
    z = ranking.principal(df.where(F.col("id") < 200), "id", "v", 3).orderBy("id").collect()
    x = np.array([v for _, v in rows[:200]])
    u = (x - 0) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3].T
    assert np.allclose(np.abs([r["z"] for r in z]), np.abs(u))
