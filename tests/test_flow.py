"""Transport on a grid against the dense form, lane tables and names."""

import random

import numpy as np
import pytest

from reviewlake.operators import flow


def dense(a, b, xs, ys, eps, rounds=200_000):
    """Sinkhorn on all pairs of cells, with the median over all pairs of occupied ones."""
    cells = [(x, y) for x in xs for y in ys]
    c = np.array([[(p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for q in cells] for p in cells])
    p, q = a.ravel() / a.sum(), b.ravel() / b.sum()
    k = np.exp(-c / (eps * np.median(c[np.ix_(p > 0, q > 0)])))
    v = np.ones(len(q))
    for _ in range(rounds):
        u = p / (k @ v)
        new = q / (k.T @ u)
        if np.allclose(new, v, rtol=1e-13, atol=0):
            break
        v = new
    return u[:, None] * k * v


@pytest.mark.parametrize("eps", [0.3, 0.05])
def test_grid_plan_is_the_dense_plan(eps):
    rng = np.random.default_rng(1)
    xs, ys = np.linspace(-1, 2, 6), np.linspace(0, 5, 6)
    a, b = (rng.random((6, 6)) * (rng.random((6, 6)) < 0.7) for _ in range(2))
    plan, want = flow.GridPlan(a, b, xs, ys, eps), dense(a, b, xs, ys, eps)
    assert np.abs(np.exp(plan.f + plan.through(plan.g)) - a / a.sum()).sum() <= 1e-9  # source marginal
    assert np.abs(np.exp(plan.g + plan.through(plan.f)) - b / b.sum()).sum() <= 1e-9
    left, right = rng.random((6, 6)), rng.random((6, 6))
    assert abs(plan.between(left, right) - left.ravel() @ want @ right.ravel()) < 1e-8


def test_lane_table(spark):
    rng = random.Random(3)
    rows = [(c, i % 3 if c < 2 else 4, rng.uniform(0, 10), rng.uniform(0, 10), rng.random() + 0.1) for c in range(3) for i in range(90)] + [(9, 1, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "cohort int, lane int, x double, y double, w double")
    box = (-1.0, 11.0, -1.0, 11.0)
    got = flow.lane_flow(df, "cohort", 8, box).collect()
    assert {(r["step"], r["source"], r["target"]) for r in got} == {(0, a, b) for a in range(3) for b in range(3)} | {(1, a, 4) for a in range(3)}
    xs = np.linspace(-1, 11, 8)
    grid = np.zeros((3, 5, 8, 8))
    for c, lane, x, y, w in rows[:-1]:
        grid[c, lane, int((x + 1) / (12 / 7)), int((y + 1) / (12 / 7))] += w
    want = dense(grid[0].sum(0), grid[1].sum(0), xs, xs, 0.3)
    share = [np.divide(g, t, out=np.zeros_like(g), where=t > 0) for g, t in ((grid[k], grid[k].sum(0)) for k in (0, 1))]
    for r in got:
        if r["step"] == 0:
            assert abs(r["mass"] - share[0][r["source"]].ravel() @ want @ share[1][r["target"]].ravel()) < 1e-8
    for step in (0, 1):
        assert abs(sum(r["mass"] for r in got if r["step"] == step) - 1) < 1e-9
        for lane in range(3):
            assert abs(sum(r["share"] for r in got if (r["step"], r["source"]) == (step, lane)) - 1) < 1e-9


def test_lane_names(spark):
    rows = [(0, 1, 0.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 3.0), (1, 2, 1.0, 0.5, 1.0), (2, 3, 9.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "cohort int, lane int, x double, y double, w double")
    assert {r["lane"]: r["name"] for r in flow.lane_names(df, "cohort").collect()} == {1: 1, 2: 1, 3: 2}
