"""Medians against numpy, with bounds that have to close in."""

import random

import numpy as np
import pytest

from reviewlake.operators import aggregates, quantiles


@pytest.mark.parametrize("leaf", [10_000, 5])
def test_medians(spark, monkeypatch, leaf):
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    rng = random.Random(leaf)
    rows = [("hot", "x", rng.gauss(0, 1)) for _ in range(1500)] + [("hot", None, float(rng.randint(0, 3))) for _ in range(301)] + [(None, "x", v) for v in (1.0, 2.0, None)]
    rows += [("same", "x", 7.0)] * 50 + [("none", "x", None), ("two", "x", 1.0), ("two", "x", float("inf")), ("heavy", "x", -1.0), ("heavy", "x", 1e300)] + [("heavy", "x", 0.0)] * 40
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, m string, v double, median int").repartition(6)
    got = {(r["k"], r["m"]): r["median"] for r in quantiles.medians(df, ["k", "m"], "v").collect()}
    want = {}
    for k, m in {r[:2] for r in rows}:
        values = [v for a, b, v in rows if (a, b) == (k, m) and v is not None]
        if values:
            want[k, m] = float(np.median(values))
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 4001])
def test_median_of_all_rows(spark, monkeypatch, n):
    """Without keys no task ranks more than LEAF rows."""
    monkeypatch.setattr(quantiles, "LEAF", 20)
    rng = random.Random(n)
    values = [rng.choice([rng.random(), 0.25]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["median"] for r in quantiles.medians(df, [], "v").collect()] == [float(np.median(values))]


def test_stats_of_groups_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), (None, 2.0), (None, 4.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["median"]) for r in aggregates.metric_stats(df, ["k"], "v").collect()}
    assert got == {"a": (0, None), "b": (1, 1.0), None: (2, 3.0)}
    assert quantiles.medians(df.limit(0), ["k"], "v").count() == 0 and quantiles.medians(df.limit(0), [], "v").count() == 0
