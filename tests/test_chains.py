"""Packers and walks along rows against plain loops, with blocks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import chains, corpus


@pytest.mark.parametrize("n, farthest, block", [(1, 3, 4), (7, 1, 3), (300, 5, 4), (300, 90, 8)])
def test_walks(spark, n, farthest, block):
    rng = random.Random(n)
    next_ = [i + rng.randint(1, farthest) for i in range(n)]
    on, at = [False] * n, 0
    while at < n:
        on[at], at = True, next_[at]
    rows = spark.createDataFrame([(f"r{i}", i, q) for i, q in enumerate(next_)], "name string, place long, next long").repartition(5)
    got = {r["name"]: r["start"] for r in chains.visited(rows, block_rows=block).collect()}
    assert got == {f"r{i}": x for i, x in enumerate(on)}


def test_no_rows(spark):
    assert chains.visited(spark.createDataFrame([], "place long, next long")).count() == 0
    empty = spark.createDataFrame([], "k string, i long, c long")
    assert corpus.greedy_pack(empty, "k", "i", "c", 10).count() == 0 and corpus.token_pack(empty, "k", "i", "c", 10, 2).count() == 0


@pytest.fixture(scope="module")
def rows():
    """A key with two thirds of all rows, a null key, keys of one row, costs of nothing, null and above the budget."""
    rng = random.Random(4)
    keys = ["hot"] * 60 + ["b"] * 20 + [None] * 10 + [f"k{i}" for i in range(10)]
    return [(rng.choice(keys), i, rng.choice([0, None, rng.randint(1, 30), rng.randint(1, 30), 140])) for i in range(700)]


@pytest.mark.parametrize("budget, most", [(100, 5), (100, 2**31), (1000, 40), (1, 3)])
def test_greedy_pack(spark, rows, monkeypatch, budget, most):
    monkeypatch.setattr(chains.visited, "__defaults__", ("place", "next", 32))
    want, state = {}, {}
    for k, i, c in rows:
        batch, used, n = state.get(k, (0, 0, 0))
        c = max(1, c or 0)
        if n and (used + c > budget or n >= most):
            batch, used, n = batch + 1, 0, 0
        state[k], want[i] = (batch, used + c, n + 1), batch
    df = spark.createDataFrame(rows, "k string, i long, c int").repartition(7).withColumn("batch", F.lit(9)).withColumn("place", F.lit(1))
    got = corpus.greedy_pack(df, "k", "i", "c", budget, most).collect()
    assert {r["i"]: r["batch"] for r in got} == want and {(r["k"], r["i"], r["c"]) for r in got} == set(rows)


def test_token_pack(spark, rows, monkeypatch):
    monkeypatch.setattr(chains.visited, "__defaults__", ("place", "next", 16))
    rows = [(k, i, c or 0) for k, i, c in rows]
    want, state = {}, {}
    for k, i, c in sorted(rows, key=lambda r: (-r[2], r[1])):
        batch, room = state.get(k, (-1, 0))
        if room == 0:
            batch, room = batch + 1, max(1, min(6, 100 // max(1, c)))
        state[k], want[i] = (batch, room - 1), batch
    got = corpus.token_pack(spark.createDataFrame(rows, "k string, i long, c int"), "k", "i", "c", 100, 6).collect()
    assert {r["i"]: r["batch"] for r in got} == want


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9), None if i % 7 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a long, b long").repartition(6)
    n, a, b = 0, 0, 0
    want = {}
    for i, x, y in rows:
        want[i] = (n, a, b)
        n, a, b = n + 1, a + x, b + (y or 0)
    got = corpus.with_running(df, ["i"], {"n": None, "sum_a": "a", "sum_b": "b"}).collect()
    assert {r["i"]: (r["n"], r["sum_a"], r["sum_b"]) for r in got} == want
