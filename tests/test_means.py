"""Means of decimals, and first rows where the order has ties."""

import datetime
import math
import random
import shutil
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from reviewlake import plans
from reviewlake.operators import aggregates

LINES = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_shipdate timestamp"


def test_means_half_way_do_not_depend_on_order(spark):
    rng = random.Random(8)
    cents = {k: [rng.randint(0, 10) for _ in range(31)] + [rng.choice([1, 3, 5, 7, 9])] for k in range(300)}
    rows = [(k, x / 100, i, "a") for k, v in cents.items() for i, x in enumerate(v)]
    want = {k: math.floor(Fraction(sum(v), 3200) * 10**6 + Fraction(1, 2)) / 10**6 for k, v in cents.items()}
    for seed, parts in ((1, 1), (2, 7), (3, 23)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, d double, i int, x string").repartition(parts)
        got = {r["k"]: r["d"] for r in aggregates.mean_scores(df, "k", ["d"], "i", ["x"]).withColumn("d", F.round("d", 6)).collect()}
        assert got == want


def test_means_of_any_doubles(spark):
    values = {0: [1e300, 1.0], 1: [math.pi, math.e], 2: [None, None], 3: [math.inf, 1.0], 4: [math.nan, 1.0], 5: [1e-12, 3e-12], 6: [0.1, None, 0.2], 7: [9e13, 9e13], 8: [-0.5, 0.25], 9: [1.5]}
    df = spark.createDataFrame([(k, x, i, "a") for k, v in values.items() for i, x in enumerate(v)], "k int, d double, i int, x string")
    got = {r["k"]: r["d"] for r in aggregates.mean_scores(df, "k", ["d"], "i", ["x"]).collect()}
    for k, v in values.items():
        v = [x for x in v if x is not None]
        want = sum(v) / len(v) if v else None
        assert got[k] is None if want is None else math.isnan(got[k]) if math.isnan(want) else got[k] == want or abs(got[k] - want) <= 1e-15 * abs(want), k
    assert got[6] == 0.15
    ints = df.withColumn("d", F.col("i").cast("decimal(5,2)"))
    assert aggregates.mean_scores(ints, "k", ["d"], "i", ["x"]).schema["d"].dataType.typeName() == "decimal"


def test_first_lines_of_one_number_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(4)
    day = lambda: datetime.datetime(2000, 1, 1) + datetime.timedelta(days=rng.randint(0, 3000))
    rows = [(rng.randint(1, 3), p, rng.randint(1, 2), float(rng.randint(1, 50)), rng.randint(0, 10) / 100, day()) for p in range(200) for _ in range(10)]
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k * 500 : (k + 1) * 500], LINES).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(4):
        shutil.copy(next((tmp_path / f"w{k}").glob("*.parquet")), tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES["e6_mean_scores"](spark, str(tmp_path)).select("l_partkey", "samples", "l_shipdate").collect())
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (CAST(l_shipdate AS TIMESTAMP) AS l_shipdate) FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT l_partkey, samples, l_shipdate FROM ({plans.ORACLE['e6_mean_scores']})").fetchall())
