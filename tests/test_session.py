"""Intermediate tables: written, read back, and deleted when a later one takes their place."""

import os

from pyspark.sql import functions as F

from reviewlake.session import materialize, shared_dir


def folders(spark):
    top = f"{shared_dir(spark).removeprefix('file://')}/reviewlake"
    return {f for f in os.listdir(top) if f.startswith("kept-")} if os.path.isdir(top) else set()


def test_replaced_tables_go(spark):
    before = folders(spark)
    now = materialize(spark.range(10), "kept-0")
    for k in range(1, 4):
        now = materialize(now.select((F.col("id") + 1).alias("id")), f"kept-{k}", replaces=now)
    assert sorted(r["id"] for r in now.collect()) == list(range(3, 13))
    left = folders(spark) - before
    assert len(left) == 1 and left.pop().startswith("kept-3")
    other = materialize(now, "kept-4", replaces=spark.range(3))  # a frame that is no such table deletes nothing
    assert other.count() == 10 and len(folders(spark) - before) == 2
