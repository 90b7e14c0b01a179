"""Exact medians without the values of a group in one place.

Around the middle ranks of each group bounds are drawn closer and closer: a sketch names two values near them, a count
shows that the middle lies between, and only rows between go on. What is left of a group when it is at most LEAF rows
is ranked. Only comparisons are used, so infinities and ties are no special cases; equal bounds are the median themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from reviewlake.session import materialize

LEAF, ROUNDS, MARGIN = 10_000, 12, 0.005


def join_groups(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on group columns where nulls are equal; without columns, b is one row."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row
    other = b.select(*[F.col(c).alias(f"_by_{i}") if c in by else F.col(c) for i, c in [(by.index(c) if c in by else -1, c) for c in b.columns]])
    same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)])
    return a.join(other, same, how).drop(*[f"_by_{i}" for i in range(len(by))])


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) of every group; null values don't count, a group without others has none; NaN is larger than all numbers."""
    rows = df.select(*by, F.col(value).cast("double").alias("_x"))
    ends = rows.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("_x").alias("_in"))
    bounds = ends.select(*by, "_lo", "_hi", "_in", F.floor((F.col("_in") - 1) / 2).alias("_r1"), F.floor(F.col("_in") / 2).alias("_r2"))
    bounds = materialize(bounds.where("_in > 0"), "median-bounds")
    open_ = (F.col("_in") > LEAF) & (F.col("_lo") != F.col("_hi"))
    between = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    for _ in range(ROUNDS):
        now = bounds.where(open_)
        if now.isEmpty():
            break
        inside = join_groups(rows.where(F.col("_x").isNotNull()), now, by).where(between)
        at = lambda r, more: F.least(F.greatest(F.first(r) / F.first("_in") + F.lit(more), F.lit(0.0)), F.lit(1.0))
        marks = inside.groupBy(*by).agg(*[F.percentile_approx("_x", [k / 200 for k in range(201)], 10_000).alias("_marks"), at("_r1", -MARGIN).alias("_f1"), at("_r2", MARGIN).alias("_f2")])
        near = marks.select(*by, F.element_at("_marks", F.floor(F.col("_f1") * 200).cast("int") + 1).alias("_a"), F.element_at("_marks", F.ceil(F.col("_f2") * 200).cast("int") + 1).alias("_b"))
        near = materialize(join_groups(now, near, by), "median-marks")
        seen = join_groups(rows.where(F.col("_x").isNotNull()), near, by).where(between)
        seen = seen.groupBy(*by).agg(F.count_if(F.col("_x") < F.col("_a")).alias("_below"), F.count_if(F.col("_x") <= F.col("_b")).alias("_upto"))
        # the marks' own order and the ranks between them decide; a sketch that is off leaves the bounds as they were
        good = (F.col("_below") <= F.col("_r1")) & (F.col("_r2") < F.col("_upto"))
        pick = lambda a, b, name: F.when(good, a).otherwise(b).alias(name)
        closer = join_groups(near, seen, by).select(
            *by, pick(F.col("_a"), F.col("_lo"), "_lo"), pick(F.col("_b"), F.col("_hi"), "_hi"), pick(F.col("_upto") - F.col("_below"), F.col("_in"), "_in"),
            pick(F.col("_r1") - F.col("_below"), F.col("_r1"), "_r1"), pick(F.col("_r2") - F.col("_below"), F.col("_r2"), "_r2"))
        bounds = materialize(bounds.where(~open_).unionByName(closer), "median-bounds", replaces=bounds)
    same = bounds.where(F.col("_lo") == F.col("_hi")).select(*by, F.col("_lo").alias("median"))
    left = join_groups(rows.where(F.col("_x").isNotNull()), bounds.where(F.col("_lo") != F.col("_hi")), by).where(between)
    nth = F.row_number().over(W.partitionBy(*by).orderBy("_x")) - 1
    middle = left.withColumn("_n", nth).where((F.col("_n") == F.col("_r1")) | (F.col("_n") == F.col("_r2"))).groupBy(*by).agg((0.5 * F.min("_x") + 0.5 * F.max("_x")).alias("median"))
    return same.unionByName(middle.where(F.col("median").isNotNull()))
