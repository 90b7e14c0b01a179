"""Density clusters of points in a few dimensions, exact at any size: grid cells, core counts, components of cells.

A point is core when at least min_points points (itself too) lie within eps of it; core points within eps of each
other are in one cluster; another point within eps of a core point belongs to the nearest one's cluster; the rest are
outliers. Points of a cell are within eps of each other, because the cell's diagonal is eps. So all points of a cell
with min_points points are core and need no comparison, and all core points of a cell are in one cluster: only points
of thin cells, fewer than min_points a cell, meet the points of neighbouring cells, one by one. That is linear in a
crowded cell. Whether two cells' core points touch follows from one point of each or their bounding boxes, where these are near or far
enough; the few pairs that are neither and not connected by other cells are split into smaller boxes until they are.

Equal points are one position with a weight, so a group of copies costs one.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.vectors import doubles, is_finite
from reviewlake.operators.components import connected_components
from reviewlake.operators.corpus import with_ordinal
from reviewlake.session import materialize

MAX_DIMS = 7
#: Pairs of points of two boxes that are compared one by one; more are split first, each side into 4 ** dims boxes.
LEAF_PAIRS, SPLIT = 1024, 4
SLACK = 1e-9


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _apart(a: str, b: str, dims: int) -> Column:
    """Squared distance of two points."""
    gaps = [F.col(a)[i] - F.col(b)[i] for i in range(dims)]
    return _total([g * g for g in gaps])


def _box_gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str, dims: int, far: bool) -> Column:
    """Squared distance of two boxes, of their nearest or their farthest points."""
    parts = []
    for i in range(dims):
        one, other = F.col(lo_a)[i] - F.col(hi_b)[i], F.col(lo_b)[i] - F.col(hi_a)[i]
        gap = F.greatest(-one, -other) if far else F.greatest(one, other, F.lit(0.0))
        parts.append(gap * gap)
    return _total(parts)


def _boxes(points: DataFrame, by: list[str], dims: int, *more: Column) -> DataFrame:
    lo, hi = F.array(*[F.min(F.col("x")[i]) for i in range(dims)]), F.array(*[F.max(F.col("x")[i]) for i in range(dims)])
    return points.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"), F.count("*").alias("m"), *more)


def _neighbours(cells: DataFrame, dims: int, eps2: float) -> DataFrame:
    """(a, b) of cells whose points' boxes come within eps, a < b: cells of a coarse cell and those around it."""
    wide = math.ceil(math.sqrt(dims))
    coarse = cells.select("cid", "lo", "hi", F.transform("cell", lambda c: F.floor(c / wide)).alias("coarse"))
    around = [o for o in itertools.product((-1, 0, 1), repeat=dims) if o >= (0,) * dims]  # each pair of coarse cells once
    offsets = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in around])
    seen = coarse.select("coarse").distinct()
    near = seen.withColumn("o", F.explode(offsets)).select("coarse", F.zip_with("coarse", "o", lambda c, o: c + o).alias("other"))
    near = near.join(seen.withColumnRenamed("coarse", "other"), "other")
    left = coarse.select("coarse", F.col("cid").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = coarse.select(F.col("coarse").alias("other"), F.col("cid").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = near.join(left, "coarse").join(right, "other").where((F.col("coarse") != F.col("other")) | (F.col("a") < F.col("b")))
    pairs = pairs.where(_box_gap("lo_a", "hi_a", "lo_b", "hi_b", dims, False) <= eps2 * (1 + SLACK))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _meetings(points: DataFrame, pairs: DataFrame, cells: DataFrame, dims: int, eps2: float) -> DataFrame:
    """(id, x, other, near, far): points and the cells that may hold points within eps of them, with the boxes' distances."""
    ways = pairs.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    rows = points.select("id", "x", "cid").join(ways, "cid").join(cells.select(F.col("cid").alias("other"), "lo", "hi", "n"), "other")
    gap = lambda far: _box_gap("x", "x", "lo", "hi", dims, far)
    return rows.select("id", "x", "other", "n", gap(False).alias("near"), gap(True).alias("far")).where(F.col("near") <= eps2 * (1 + SLACK))


def _touching(pairs: DataFrame, core: DataFrame, dims: int, eps: float) -> DataFrame:
    """Of pairs (a, b) of cells those with core points within eps: boxes are split until each pair of them is decided."""
    eps2, found = eps * eps, None
    used = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    points = materialize(core.join(used, "cid", "left_semi").select("id", "cid", "x", F.col("cid").alias("box")), "density-points")
    open_ = pairs.select("a", "b", F.col("a").alias("p"), F.col("b").alias("q"))
    while not open_.isEmpty():
        boxes = _boxes(points, ["box"], dims)
        of = lambda c, s: boxes.select(F.col("box").alias(c), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"), F.col("m").alias(f"m_{s}"))
        rows = open_.join(of("p", "a"), "p").join(of("q", "b"), "q")
        near, far = (_box_gap("lo_a", "hi_a", "lo_b", "hi_b", dims, f) for f in (False, True))
        rows = materialize(rows.select("a", "b", "p", "q", (F.col("m_a") * F.col("m_b")).alias("work"), near.alias("near"), far.alias("far")).where(F.col("near") <= eps2 * (1 + SLACK)), "density-boxes")
        sure = rows.where(F.col("far") <= eps2 * (1 - SLACK)).select("a", "b").distinct()
        open_ = rows.join(sure, ["a", "b"], "left_anti")
        few = open_.where(F.col("work") <= LEAF_PAIRS)
        met = few.join(points.select(F.col("box").alias("p"), F.col("x").alias("x")), "p").join(points.select(F.col("box").alias("q"), F.col("x").alias("y")), "q")
        met = met.where(_apart("x", "y", dims) <= eps2).select("a", "b").distinct()
        now = materialize(sure.unionByName(met).distinct(), "density-touching")
        found = now if found is None else found.unionByName(now)
        open_ = open_.where(F.col("work") > LEAF_PAIRS).join(now, ["a", "b"], "left_anti")
        # boxes that are still open fall into smaller ones along each side that has an extent; each is named by its least id
        cut = F.transform(F.arrays_zip("x", "lo", "hi"), lambda v: F.when(v["hi"] > v["lo"], F.least(F.floor((v["x"] - v["lo"]) / (v["hi"] - v["lo"]) * SPLIT), F.lit(SPLIT - 1))).otherwise(0))
        small = points.join(boxes.select("box", "lo", "hi"), "box").select("id", "cid", "x", "box", cut.alias("place"))
        names = small.groupBy("box", "place").agg(F.min("id").alias("part"))
        points = materialize(small.join(names, ["box", "place"]).select("id", "cid", "x", F.col("part").alias("box"), F.col("box").alias("whole")), "density-points")
        parts = points.select("whole", "box").distinct()
        open_ = open_.select("a", "b", "p", "q").join(parts.select(F.col("whole").alias("p"), F.col("box").alias("pp")), "p").join(parts.select(F.col("whole").alias("q"), F.col("box").alias("qq")), "q")
        open_ = materialize(open_.select("a", "b", F.col("pp").alias("p"), F.col("qq").alias("q")), "density-open")
        points = points.drop("whole")
    return pairs.limit(0) if found is None else found


def density_clusters(df: DataFrame, key: str, vec: str, dims: int, eps: float, min_points: int) -> DataFrame:
    """(key, cluster, core): cluster is a number of its own, null for outliers. key is a long and unique; vec has dims finite doubles.

    A row whose vector is null, of another length, or not finite is an outlier. A null key stays null and is a point
    like others.
    """
    if not 1 <= dims <= MAX_DIMS:
        raise ValueError(f"1 to {MAX_DIMS} dimensions")
    eps2, side = eps * eps, eps / math.sqrt(dims) * (1 - SLACK)
    x = F.array(*[F.get(F.col(vec), F.lit(i)).cast("double") + F.lit(0.0) for i in range(dims)])
    fits = is_finite(doubles(F.col(vec))) & (F.size(vec) == dims)
    rows = df.select(F.col(key), F.when(fits, x).alias("x"))
    numbered = with_ordinal(rows.where(F.col("x").isNotNull()).groupBy("x").agg(F.count("*").alias("w")), ["x"], "id")
    places = numbered.select("id", "w", "x", F.transform("x", lambda v: F.floor(v / side)).alias("cell"))
    places = materialize(places, "density-places")

    cells = materialize(_boxes(places, ["cell"], dims, F.sum("w").alias("n"), F.min("id").alias("cid")), "density-cells")
    points = materialize(places.join(cells.select("cell", "cid", "n"), "cell").select("id", "w", "x", "cid", "n"), "density-rows")
    pairs = materialize(_neighbours(cells, dims, eps2), "density-pairs")

    thin = points.where(F.col("n") < min_points)
    met = materialize(_meetings(thin, pairs, cells, dims, eps2), "density-meetings")
    whole = F.col("far") <= eps2 * (1 - SLACK)
    some = met.where(~whole).join(points.select(F.col("cid").alias("other"), F.col("x").alias("y"), "w"), "other").where(_apart("x", "y", dims) <= eps2)
    counts = thin.select("id", F.col("n").alias("k")).unionByName(met.where(whole).select("id", F.col("n").alias("k"))).unionByName(some.select("id", F.col("w").alias("k")))
    enough = counts.groupBy("id").agg(F.sum("k").alias("k")).where(F.col("k") >= min_points).select("id", F.lit(True).alias("enough"))
    points = materialize(points.join(enough, "id", "left").select("id", "x", "cid", "n", ((F.col("n") >= min_points) | F.coalesce("enough", F.lit(False))).alias("core")), "density-core")

    core = points.where("core").select("id", "x", "cid")
    halls = materialize(_boxes(core, ["cid"], dims, F.min_by("x", "id").alias("one")).withColumn("n", F.col("m")), "density-halls")
    of = lambda c, s: halls.select(F.col("cid").alias(c), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"), F.col("one").alias(f"one_{s}"))
    linked = pairs.join(of("a", "a"), "a").join(of("b", "b"), "b")
    near, far = (_box_gap("lo_a", "hi_a", "lo_b", "hi_b", dims, f) for f in (False, True))
    linked = materialize(linked.where(near <= eps2 * (1 + SLACK)).select("a", "b", ((far <= eps2 * (1 - SLACK)) | (_apart("one_a", "one_b", dims) <= eps2)).alias("sure")), "density-links")
    label = _labels(halls, linked.where("sure"))
    named = lambda c: label.select(F.col("cid").alias(c), F.col("label").alias(f"label_{c}"))
    unsure = linked.where(~F.col("sure")).join(named("a"), "a").join(named("b"), "b").where("label_a <> label_b").select("a", "b")
    more = _touching(materialize(unsure, "density-unsure"), core, dims, eps)
    more = more.join(named("a"), "a").join(named("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    joined = _labels(label.select(F.col("label").alias("cid")).distinct(), more).select(F.col("cid").alias("label"), F.col("label").alias("cluster"))
    label = materialize(label.join(joined, "label").select("cid", "cluster"), "density-labels")

    edge = points.where(~F.col("core"))
    own = edge.select(F.col("cid").alias("a")).distinct().withColumn("b", F.col("a"))
    reach = _meetings(edge, pairs.unionByName(own), halls, dims, eps2).dropDuplicates(["id", "other"])
    reach = reach.join(core.select(F.col("cid").alias("other"), F.col("x").alias("y")), "other").withColumn("gap", _apart("x", "y", dims)).where(F.col("gap") <= eps2)
    nearest = reach.join(label.withColumnRenamed("cid", "other"), "other").groupBy("id").agg(F.min(F.struct("gap", "cluster")).alias("b")).select("id", F.col("b.cluster").alias("cluster"), F.lit(False).alias("core"))
    placed = core.join(label, "cid").select("id", "cluster", F.lit(True).alias("core")).unionByName(nearest)
    placed = places.select("id", "x").join(placed, "id").select("x", "cluster", "core")
    return rows.join(placed, "x", "left").select(key, "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, label) of all nodes, their own number where they have no link."""
    found = connected_components(links.select("a", "b")).select(F.col("node").alias("cid"), F.col("component").alias("label"))
    return materialize(nodes.select("cid").join(found, "cid", "left").select("cid", F.coalesce("label", "cid").alias("label")), "density-labels")
