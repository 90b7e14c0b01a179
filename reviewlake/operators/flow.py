"""Cohort flow: heat grids, centres, lanes, transport and bands of weighted points by cohort."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewlake.session import ship


def kernel(sigma: float) -> list[float]:
    """Gaussian weights from -r to r, r = int(4 sigma + 0.5), that sum to 1."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def binned(c: Column, lo: float, hi: float, g: int) -> Column:
    """Cell of a value on g grid points from lo to hi, clipped."""
    return F.least(F.greatest(F.floor((c - lo) / ((hi - lo) / (g - 1))), F.lit(0)), F.lit(g - 1)).cast("int")


def blurred(df: DataFrame, keys: list[str], axis: str, value: str, g: int, sigma: float) -> DataFrame:
    """Each cell spread along an axis by the kernel, zero outside the grid, summed again. Cells are at most g an axis."""
    k = kernel(sigma)
    r = len(k) // 2
    spread = F.explode(F.array(*[F.struct(F.lit(i - r).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(k)]))
    rows = df.withColumn("_s", spread).withColumn(axis, F.col(axis) + F.col("_s.d")).where(F.col(axis).between(0, g - 1))
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * F.col("_s.w")).alias(value))


def heat_grid(points: DataFrame, cohort: str, g: int, box: tuple, sigma: float) -> DataFrame:
    """(cohort, ix, iy, heat): weights binned and blurred; heat sums to 1 in each cohort."""
    x0, x1, y0, y1 = box
    cells = points.groupBy(cohort, binned(F.col("x"), x0, x1, g).alias("ix"), binned(F.col("y"), y0, y1, g).alias("iy")).agg(F.sum("w").alias("heat"))
    for axis in ("ix", "iy"):
        cells = blurred(cells, [cohort, "ix", "iy"], axis, "heat", g, sigma)
    return cells.withColumn("heat", F.col("heat") / F.sum("heat").over(W.partitionBy(cohort)))


def center_of_mass(points: DataFrame, cohort: str) -> DataFrame:
    w = F.sum("w")
    return points.groupBy(cohort).agg((F.sum(F.col("w") * F.col("x")) / w).alias("cx"), (F.sum(F.col("w") * F.col("y")) / w).alias("cy"))


def assign_lanes(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """All columns with lane: weighted k-means, lanes numbered along the first principal axis of the weighted points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x", "y"], outputCol="_f").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="_lane", weightCol="w").fit(rows)
    m = points.agg(*[F.sum(e).alias(n) for n, e in {"w": F.col("w"), "x": F.col("w") * F.col("x"), "y": F.col("w") * F.col("y"), "xx": F.col("w") * F.col("x") ** 2, "yy": F.col("w") * F.col("y") ** 2, "xy": F.col("w") * F.col("x") * F.col("y")}.items()]).first()
    mx, my = m["x"] / m["w"], m["y"] / m["w"]
    cov = np.array([[m["xx"] / m["w"] - mx * mx, m["xy"] / m["w"] - mx * my], [m["xy"] / m["w"] - mx * my, m["yy"] / m["w"] - my * my]])
    axis = np.linalg.eigh(cov)[1][:, -1]
    axis = axis * (1 if axis[np.argmax(np.abs(axis))] > 0 else -1)
    order = np.argsort([float(np.dot(c, axis)) for c in model.clusterCenters()], kind="stable")
    place = F.array(*[F.lit(int(np.flatnonzero(order == i)[0])) for i in range(len(order))])
    return model.transform(rows).withColumn("lane", F.element_at(place, F.col("_lane") + 1)).drop("_f", "_lane")


def lane_heat(points: DataFrame, cohort: str) -> DataFrame:
    """(lane, cohort, heat): the lane's share of the cohort's weight."""
    rows = points.groupBy("lane", cohort).agg(F.sum("w").alias("heat"))
    return rows.withColumn("heat", F.col("heat") / F.sum("heat").over(W.partitionBy(cohort)))


def bands(heat: DataFrame, cohort: str, gap: float) -> DataFrame:
    """(cohort, lane, lo, hi): lanes stacked in order with gaps, centred on 0."""
    every = W.partitionBy(cohort)
    base = -(F.sum("heat").over(every) + gap * (F.count("*").over(every) - 1)) / 2
    before = F.coalesce(F.sum(F.col("heat") + gap).over(every.orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return heat.select(cohort, "lane", (base + before).alias("lo"), (base + before + F.col("heat")).alias("hi"))


def cells_of(points: DataFrame, cohort: str, g: int, box: tuple) -> DataFrame:
    """(cohort, ix, iy, x, y, w): points as weighted cell centres of gravity; at most g * g a cohort, whatever the input."""
    x0, x1, y0, y1 = box
    keys = [F.col(cohort), binned(F.col("x"), x0, x1, g).alias("ix"), binned(F.col("y"), y0, y1, g).alias("iy")]
    w = F.sum("w")
    return points.groupBy(*keys).agg((F.sum(F.col("w") * F.col("x")) / w).alias("x"), (F.sum(F.col("w") * F.col("y")) / w).alias("y"), w.alias("w"))


def transport(cells: DataFrame, cohort: str, iters: int = 400, eps: float = 0.3) -> DataFrame:
    """(cohort, sx, sy, dx, dy, mass): entropic transport from each cohort's cells to the next one's, a task a transition.

    Cost is squared distance, the entropy eps times its median; masses sum to 1 in a transition. Cells are bounded.
    """
    ship(cells.sparkSession)
    steps = cells.select(F.col(cohort).alias("step"), F.lit(0).alias("side"), "x", "y", "w").unionByName(cells.select((F.col(cohort) - 1).alias("step"), F.lit(1).alias("side"), "x", "y", "w"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == s].sort_values(["x", "y"]) for s in (0, 1))
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in ("step", "sx", "sy", "dx", "dy", "mass")})
        cost = (a.x.to_numpy()[:, None] - b.x.to_numpy()) ** 2 + (a.y.to_numpy()[:, None] - b.y.to_numpy()) ** 2
        k = np.exp(-cost / max(eps * np.median(cost), 1e-12))
        p, q = a.w.to_numpy() / a.w.sum(), b.w.to_numpy() / b.w.sum()
        u, v = np.ones(len(p)), np.ones(len(q))
        for _ in range(iters):
            u = p / (k @ v + 1e-300)
            v = q / (k.T @ u + 1e-300)
        plan = u[:, None] * k * v
        i, j = np.nonzero(plan > 1e-12)
        return pd.DataFrame({"step": pdf.step.iloc[0], "sx": a.x.to_numpy()[i], "sy": a.y.to_numpy()[i], "dx": b.x.to_numpy()[j], "dy": b.y.to_numpy()[j], "mass": plan[i, j]})

    return steps.groupBy("step").applyInPandas(solve, "step long, sx double, sy double, dx double, dy double, mass double")


def displacement(plan: DataFrame) -> DataFrame:
    """(step, sx, sy, ux, uy, mass): the mean move of each source cell's mass."""
    m = F.sum("mass")
    return plan.groupBy("step", "sx", "sy").agg((F.sum(F.col("mass") * F.col("dx")) / m - F.col("sx")).alias("ux"), (F.sum(F.col("mass") * F.col("dy")) / m - F.col("sy")).alias("uy"), m.alias("mass"))


def flow_field(moves: DataFrame, g: int, box: tuple, sigma: float, mask: float = 0.02) -> DataFrame:
    """(step, ix, iy, ux, uy, speed): mass-weighted mean move splatted on a grid; cells under mask of the peak mass are left out."""
    x0, x1, y0, y1 = box
    rows = moves.groupBy("step", binned(F.col("sx"), x0, x1, g).alias("ix"), binned(F.col("sy"), y0, y1, g).alias("iy")).agg(
        F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("ux")).alias("mu"), F.sum(F.col("mass") * F.col("uy")).alias("mv"))
    k = kernel(sigma)
    r = len(k) // 2
    for axis in ("ix", "iy"):
        spread = F.explode(F.array(*[F.struct(F.lit(i - r).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(k)]))
        rows = rows.withColumn("_s", spread).withColumn(axis, F.col(axis) + F.col("_s.d")).where(F.col(axis).between(0, g - 1))
        rows = rows.groupBy("step", "ix", "iy").agg(*[F.sum(F.col(c) * F.col("_s.w")).alias(c) for c in ("m", "mu", "mv")])
    rows = rows.withColumn("_top", F.max("m").over(W.partitionBy("step"))).where(F.col("m") >= mask * F.col("_top"))
    out = rows.select("step", "ix", "iy", (F.col("mu") / F.col("m")).alias("ux"), (F.col("mv") / F.col("m")).alias("uy"))
    return out.withColumn("speed", F.hypot("ux", "uy"))


def river(plan: DataFrame, axis: tuple[float, float], bins: int, lo: float, hi: float, sub: int, sigma: float) -> DataFrame:
    """(step, part, bin, density): mass on the way between cohorts, projected on an axis, blurred; sums to 1 in each part."""
    rows = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sub - 1)))).withColumn("_t", F.col("part") / sub)
    at = lambda a, b: F.col(a) + F.col("_t") * (F.col(b) - F.col(a))
    z = at("sx", "dx") * axis[0] + at("sy", "dy") * axis[1]
    rows = rows.groupBy("step", "part", binned(z, lo, hi, bins).alias("bin")).agg(F.sum("mass").alias("density"))
    rows = blurred(rows, ["step", "part", "bin"], "bin", "density", bins, sigma)
    return rows.withColumn("density", F.col("density") / F.sum("density").over(W.partitionBy("step", "part")))


def lane_names(points: DataFrame, cohort: str, name: str | None = None) -> DataFrame:
    """(lane, name): the cohort (or its name) whose centre of mass is nearest to the lane's; the smaller cohort settles ties.

    Lanes and cohorts are few, so each lane's row meets a row a cohort.
    """
    w = F.sum("w")
    lanes = points.groupBy("lane").agg((F.sum(F.col("w") * F.col("x")) / w).alias("lx"), (F.sum(F.col("w") * F.col("y")) / w).alias("ly"))
    label = F.min(name or cohort).alias("name")
    centres = points.groupBy(F.col(cohort).alias("_c")).agg((F.sum(F.col("w") * F.col("x")) / w).alias("cx"), (F.sum(F.col("w") * F.col("y")) / w).alias("cy"), label)
    gap = F.pow(F.col("lx") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("ly") - F.col("cy"), F.lit(2.0))
    near = F.min(F.struct(F.round(gap, 9).alias("gap"), "_c", "name"))
    return lanes.join(centres, F.lit(True)).groupBy("lane").agg(near.alias("n")).select("lane", "n.name")


class GridPlan:
    """Entropic transport between two masses on one grid, by Sinkhorn's rounds in logarithms.

    Squared distance between cell centres is a sum over x and y, so the kernel is a product of one over x and one over
    y: a round costs two sums over g x g x g numbers, not one over (g x g) x (g x g).
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, eps: float, close: float = 1e-10, rounds: int = 20_000):
        self.a, self.b = a / a.sum(), b / b.sum()
        self.eps = max(eps * self._median(a > 0, b > 0, xs, ys), 1e-12)
        self.kx, self.ky = (-((v[:, None] - v[None, :]) ** 2) / self.eps for v in (xs, ys))
        with np.errstate(divide="ignore"):
            la, lb = np.log(self.a), np.log(self.b)
        f, g = np.zeros_like(self.a), np.zeros_like(self.b)
        for _ in range(rounds):
            f = np.where(self.a > 0, la - self.through(g + np.where(self.b > 0, 0, -np.inf)), -np.inf)
            g = np.where(self.b > 0, lb - self.through(f), -np.inf)
            if np.abs(np.exp(f + self.through(g)) - self.a).sum() <= close:
                break
        self.f, self.g = f, g

    @staticmethod
    def _median(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> float:
        """Median squared distance of an occupied cell of a and one of b, from how many pairs lie at each offset."""
        shape = [2 * n for n in a.shape]
        pairs = np.rint(np.fft.irfft2(np.fft.rfft2(a, shape) * np.conj(np.fft.rfft2(b, shape)), shape)).astype(np.int64)
        dx, dy = (np.minimum(np.arange(2 * len(v)), 2 * len(v) - np.arange(2 * len(v))) * (v[1] - v[0] if len(v) > 1 else 0.0) for v in (xs, ys))
        cost = (dx[:, None] ** 2 + dy[None, :] ** 2).ravel()
        order = np.argsort(cost, kind="stable")
        upto = np.cumsum(pairs.ravel()[order])
        n = int(upto[-1])
        at = lambda k: cost[order][np.searchsorted(upto, k, "right")]
        return float((at((n - 1) // 2) + at(n // 2)) / 2)

    def through(self, v: np.ndarray) -> np.ndarray:
        """log of the kernel times exp(v)."""
        return _log_sum(self.kx, _log_sum(self.ky, v.T).T)

    def between(self, left: np.ndarray, right: np.ndarray) -> float:
        """Mass from the cells' shares `left` to the cells' shares `right`."""
        with np.errstate(divide="ignore"):
            return float((left * np.exp(self.f + self.through(self.g + np.log(right)))).sum())


def _log_sum(k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """log of exp(k) @ exp(v)."""
    top = v.max(axis=0)
    top = np.where(np.isfinite(top), top, 0.0)
    rows = k[:, :, None] + (v - top)[None]
    high = rows.max(axis=1)
    safe = np.where(np.isfinite(high), high, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(rows - safe[:, None, :]).sum(axis=1)) + safe + top


def lane_flow(points: DataFrame, cohort: str, g: int, box: tuple, eps: float = 0.3) -> DataFrame:
    """(step, source, target, mass, share): what each lane of a cohort sends to each lane of the next one, a task a transition.

    Points are binned to centres of g x g cells; a cell's mass leaves and arrives by its lanes' weights. Masses sum to
    1 in a transition, shares to 1 in a source lane. eps is a share of the median squared distance.
    """
    ship(points.sparkSession)
    x0, x1, y0, y1 = box
    cells = points.groupBy(F.col(cohort).cast("long").alias("c"), binned(F.col("x"), x0, x1, g).alias("ix"), binned(F.col("y"), y0, y1, g).alias("iy"), F.col("lane").cast("long").alias("lane")).agg(F.sum("w").alias("w"))
    side = lambda k: cells.select((F.col("c") - k).alias("step"), F.lit(k).alias("side"), "ix", "iy", "lane", "w")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = [pdf[pdf.side == k] for k in (0, 1)]
        if all(s.w.sum() > 0 for s in sides):
            shares = []
            for s in sides:
                cube = {lane: np.zeros((g, g)) for lane in sorted(s.lane.unique())}
                for lane, own in s.groupby("lane"):
                    np.add.at(cube[lane], (own.ix.to_numpy(), own.iy.to_numpy()), own.w.to_numpy())
                shares.append(cube)
            totals = [sum(cube.values()) for cube in shares]
            xs, ys = np.linspace(x0, x1, g), np.linspace(y0, y1, g)
            plan = GridPlan(*totals, xs, ys, eps)
            of = lambda cube, total, lane: np.divide(cube[lane], total, out=np.zeros_like(total), where=total > 0)
            for a in shares[0]:
                row = [(b, plan.between(of(shares[0], totals[0], a), of(shares[1], totals[1], b))) for b in shares[1]]
                whole = sum(m for _, m in row)
                out += [(int(pdf.step.iloc[0]), a, b, m, m / whole if whole else 0.0) for b, m in row]
        return pd.DataFrame(out, columns=["step", "source", "target", "mass", "share"])

    return side(0).unionByName(side(1)).groupBy("step").applyInPandas(solve, "step long, source long, target long, mass double, share double")
