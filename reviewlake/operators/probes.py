"""Linear probes fitted by distributed sums, and their application."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.text import logit, sigmoid
from reviewlake.functions.vectors import cosine, dot, scale
from reviewlake.operators.aggregates import regression_metrics
from reviewlake.operators.quantiles import medians
from reviewlake.session import materialize, ship


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def gram(df: DataFrame, x: str, y: list[str], by: str) -> dict:
    """Per value of by: n, sums and products of x and targets. A task keeps one matrix a fold; D x D is all that travels."""
    ship(df.sparkSession)

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby("_by"):
                z = np.column_stack([np.ones(len(part)), np.stack(part["_x"].to_numpy()), part[[f"_y{i}" for i in range(len(y))]].to_numpy()])
                sums[k] = sums.get(k, 0) + z.T @ z
        yield pd.DataFrame({"k": list(sums), "data": [m.tobytes() for m in sums.values()]})

    rows = df.select(F.col(by).cast("long").alias("_by"), F.col(x).alias("_x"), *[F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(y)])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in pdf.data)
        return pd.DataFrame({"k": [pdf.k.iloc[0]], "data": [total.tobytes()]})

    out = {}
    for r in rows.mapInPandas(run, "k long, data binary").groupBy("k").applyInPandas(add, "k long, data binary").collect():  # one row a fold
        m = np.frombuffer(r["data"])
        out[r["k"]] = m.reshape(math.isqrt(len(m)), -1)
    return out


def solve_ridge(m: np.ndarray, alpha: float, targets: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients D x targets, intercepts) of ridge on standardised x, intercept free, in the units of x."""
    n, d = m[0, 0], len(m) - 1 - targets
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    std = np.maximum(np.sqrt(np.maximum(np.diag(cov)[:d], 0)), 1e-6)
    a = cov[:d, :d] / np.outer(std, std) * n + alpha * np.eye(d)
    w = np.linalg.solve(a, cov[:d, d:] / std[:, None] * n) / std[:, None]
    return w, mean[d:] - mean[:d] @ w


def ridge_fit(df: DataFrame, x: str, y: list[str], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    m = sum(gram(df.withColumn("_one", F.lit(0)), x, y, "_one").values())
    return solve_ridge(m, alpha, len(y))


def ridge_predict(df: DataFrame, x: str, w: np.ndarray, b: float, out: str, link: str = "none") -> DataFrame:
    """Native dot product; link is none, clip (to 0..1) or sigmoid."""
    p = dot(F.col(x), literal(w)) + float(b)
    p = {"none": p, "clip": F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), "sigmoid": sigmoid(p)}[link]
    return df.withColumn(out, p)


def ridge_cv(df: DataFrame, key: str, x: str, y: str, fold: str, alphas: list[float], link: str = "none") -> tuple[DataFrame, dict]:
    """(out-of-fold predictions, alpha by fold): each fold's alpha has the least squared error over the other folds.

    All folds and alphas share one pass of sums: the sums without a fold are the total less the fold's.
    """
    target = logit(F.col(y)) if link == "sigmoid" else F.col(y)
    rows = df.withColumn("_t", target)
    g = gram(rows, x, ["_t"], fold)
    total = sum(g.values())

    def error(m: np.ndarray, w: np.ndarray, b: float) -> float:
        c = np.concatenate([[-b], -w, [1.0]])
        return float(c @ m @ c)

    models, chosen = {}, {}
    for k in g:
        rest = {j: m for j, m in g.items() if j != k}
        base = total - g[k]
        loss = {a: sum(error(m, *_flat(solve_ridge(base - m, a))) for m in rest.values()) for a in alphas}
        chosen[k] = min(alphas, key=lambda a: (loss[a], a))
        models[k] = _flat(solve_ridge(base, chosen[k]))
    p = F.lit(None).cast("double")
    for k, (w, b) in models.items():
        p = F.when(F.col(fold) == k, dot(F.col(x), literal(w)) + float(b)).otherwise(p)
    p = sigmoid(p) if link == "sigmoid" else F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) if link == "clip" else p
    return rows.drop("_t").withColumn("prediction", p), chosen


def nested_ridge(df: DataFrame, key: str, x: str, y: str, fold: str, alphas: list[float], inner: int = 3, link: str = "none", seed: int = 0) -> tuple[DataFrame, dict]:
    """(out-of-fold predictions, alpha by fold): each fold's alpha has the least mean absolute error over inner folds of the other rows.

    Sums by (fold, inner fold) give all models at once: a fold less, an inner fold less. Absolute errors can't be had from
    sums, so one more pass multiplies each batch by all models and adds up the errors of the rows that each left out.
    Errors count after the link; the mean of the inner folds' means decides, ties go to the earlier alpha.
    """
    from reviewlake.operators.ranking import with_fold

    ship(df.sparkSession)
    target = logit(F.col(y)) if link == "sigmoid" else F.col(y).cast("double")
    rows = materialize(with_fold(df, key, inner, seed + 123, name="_inner").withColumn("_t", target), "nested-rows")
    g = gram(rows.withColumn("_cell", F.col(fold).cast("long") * inner + F.col("_inner")), x, ["_t"], "_cell")
    folds = sorted({c // inner for c in g})
    models = [(k, i, a) for k in folds for i in range(inner) for a in range(len(alphas))]
    zero = np.zeros_like(next(iter(g.values()))) if g else None
    base = {k: sum((m for c, m in g.items() if c // inner != k), zero) for k in folds}
    less = lambda k, i: sum((m for c, m in g.items() if c // inner != k and c % inner != i), zero)
    sums = {(k, i): less(k, i) for k in folds for i in range(inner)}
    usable = [m for m in models if sums[m[:2]][0, 0] > 0]
    fitted = [_flat(solve_ridge(sums[k, i], alphas[a])) for k, i, a in usable]
    weights = np.stack([np.append(w, b) for w, b in fitted], axis=1) if fitted else np.zeros((1, 0))
    of_fold, of_inner = (np.array([m[j] for m in usable]) for j in (0, 1))
    shared = df.sparkSession.sparkContext.broadcast((weights, of_fold, of_inner))

    def errors(batches):
        w, k, i = shared.value
        total, n = np.zeros(len(k)), np.zeros(len(k), np.int64)
        for pdf in batches:
            if len(pdf) and len(k):
                p = np.column_stack([np.stack(pdf["_x"].to_numpy()), np.ones(len(pdf))]) @ w
                p = 1 / (1 + np.exp(-np.clip(p, -50, 50))) if link == "sigmoid" else np.clip(p, 0, 1) if link == "clip" else p
                own = (pdf["_f"].to_numpy()[:, None] != k) & (pdf["_i"].to_numpy()[:, None] == i)
                total += np.where(own, np.abs(p - pdf["_y"].to_numpy()[:, None]), 0).sum(axis=0)
                n += own.sum(axis=0)
        yield pd.DataFrame({"m": np.arange(len(k)), "e": total, "n": n})

    narrow = rows.select(F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"), F.col(fold).cast("long").alias("_f"), F.col("_inner").cast("long").alias("_i"))
    found = narrow.mapInPandas(errors, "m long, e double, n long").groupBy("m").agg((F.sum("e") / F.sum("n")).alias("mae")).collect()  # a row a model
    mae = {usable[r["m"]]: r["mae"] for r in found if r["mae"] is not None}
    p, chosen = F.lit(None).cast("double"), {}
    for k in folds:
        loss = [np.mean([mae[k, i, a] for i in range(inner) if (k, i, a) in mae] or [math.inf]) for a in range(len(alphas))]
        chosen[k] = alphas[int(np.argmin(np.round(loss, 12)))]
        if base[k][0, 0] > 0:
            w, b = _flat(solve_ridge(base[k], chosen[k]))
            p = F.when(F.col(fold) == k, dot(F.col(x), literal(w)) + float(b)).otherwise(p)
    p = sigmoid(p) if link == "sigmoid" else F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) if link == "clip" else p
    return rows.drop("_t", "_inner").withColumn("prediction", p), chosen


def _flat(wb):
    return wb[0][:, 0], float(wb[1][0])


def sentiment_r2(df: DataFrame, key: str, x: str, y: str, fold: str, alpha: float = 10.0) -> DataFrame:
    """Metrics of out-of-fold ridge predictions of an entity's sentiment."""
    out, _ = ridge_cv(df, key, x, y, fold, [alpha])
    return regression_metrics(out, y, "prediction", key, [])


def tag_probe(df: DataFrame, key: str, x: str, tags: list[str], fold: str, folds: int, c: float = 1.0, min_train: int = 2, min_held: int = 1, grid=None, rounds: int = 12) -> DataFrame:
    """(tag, fold, threshold, tp, fp, fn) of balanced logistic probes, out of fold.

    Rows hold a vector, scaled to length one here, 0/1 tag columns and their own fold. Each Newton step is one pass: tasks add up
    gradient and Hessian of all tags and folds, and the sums (tags x folds x D x D) go to the driver, whatever the number of
    rows. Thresholds are chosen from counts on the grid, in one more pass.
    """
    grid = np.array(grid or [0.1 + 0.8 * i / 32 for i in range(33)])
    spark = df.sparkSession
    ship(spark)
    rows = materialize(df.select(F.col(x).alias("x"), F.col(fold).cast("long").alias("fold"), F.array(*[F.col(t).cast("double") for t in tags]).alias("y")), "probe-rows")
    models = [(t, k) for t in range(len(tags)) for k in range(folds)]

    def summed(one) -> np.ndarray:
        """The sum over all rows of one(z, y, fold), an array of fixed shape."""

        def run(batches):
            total = 0
            for pdf in batches:
                if len(pdf):
                    z = np.stack(pdf.x.to_numpy())
                    z = np.column_stack([z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-8), np.ones(len(z))])
                    total = total + one(z, np.stack(pdf.y.to_numpy()), pdf.fold.to_numpy())
            if not np.isscalar(total):
                yield pd.DataFrame({"k": np.arange(len(total)), "data": [m.tobytes() for m in total]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": [pdf.k.iloc[0]], "data": [sum(np.frombuffer(d) for d in pdf.data).tobytes()]})

        found = rows.mapInPandas(run, "k long, data binary").groupBy("k").applyInPandas(add, "k long, data binary").collect()
        return np.stack([np.frombuffer(r["data"]) for r in sorted(found, key=lambda r: r["k"])]) if found else np.zeros((0, 0))

    counts = summed(lambda z, y, own: np.array([[(own != k).sum(), y[own != k, t].sum(), y[own == k, t].sum()] for t, k in models], float))
    fitted = [m for m, (n, pos, held) in enumerate(counts) if pos >= min_train and held >= min_held and pos < n]
    if not fitted:
        return spark.createDataFrame([], "tag string, fold long, threshold double, tp long, fp long, fn long")
    dim = len(rows.first()["x"]) + 1
    beta, penalty = np.zeros((len(fitted), dim)), np.append(np.full(dim - 1, 1.0 / c), 0.0)

    def score(z: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ b, -50, 50)))

    for _ in range(rounds):

        def step(z, y, own, beta=beta):
            out = np.zeros((len(fitted), dim * dim + dim))
            for i, m in enumerate(fitted):
                (t, k), (n, pos, _) = models[m], counts[m]
                w, v = z[own != k], y[own != k, t]
                weight, p = np.where(v == 1, n / (2 * pos), n / (2 * (n - pos))), score(w, beta[i])
                out[i] = np.concatenate([((w * (weight * p * (1 - p))[:, None]).T @ w).ravel(), w.T @ (weight * (p - v))])
            return out

        sums = summed(step)
        beta = np.stack([b - np.linalg.solve(s[: dim * dim].reshape(dim, dim) + np.diag(penalty + 1e-9), s[dim * dim :] + penalty * b) for b, s in zip(beta, sums)])

    def tally(z, y, own):
        """Per model, threshold and side (train, held out): tp, fp, fn."""
        out = np.zeros((len(fitted), len(grid), 2, 3))
        for i, m in enumerate(fitted):
            t, k = models[m]
            said, held = score(z, beta[i])[:, None] >= grid, own == k
            true = (y[:, t] == 1)[:, None]
            for side, at in enumerate((~held, held)):
                out[i, :, side] = np.stack([(said & true)[at].sum(0), (said & ~true)[at].sum(0), (~said & true)[at].sum(0)], axis=1)
        return out.reshape(len(fitted), -1)

    out = []
    for m, s in zip(fitted, summed(tally).reshape(len(fitted), len(grid), 2, 3)):
        f1 = 2 * s[:, 0, 0] / np.maximum(1, 2 * s[:, 0, 0] + s[:, 0, 1] + s[:, 0, 2])
        best = int(np.argmax(f1))
        out.append((tags[models[m][0]], models[m][1], float(grid[best]), *(int(v) for v in s[best, 1])))
    return spark.createDataFrame(out, "tag string, fold long, threshold double, tp long, fp long, fn long")


def apply_probe(df: DataFrame, x: str, params: dict[str, tuple[list[float], float] | None]) -> DataFrame:
    """(all columns, tag, p): sigmoid of each tag's linear score; 0 for tags that were not trained."""
    parts = [F.struct(F.lit(t).alias("tag"), (F.lit(0.0) if wb is None else sigmoid(dot(F.col(x), literal(wb[0])) + float(wb[1]))).alias("p")) for t, wb in params.items()]
    return df.select("*", F.explode(F.array(*parts)).alias("_t")).select(*df.columns, "_t.*")


def apply_rate_probe(df: DataFrame, x: str, mean: list[float], std: list[float], w: list[float], b: float, link: str = "sigmoid") -> DataFrame:
    """positive and negative of a rate probe; they sum to 1."""
    z = scale(F.col(x), literal(mean), literal(std))
    p = dot(z, literal(w)) + b
    p = sigmoid(p) if link == "sigmoid" else F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return df.withColumn("positive", p).withColumn("negative", 1 - p)


def apply_score_head(df: DataFrame, x: str, mean, std, components: list[list[float]], w: list[list[float]], b: list[float], lo: float, hi: float, dims: list[str]) -> DataFrame:
    """Scale, project on components, a ridge row a dimension, clip to the target's range."""
    z = scale(F.col(x), literal(mean), literal(std))
    low = F.array(*[dot(z, literal(c)) for c in components])
    return df.select("*", low.alias("_z")).select(*df.columns, *[F.least(F.greatest(dot(F.col("_z"), literal(w[i])) + b[i], F.lit(lo)), F.lit(hi)).alias(d) for i, d in enumerate(dims)])


def score_grid(df: DataFrame, key: str, x: str, dims: list[str], grid: list[dict], lo: float, hi: float) -> DataFrame:
    """(config, held_out, mae, clipped, excess): leave-one-out ridge for each configuration, a task a configuration and row.

    For benchmark tables of tens of entities: the table is sent to every task and must have at most 1000 rows.
    """
    spark = df.sparkSession
    ship(spark)
    table = df.select(key, x, *dims).orderBy(key).limit(1001).toPandas()
    if len(table) > 1000:
        raise ValueError("score_grid is for tables of at most 1000 rows")
    shared = spark.sparkContext.broadcast((np.stack(table[x].to_numpy()), table[dims].to_numpy(float)))
    jobs = spark.createDataFrame([(c, int(i), g["scaler"], int(g["pca"]), float(g["alpha"])) for c, g in enumerate(grid) for i in range(len(table))], "config int, held int, scaler string, pca int, alpha double")

    def run(batches):
        xs, ys = shared.value
        for pdf in batches:
            out = []
            for j in pdf.itertuples():
                keep = np.arange(len(xs)) != j.held
                a, t = xs[keep], ys[keep]
                if j.scaler == "l2":
                    f = lambda v: v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-8)
                elif j.scaler == "standard":
                    m, s = a.mean(0), np.maximum(a.std(0), 1e-6)
                    f = lambda v: (v - m) / s
                else:
                    f = lambda v: v
                a, q = f(a), f(xs[[j.held]])
                centre = a.mean(0)
                v = np.linalg.svd(a - centre, full_matrices=False)[2][: j.pca]
                a, q = (a - centre) @ v.T, (q - centre) @ v.T
                w = np.linalg.solve(a.T @ a + j.alpha * np.eye(a.shape[1]), a.T @ (t - t.mean(0)))
                p = (q @ w + t.mean(0))[0]
                cut = np.clip(p, lo, hi)
                out.append((j.config, j.held, float(np.abs(cut - ys[j.held]).mean()), float((cut != p).mean()), float(np.abs(cut - p).mean())))
            yield pd.DataFrame(out, columns=["config", "held_out", "mae", "clipped", "excess"])

    return jobs.repartition("config", "held").mapInPandas(run, "config int, held_out int, mae double, clipped double, excess double")


def best_config(grid_rows: DataFrame) -> DataFrame:
    """(config, objective), best first: MAE + 0.15 share clipped + 0.02 excess; the weights are fixed values."""
    o = F.avg("mae") + 0.15 * F.avg("clipped") + 0.02 * F.avg("excess")
    return grid_rows.groupBy("config").agg(o.alias("objective")).orderBy("objective", "config")


def selectivity(raw: DataFrame, code: DataFrame, key: str = "run") -> DataFrame:
    """Retention of content, subjective and sentiment metrics against the raw features, their gap, and a verdict."""
    cols = ("content_f1", "subjective_f1", "sentiment_r2")
    both = code.join(raw.select(key, *[F.col(c).alias(f"raw_{c}") for c in cols]), key)
    keep = {c: F.when(F.col(f"raw_{c}") > 1e-6, F.col(c) / F.col(f"raw_{c}")) for c in cols}
    out = both.select(key, *[v.alias(f"retention_{c}") for c, v in keep.items()])
    out = out.withColumn("gap", F.col("retention_content_f1") - F.col("retention_sentiment_r2"))
    verdict = F.when(F.col("gap").isNull(), "unknown").when(F.col("gap") > 0.2, "selective").when(F.col("gap") > 0.05, "weak").otherwise("none")
    return out.withColumn("verdict", verdict)


def variant_report(scores: DataFrame, key: str = "appid", variant: str = "variant", anchor: str = "neutral") -> DataFrame:
    """(variant, mean_delta, mean_abs_delta, n): tag scores of a text variant less the anchor's, by entity and tag."""
    base = scores.where(F.col(variant) == anchor).select(key, "tag", F.col("score").alias("_a"))
    d = F.col("score") - F.col("_a")
    return scores.where(F.col(variant) != anchor).join(base, [key, "tag"]).groupBy(variant).agg(F.avg(d).alias("mean_delta"), F.avg(F.abs(d)).alias("mean_abs_delta"), F.count("*").alias("n"))


def _with_one(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.stack(pdf["_x"].to_numpy()), np.ones(len(pdf))])


def _tag_rows(df: DataFrame, x: str, tags: list[str], by: str | None) -> DataFrame:
    return df.select(F.col(by).cast("string").alias("_by") if by else F.lit("").alias("_by"), F.col(x).cast("array<double>").alias("_x"), *[F.col(t).cast("int").alias(f"_y{i}") for i, t in enumerate(tags)])


def tag_counts(df: DataFrame, x: str, tags: list[str], by: str | None, models: list[tuple[np.ndarray, list[float]]]) -> DataFrame:
    """(part, model, nth, n, tp, fp, fn) by value of `by`: linear tag scores (D + 1 x tags) against thresholds, added up over rows and tags."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for part, some in pdf.groupby("_by", dropna=False):
                true = some[[f"_y{i}" for i in range(len(tags))]].to_numpy() > 0
                for m, (w, grid) in enumerate(shared.value):
                    s = _with_one(some) @ w
                    for k, t in enumerate(grid):
                        said = s >= t
                        sums[part, m, k] = sums.get((part, m, k), 0) + np.array([len(some), (said & true).sum(), (said & ~true).sum(), (~said & true).sum()])
        yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["part", "model", "nth", "n", "tp", "fp", "fn"])

    rows = _tag_rows(df, x, tags, by).mapInPandas(run, "part string, model int, nth int, n long, tp long, fp long, fn long")
    return rows.groupBy("part", "model", "nth").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn")])


def micro(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and micro_f1; 0 where nothing is said, true, or both."""
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    rows = counts.withColumn("precision", share(F.col("tp"), F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("micro_f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def anchor_probe(anchors: DataFrame, x: str, tags: list[str], split: str, alphas: list[float], steps: int = 33) -> dict:
    """Ridge of all tags on the scaled training anchors: alpha, threshold, weights (D + 1 x tags) and validation counts.

    For each alpha, thresholds go in equal steps from the least to the largest validation score; the best micro F1 decides, then
    recall, then the smaller alpha, then the smaller threshold.
    """
    m = sum(gram(anchors.where(F.col(split) == "train").withColumn("_one", F.lit(0)), x, tags, "_one").values())
    if np.isscalar(m) or m[0, 0] < 2:
        raise ValueError("too few training anchors")
    fitted = [np.vstack(solve_ridge(m, a, len(tags))) for a in alphas]
    val = anchors.where(F.col(split) == "val")
    shared = anchors.sparkSession.sparkContext.broadcast(fitted)

    def ends(batches):
        for pdf in batches:
            if len(pdf):
                scores = [_with_one(pdf) @ w for w in shared.value]
                yield pd.DataFrame({"m": np.arange(len(scores)), "lo": [s.min() for s in scores], "hi": [s.max() for s in scores]})

    found = _tag_rows(val, x, tags, None).mapInPandas(ends, "m int, lo double, hi double").groupBy("m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # a row an alpha
    if not found:
        raise ValueError("no validation anchors")
    grids = {r["m"]: np.linspace(r["lo"], r["hi"], max(2, steps)).tolist() if r["lo"] < r["hi"] else [0.5] for r in found}
    counts = micro(tag_counts(val, x, tags, None, [(w, grids[i]) for i, w in enumerate(fitted)])).collect()  # alphas x steps rows
    best = max(counts, key=lambda r: (r["micro_f1"], r["recall"], -alphas[r["model"]], -r["nth"]))
    return {"alpha": alphas[best["model"]], "threshold": grids[best["model"]][best["nth"]], "weights": fitted[best["model"]], "micro_f1": best["micro_f1"]}


def variant_robustness(anchors: DataFrame, variants: DataFrame, key: str, variant: str, x: str, tags: list[str], split: str, alphas: list[float], steps: int = 33) -> DataFrame:
    """(part, n, micro_f1, precision, recall, anchor_f1, anchor_recall, drop_f1, drop_recall, cosine_mean, cosine_median).

    Tags are learned from anchors only. A part is a split of the anchors (`anchor_train` ...) or a variant; a variant is
    held against the anchors of the same entities, and its vectors against theirs. Variants of unknown entities are left out.
    """
    model = anchor_probe(anchors, x, tags, split, alphas, steps)
    one = [(model["weights"], [model["threshold"]])]
    own = micro(tag_counts(anchors, x, tags, split, one)).select(F.concat(F.lit("anchor_"), "part").alias("part"), "n", "micro_f1", "precision", "recall")
    pairs = materialize(variants.select(key, F.col(variant).alias("_v"), F.col(x).alias("_vx")).join(anchors.select(key, F.col(x).alias("_ax"), *tags), key), "variant-pairs")
    theirs, base = (micro(tag_counts(pairs, c, tags, "_v", one)) for c in ("_vx", "_ax"))
    base = base.select("part", F.col("micro_f1").alias("anchor_f1"), F.col("recall").alias("anchor_recall"))
    near = pairs.select(F.col("_v").cast("string").alias("part"), cosine(F.col("_ax").cast("array<double>"), F.col("_vx").cast("array<double>")).alias("c"))
    middle = medians(near, ["part"], "c").withColumnRenamed("median", "cosine_median")
    rows = theirs.select("part", "n", "micro_f1", "precision", "recall").join(base, "part").join(near.groupBy("part").agg(F.avg("c").alias("cosine_mean")), "part").join(middle, "part")
    rows = rows.withColumn("drop_f1", F.col("anchor_f1") - F.col("micro_f1")).withColumn("drop_recall", F.col("anchor_recall") - F.col("recall"))
    return own.unionByName(rows, allowMissingColumns=True)


def binary_by_median(df: DataFrame, dims: list[str]) -> DataFrame:
    """Scores as 0/1 by the median of each dimension."""
    medians = df.agg(*[F.median(d).alias(f"_m_{d}") for d in dims])
    return df.crossJoin(F.broadcast(medians)).select(*[(F.col(d) >= F.col(f"_m_{d}")).cast("int").alias(d) if d in dims else F.col(d) for d in df.columns])  # one row


def loo_group_f1(df: DataFrame, key: str, x: str, dims: list[str], groups: dict[str, str]) -> DataFrame:
    """(group, f1): leave-one-out logistic probes of scores above the median, micro F1 by group of dimensions."""
    rows = binary_by_median(df, dims)
    n = rows.count()
    if n > 1000:
        raise ValueError("leave-one-out probes are for tables of at most 1000 rows")
    from reviewlake.operators.corpus import with_ordinal

    held = with_ordinal(rows, [key], "own")
    out = tag_probe(held, key, x, dims, "own", n, grid=[0.5], min_train=1, min_held=0)
    names = F.create_map(*[F.lit(v) for pair in groups.items() for v in pair])
    g = out.withColumn("group", names[F.col("tag")]).groupBy("group").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return g.select("group", (2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))).alias("f1"))


def loo_pca_predictions(df: DataFrame, key: str, x: str, dims: list[str], pca: int = 8, c: float = 1.0, rounds: int = 12) -> DataFrame:
    """(key, dim, truth, said): leave-one-out balanced logistic probes of scores above the median, each on scaled principal components of the other rows.

    Nothing is fitted from the rows themselves a second time: one pass has the sums and products of all rows, and each row takes
    itself off these for its own scaling and components, in its task. Newton's steps for all rows and dimensions are
    sums over the rows, a pass a step. For benchmark tables of at most 1000 rows, whose components are shared with all tasks.
    Where the other rows are of one class, that class is said.
    """
    from reviewlake.operators.corpus import with_ordinal

    spark = df.sparkSession
    ship(spark)
    held = materialize(with_ordinal(binary_by_median(df, dims), [key], "own").select(key, "own", F.col(x).cast("array<double>").alias("_x"), *dims), "loo-rows")
    n = held.count()
    if n > 1000:
        raise ValueError("leave-one-out probes are for tables of at most 1000 rows")
    none = f"{held.schema[key].name} {held.schema[key].dataType.simpleString()}, dim string, truth boolean, said boolean"
    if n < 2:
        return spark.createDataFrame([], none)
    m = sum(gram(held.withColumn("_one", F.lit(0)), "_x", dims, "_one").values())
    d = len(m) - 1 - len(dims)
    parts = d if pca >= d or not pca else min(pca, n - 2) or 1
    total = spark.sparkContext.broadcast(m)

    def basis(batches):
        t, d = total.value, len(total.value) - 1 - len(dims)
        for pdf in batches:
            out = []
            for x in pdf["_x"]:
                row = np.concatenate([[1.0], x])
                less = t[: d + 1, : d + 1] - np.outer(row, row)
                mean = less[0, 1:] / less[0, 0]
                cov = less[1:, 1:] / less[0, 0] - np.outer(mean, mean)
                std = np.sqrt(np.maximum(np.diag(cov), 0))
                std = np.where(std < 1e-9, 1.0, std)
                turn = np.eye(d) if parts == d else np.linalg.eigh(cov / np.outer(std, std))[1][:, ::-1][:, :parts]
                turn = turn / std[:, None]
                out.append(np.vstack([turn, -mean @ turn]).tobytes())
            yield pd.DataFrame({"own": pdf["own"], "data": out})

    found = {r["own"]: np.frombuffer(r["data"]).reshape(d + 1, parts) for r in held.select("own", "_x").mapInPandas(basis, "own long, data binary").collect()}  # at most 1000 rows
    turns = spark.sparkContext.broadcast(np.stack([found[i] for i in range(n)]))  # row, D + 1, parts
    y_all = np.zeros((n, len(dims)))
    for r in held.select("own", *dims).collect():  # labels of at most 1000 rows
        y_all[r["own"]] = [float(r[k]) for k in dims]
    pos = y_all.sum(axis=0) - y_all  # of the other rows, by held-out row and dimension
    mixed = (pos > 0) & (pos < n - 1)
    with np.errstate(divide="ignore"):
        balance = np.where(mixed, (n - 1) / (2 * pos), 0.0), np.where(mixed, (n - 1) / (2 * (n - 1 - pos)), 0.0)
    shared = spark.sparkContext.broadcast((y_all, *balance))
    size = parts + 1
    beta, penalty = np.zeros((n, len(dims), size)), np.append(np.full(parts, 1.0 / c), 0.0)

    def components(pdf: pd.DataFrame) -> np.ndarray:
        """held-out row x row x component: a batch's rows under every basis, and a constant."""
        v = np.column_stack([np.stack(pdf["_x"].to_numpy()), np.ones(len(pdf))])
        z = np.einsum("bd,hdp->hbp", v, turns.value)
        return np.concatenate([z, np.ones((*z.shape[:2], 1))], axis=2)

    def chance(z: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.einsum("hbs,hs->hb", z, b), -50, 50)))

    rows = held.select(key, "own", "_x")
    for _ in range(rounds):

        def step(batches, beta=beta):
            y, up, down = shared.value
            sums = np.zeros((n, len(dims), size * size + size))
            for pdf in batches:
                for at in range(0, len(pdf), 32):
                    some = pdf.iloc[at : at + 32]
                    z, own = components(some), some["own"].to_numpy()
                    other = own[None, :] != np.arange(n)[:, None]
                    for k in range(len(dims)):
                        w = other * np.where(y[own, k] == 1, up[:, k, None], down[:, k, None])
                        p = chance(z, beta[:, k])
                        sums[:, k, : size * size] += np.einsum("hbs,hb,hbt->hst", z, w * p * (1 - p), z).reshape(n, -1)
                        sums[:, k, size * size :] += np.einsum("hbs,hb->hs", z, w * (p - y[own, k]))
            yield pd.DataFrame({"h": np.arange(n), "data": [x.tobytes() for x in sums]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"h": [pdf.h.iloc[0]], "data": [sum(np.frombuffer(x) for x in pdf.data).tobytes()]})

        got = rows.mapInPandas(step, "h long, data binary").groupBy("h").applyInPandas(add, "h long, data binary").collect()  # a row a held-out row
        for r in got:
            for k, x in enumerate(np.frombuffer(r["data"]).reshape(len(dims), -1)):
                b = beta[r["h"], k]
                b = b - np.linalg.solve(x[: size * size].reshape(size, size) + np.diag(penalty + 1e-9), x[size * size :] + penalty * b)
                beta[r["h"], k] = b

    def say(batches):
        y = shared.value[0]
        for pdf in batches:
            for at in range(0, len(pdf), 32):
                some = pdf.iloc[at : at + 32]
                own = some["own"].to_numpy()
                z = components(some)[own, np.arange(len(some))][None]
                for k, name in enumerate(dims):
                    likely = np.einsum("hbs,bs->hb", z, beta[own, k])[0] >= 0
                    said = np.where(mixed[own, k], likely, np.rint(pos[own, k] / (n - 1)) > 0)
                    yield pd.DataFrame({key: some[key], "dim": name, "truth": y[own, k] == 1, "said": said})

    return rows.mapInPandas(say, none)


def loo_pca_f1(df: DataFrame, key: str, x: str, dims: list[str], groups: dict[str, str], pca: int = 8, c: float = 1.0) -> DataFrame:
    """(group, f1): micro F1 of loo_pca_predictions by group of dimensions."""
    names = F.create_map(*[F.lit(v) for pair in groups.items() for v in pair])
    tally = lambda e, name: F.count_if(e).alias(name)
    t, s = F.col("truth"), F.col("said")
    g = loo_pca_predictions(df, key, x, dims, pca, c).groupBy(names[F.col("dim")].alias("group")).agg(tally(t & s, "tp"), tally(~t & s, "fp"), tally(t & ~s, "fn"))
    return g.select("group", (2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))).alias("f1"))


def apply_mlp(df: DataFrame, x: str, layers: list[tuple[np.ndarray, np.ndarray]], out: str = "score") -> DataFrame:
    """Sigmoid output of a small network with GELU between layers; weights are given and broadcast."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in layers])

    def run(batches):
        erf = np.frompyfunc(math.erf, 1, 1)
        for pdf in batches:
            if not len(pdf):
                continue
            h = np.stack(pdf[x].to_numpy())
            for i, (w, b) in enumerate(shared.value):
                h = h @ w + b
                if i < len(shared.value) - 1:
                    h = 0.5 * h * (1 + erf(h / math.sqrt(2)).astype(float))
            yield pdf.assign(**{out: 1 / (1 + np.exp(-h[:, 0]))})

    from pyspark.sql.types import DoubleType, StructType

    return df.mapInPandas(run, StructType(df.schema.fields[:]).add(out, DoubleType()))


def hashing_provider(dim: int):
    """texts -> vectors by hashed words: a stand-in for an embedding model."""
    import zlib

    def embed(texts):
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def embed(df: DataFrame, text: str, provider, dim: int, cache: DataFrame | None = None) -> DataFrame:
    """Add vector. Distinct texts only, those without a vector in cache (hash, vector), through provider in batches."""
    ship(df.sparkSession)
    rows = df.withColumn("_h", F.sha2(F.coalesce(text, F.lit("")), 256))
    todo = rows.groupBy("_h").agg(F.first(F.coalesce(text, F.lit(""))).alias("t"))
    if cache is not None:
        todo = todo.join(cache.select(F.col("hash").alias("_h")), "_h", "left_anti")

    def run(batches):
        for pdf in batches:
            if len(pdf):
                v = provider(list(pdf.t))
                if v.shape[1] != dim:
                    raise ValueError(f"the provider gave {v.shape[1]} dimensions, not {dim}")
                yield pd.DataFrame({"_h": pdf["_h"], "vector": list(v)})

    new = todo.mapInPandas(run, "_h string, vector array<double>")
    if cache is not None:
        new = new.unionByName(cache.select(F.col("hash").alias("_h"), "vector"))
    return rows.join(new, "_h").drop("_h")


