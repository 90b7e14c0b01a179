"""Statistics by entity, metric, dimension, tag and run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from reviewlake.operators.corpus import with_ordinal
from reviewlake.operators.quantiles import join_groups, medians
from reviewlake.session import ship

STATS = ("n", "mean", "median", "min", "max", "stdev")


def count_entities(df: DataFrame, key: str, order: str, firsts: list[str]) -> DataFrame:
    """Rows by entity, and the first non-blank value of each column in input order."""
    first = lambda c: F.min_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", F.col(order))).alias(c)
    return df.groupBy(key).agg(F.count("*").alias("reviews"), *map(first, firsts))


def label_rates(reviews: DataFrame, key: str, label: str, text: str | None = None, min_length: int = 0, min_labels: int = 0) -> DataFrame:
    """positive, negative and rate by entity; rows without a label or with short text don't count."""
    rows = reviews.where(F.length(text) >= min_length) if text else reviews
    out = rows.groupBy(key).agg(F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))
    total = F.col("positive") + F.col("negative")
    return out.withColumn("rate", F.col("positive") / F.nullif(total, F.lit(0))).where(total >= min_labels)


def stats_of(c: Column) -> dict[str, Column]:
    return {
        "n": F.count(c), "mean": F.avg(c), "median": F.median(c), "min": F.min(c), "max": F.max(c), "stdev": F.coalesce(F.stddev_samp(c), F.lit(0.0)),
    }


def metric_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, min, max and sample deviation (0 for one value)."""
    rest = values.groupBy(*keys).agg(*[c.alias(n) for n, c in stats_of(F.col(value)).items() if n != "median"])
    return join_groups(rest, medians(values, keys, value), keys, "left").select(*keys, *STATS)


def pivot_samples(values: DataFrame, keys: list[str], metric: str, value: str, metrics: list) -> DataFrame:
    """One row for keys, a column for each listed metric; missing samples are null."""
    return values.groupBy(*keys).pivot(metric, metrics).agg(F.first(value))


def pivot_stats(values: DataFrame, key: str, metric: str, value: str, metrics: list) -> DataFrame:
    """One row an entity: the six statistics and the sorted values as JSON for each listed metric."""
    aggs = [c.alias(n) for n, c in stats_of(F.col(value)).items()] + [F.to_json(F.array_sort(F.collect_list(value))).alias("values")]
    return values.groupBy(key).pivot(metric, metrics).agg(*aggs)


def exact_mean(c: Column) -> Column:
    """The mean of doubles, whatever order and partitions their rows have, if ten decimals hold all of them; else the usual one.

    Such numbers are added up and divided as decimals, so that a mean half way between two rounded values is not moved to one side
    by errors of the sum.
    """
    short = c.try_cast("decimal(24,10)")
    fits = F.bool_and(F.coalesce(short.cast("double") == c, c.isNull()))
    mean = F.try_divide(F.try_sum(short).try_cast("decimal(24,10)"), F.count(c).cast("decimal(19,0)"))
    return F.coalesce(F.when(fits, mean.cast("double")), F.avg(c))


def mean_scores(df: DataFrame, key: str, dims: list[str], order: str, attributes: list[str], on_blank: str = "skip") -> DataFrame:
    """Mean of each dimension by entity, samples, and attributes of the first row by an order that should tell rows apart. on_blank='error' raises for null scores."""
    value = (lambda c: F.col(c)) if on_blank == "skip" else (lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"blank {c}"))).otherwise(F.col(c)))
    mean = lambda c: exact_mean(value(c)) if df.schema[c].dataType == DoubleType() else F.avg(value(c))
    return df.groupBy(key).agg(*[mean(c).alias(c) for c in dims], F.count("*").alias("samples"), *[F.min_by(c, order).alias(c) for c in attributes])


def by_dimension(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """keys, dim (from 0) and x of every vector element."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "x"))


def summarize_vectors(df: DataFrame, key: str, vec: str, mode: str = "mean_std") -> DataFrame:
    """(key, summary): mean, then population deviation, then min and max of each dimension, as the mode says.

    One partial aggregate over whole vectors: an entity of any size spreads over all tasks, and a vector stays one row.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = Summarizer.metrics("mean", "std", "min", "max", "count").summary(F.col("_v"))
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key), array_to_vector(F.col(vec)).alias("_v")).groupBy(key).agg(parts.alias("s"))
    n = F.col("s.count")
    std = F.transform(vector_to_array("s.std"), lambda x: x * F.sqrt((n - 1) / n))  # the sample deviation to the population's
    cols = {"mean": vector_to_array("s.mean"), "std": std, "min": vector_to_array("s.min"), "max": vector_to_array("s.max")}
    names = {"mean": ["mean"], "mean_std": ["mean", "std"], "all": list(cols)}[mode]
    return rows.select(key, F.concat(*[cols[c] for c in names]).alias("summary"))


def _pick(col: str, field: str) -> Column:
    return F.transform(col, lambda s: s[field])


def sampled(df: DataFrame, key: str, item: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each entity, by md5 of seed and item: any engine takes the same ones."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(order, item))).where(F.col("_nth") <= n).drop("_nth")


def fit_scaler(df: DataFrame, vec: str, floor: float = 1e-6) -> DataFrame:
    """One row: mean and population deviation of every dimension, the latter at least floor."""
    both = summarize_vectors(df.select(F.lit(0).alias("_all"), vec), "_all", vec)
    half = F.floor(F.size("summary") / 2).cast("int")
    return both.select(F.slice("summary", F.lit(1), half).alias("mean"), F.transform(F.slice("summary", half + 1, half), lambda x: F.greatest(x, F.lit(floor))).alias("std"))


def apply_scaler(df: DataFrame, scaler: DataFrame, vec: str) -> DataFrame:
    """Vectors less mean, over deviation. The scaler is one row."""
    from reviewlake.functions.vectors import scale

    return df.crossJoin(F.broadcast(scaler)).withColumn(vec, scale(F.col(vec), F.col("mean"), F.col("std"))).drop("mean", "std")


def covariance(df: DataFrame, vec: str) -> DataFrame:
    """(i, j, c), i <= j: population covariance of dimensions. A task adds up one matrix of products; those are summed by cell."""
    ship(df.sparkSession)

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "sums": list(total)})

    parts = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("x")).mapInPandas(run, "i long, sums array<double>")
    cells = parts.select("i", F.posexplode("sums").alias("j", "s")).where("i <= j").groupBy("i", "j").agg(F.sum("s").alias("s"))
    first = cells.where("i = 0")
    mean = first.select(F.col("j").alias("k"), (F.col("s") / F.max(F.when(F.col("j") == 0, F.col("s"))).over(W.partitionBy("i"))).alias("m"))
    n = first.where("j = 0").select(F.col("s").alias("n"))
    rows = cells.where("i > 0").join(mean.select(F.col("k").alias("i"), F.col("m").alias("mi")), "i").join(mean.select(F.col("k").alias("j"), F.col("m").alias("mj")), "j")
    return rows.crossJoin(F.broadcast(n)).select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), (F.col("s") / F.col("n") - F.col("mi") * F.col("mj")).alias("c"))  # n is one row


def participation_ratio(df: DataFrame, vec: str) -> DataFrame:
    """One row: trace squared over the squared Frobenius norm of the covariance; no eigenvalues needed."""
    c = covariance(df, vec)
    twice = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    return c.agg((F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0.0)), F.lit(2.0)) / F.sum(twice * F.col("c") * F.col("c"))).alias("participation_ratio"))


def spectrum(df: DataFrame, vec: str, first: int = 10, zscored: bool = False) -> DataFrame:
    """(nth, eigenvalue, share) of the covariance's largest eigenvalues, or of the correlation's; the D x D matrix goes to the driver."""
    cells = covariance(df, vec).collect()  # D (D + 1) / 2 rows
    d = 1 + max((r["j"] for r in cells), default=-1)
    c = np.zeros((d, d))
    for r in cells:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["c"]
    if zscored:
        std = np.maximum(np.sqrt(np.diag(c)), 1e-6)
        c = c / np.outer(std, std)
    values = np.maximum(np.linalg.eigvalsh(c)[::-1], 0) if d else c[0]
    rows = [(k + 1, float(v), float(v / values.sum()) if values.sum() else 0.0) for k, v in enumerate(values[:first])]
    return df.sparkSession.createDataFrame(rows, "nth int, eigenvalue double, share double")


def view_consistency(a: DataFrame, b: DataFrame, key: str, vec: str, weights=(25.0, 25.0, 1.0), eps: float = 1e-4) -> DataFrame:
    """One row: invariance, variance and covariance terms between two views of entities, and their weighted sum."""
    pairs = a.select(key, F.col(vec).alias("va")).join(b.select(key, F.col(vec).alias("vb")), key)
    mse = pairs.select(F.explode(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y))).alias("d")).agg(F.avg("d").alias("invariance"))

    def terms(df: DataFrame, name: str) -> DataFrame:
        n = df.count()
        sample = n / (n - 1.0) if n > 1 else 0.0
        off = F.when(F.col("i") != F.col("j"), 2 * F.pow(F.col("c") * sample, F.lit(2.0))).otherwise(0.0)
        hinge = F.when(F.col("i") == F.col("j"), F.greatest(F.lit(0.0), 1 - F.sqrt(F.col("c") + eps)))
        return covariance(df, name).agg(F.avg(hinge).alias(f"var_{name}"), (F.sum(off) / (F.max("i") + 1)).alias(f"cov_{name}"))

    out = mse.crossJoin(terms(pairs, "va")).crossJoin(terms(pairs, "vb"))  # one row each
    out = out.select("invariance", ((F.col("var_va") + F.col("var_vb")) / 2).alias("variance"), ((F.col("cov_va") + F.col("cov_vb")) / 2).alias("covariance"))
    return out.withColumn("loss", weights[0] * F.col("invariance") + weights[1] * F.col("variance") + weights[2] * F.col("covariance"))


def label_leakage(df: DataFrame, vec: str, label: str, eps: float = 1e-6) -> DataFrame:
    """One row: mean over dimensions of the squared correlation with a label; 0 for fewer than 3 labels or no variance."""
    y = F.col(label).cast("double")
    rows = by_dimension(df.where(y.isNotNull() & ~F.isnan(y)).withColumn("_y", y), ["_y"], vec)
    per = rows.groupBy("dim").agg(F.covar_pop("x", "_y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("_y").alias("vy"), F.count("*").alias("n"))
    r = F.col("c") / (F.sqrt(F.col("vx") + eps) * F.sqrt(F.col("vy") + eps))
    value = F.when((F.col("n") < 3) | (F.col("vy") < eps), 0.0).otherwise(r * r)
    return per.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("leakage"))


def regression_metrics(df: DataFrame, y: str, yhat: str, key: str, by: list[str]) -> DataFrame:
    """MAE, RMSE, largest error, Pearson, R2 and Spearman (ordinal ranks, ties by key) in each group.

    Ranks are ordinals over all groups, which differ from those in the group by a constant; a correlation is the same.
    """
    err = F.col(yhat) - F.col(y)
    ranked = df
    for c, r in ((y, "_ry"), (yhat, "_rp")):
        ranked = with_ordinal(ranked, [*by, c, key], r)
    return ranked.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.max(F.abs(err)).alias("max_error"), F.corr(y, yhat).alias("pearson"),
        (1 - F.sum(err * err) / (F.var_pop(y) * F.count("*"))).alias("r2"), F.corr("_ry", "_rp").alias("spearman"),
    )


def tag_metrics(preds: DataFrame, tag: str, truth: str, pred: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each tag, and of all together (tag null)."""
    rows = preds.rollup(tag).agg(
        F.count_if(F.col(truth) & F.col(pred)).alias("tp"), F.count_if(~F.col(truth) & F.col(pred)).alias("fp"), F.count_if(F.col(truth) & ~F.col(pred)).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(tag, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def floor_report(per_tag: DataFrame, tag: str, freq: str, f1: str, floors: list[int]) -> DataFrame:
    """(floor, tags, macro_f1) over the tags with at least floor uses. One row a tag meets a few floors."""
    grid = per_tag.sparkSession.createDataFrame([(int(x),) for x in floors], "floor long")
    return per_tag.join(F.broadcast(grid), F.col(freq) >= F.col("floor")).groupBy("floor").agg(F.count("*").alias("tags"), F.avg(f1).alias("macro_f1"))


def score_metrics(df: DataFrame, dim: str, probs: str, target: str) -> DataFrame:
    """Accuracy, MAE of classes and cross entropy by dimension and overall (dim null); classes count from 1."""
    guess = F.array_position(probs, F.array_max(probs))
    rows = df.select(F.col(dim), guess.alias("g"), F.col(target).alias("t"), F.element_at(probs, F.col(target).cast("int")).alias("p"))
    return rows.rollup(dim).agg(F.avg((F.col("g") == F.col("t")).cast("double")).alias("accuracy"), F.avg(F.abs(F.col("g") - F.col("t"))).alias("mae"), F.avg(-F.log("p")).alias("cross_entropy"))


def rank_metrics(ranks: DataFrame, rank: str, ks: list[int], by: list[str]) -> DataFrame:
    """Mean and median rank, share of ranks up to each k, and queries with a rank."""
    hits = [F.avg((F.col(rank) <= k).cast("double")).alias(f"hit_at_{k}") for k in ks]
    rest = ranks.groupBy(*by).agg(F.avg(rank).alias("mean_rank"), *hits, F.count(rank).alias("covered"))
    middle = medians(ranks, by, rank).withColumnRenamed("median", "median_rank")
    return join_groups(rest, middle, by, "left").select(*by, "mean_rank", "median_rank", *[f"hit_at_{k}" for k in ks], "covered")


def group_report(metrics: DataFrame, groups: DataFrame, dim: str, group: str, value: str, base: str) -> DataFrame:
    """Mean of a metric and of its baseline by group of dimensions, retention and delta."""
    rows = metrics.join(groups, dim).groupBy(group).agg(F.avg(value).alias("mean"), F.avg(base).alias("baseline"))
    return rows.withColumn("retention", F.when(F.abs("baseline") > 1e-12, F.col("mean") / F.col("baseline"))).withColumn("delta", F.col("mean") - F.col("baseline"))


def seed_summary(runs: DataFrame, config: str, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, min and max of each metric by configuration."""
    stats = [(F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max")]
    return runs.groupBy(config).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for f, n in stats])


def paired_diff(runs: DataFrame, config: str, seed: str, metric: str, base) -> DataFrame:
    """Difference to the base configuration at the same seed: mean, deviation, wins, n."""
    ref = runs.where(F.col(config) == base).select(seed, F.col(metric).alias("_base"))
    d = F.col(metric) - F.col("_base")
    return runs.where(F.col(config) != base).join(ref, seed).groupBy(config).agg(F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"), F.count_if(d > 0).alias("wins"), F.count("*").alias("n"))


def status_counts(runs: DataFrame, status: str) -> DataFrame:
    return runs.groupBy(status).agg(F.count("*").alias("runs"))


def load_profile(counts: DataFrame, key: str, batch: int) -> DataFrame:
    """Heaviest entity by reviews and by sentences, totals, and sentences of an expected and a worst batch."""
    top = counts.select("sentences").orderBy(F.desc("sentences")).limit(batch).agg(F.sum("sentences").alias("worst_batch"))
    out = counts.agg(
        F.max_by(key, F.struct("reviews", key)).alias("most_reviews"), F.max_by(key, F.struct("sentences", key)).alias("most_sentences"),
        F.sum("reviews").alias("reviews"), F.sum("sentences").alias("sentences"), (F.avg("sentences") * batch).alias("expected_batch"),
    )
    return out.crossJoin(top)  # one row each
