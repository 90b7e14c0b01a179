"""Retrieval, top-k, topic words, thresholds and samples. Every ranking has a tie-break, every sample an md5 order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewlake.functions.vectors import doubles, is_finite
from reviewlake.operators.corpus import with_ordinal
from reviewlake.operators.density import density_clusters
from reviewlake.operators.neighbours import nearest, retrieve  # noqa: F401 - part of this module's interface
from reviewlake.session import materialize

MAX_QUERIES = 10_000


def md5_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def match_by_tags(scores: DataFrame, weights: DataFrame, k: int, reasons: int = 5) -> DataFrame:
    """(query, nth, appid, score, why): tag scores times tag weights over the norms; both tables are sparse, by tag."""
    total = lambda df, key, col, name: df.groupBy(key).agg((F.sqrt(F.sum(F.col(col) * F.col(col))) + 1e-8).alias(name))
    parts = scores.join(weights, "tag").withColumn("part", F.col("score") * F.col("weight"))
    both = parts.groupBy("query", "appid").agg(F.sum("part").alias("dot"), F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct((-F.col("part")).alias("p"), "tag")))).alias("by"))
    rows = both.join(total(scores, "query", "score", "_nq"), "query").join(total(weights, "appid", "weight", "_na"), "appid")
    rows = rows.withColumn("match", F.col("dot") / (F.col("_nq") * F.col("_na")))
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("match"), "appid"))
    why = F.array_join(F.transform(F.slice("by", 1, reasons), lambda s: s["tag"]), ",")
    return rows.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "nth", "appid", "match", why.alias("why"))


def topic_words(docs: DataFrame, topic: str, text: str, n: int = 10, min_df: int = 2, max_df: float = 0.95, pattern: str = r"[a-z]{3,}", stop: list[str] = ()) -> DataFrame:
    """(topic, nth, term, score): class-based tf-idf of one- and two-word terms: tf * ln(1 + A / f)."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(list(stop)) if stop else F.lit(True))
    rows = docs.select(F.col(topic).alias("topic"), F.explode(F.array(words)).alias("w"))
    pairs = F.zip_with(F.col("w"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    # a document's terms in order, so that the first of each is known without a shuffle by document; exploded arrays of one are worked out once
    rows = rows.select("topic", F.explode(F.array(F.array_sort(F.concat("w", F.filter(pairs, lambda p: p.isNotNull()))))).alias("t"))
    first = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when(i == 0, 1).otherwise((F.col("t")[i - 1] != x).cast("int")).alias("first")))
    rows = rows.select("topic", F.explode(first).alias("x")).select("topic", "x.term", "x.first")
    seen = materialize(rows.groupBy("topic", "term").agg(F.count("*").alias("tf"), F.sum("first").alias("df")), "topic-terms")
    total = docs.count()
    kept = seen.groupBy("term").agg(F.sum("tf").alias("f"), F.sum("df").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * total)).select("term", "f")
    terms = seen.join(kept, "term")
    per = terms.groupBy("topic").agg(F.sum("tf").alias("size"))
    mean = per.agg(F.avg("size").alias("a"))
    rows = terms.join(per, "topic").crossJoin(F.broadcast(mean))  # one row
    score = F.col("tf") / F.col("size") * F.log(1 + F.col("a") / F.col("f"))
    nth = F.row_number().over(W.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), "term"))
    return rows.withColumn("score", score).withColumn("nth", nth).where(F.col("nth") <= n).select("topic", "nth", "term", "score")


def topic_report(docs: DataFrame, topic: str, key: str, examples: int = 3) -> DataFrame:
    """Documents of each topic, share of all, whether it holds the outliers (-1), and its first documents."""
    total = docs.count()
    first = docs.withColumn("_n", F.row_number().over(W.partitionBy(topic).orderBy(key))).where(F.col("_n") <= examples)
    first = first.groupBy(topic).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("examples"))
    rows = docs.groupBy(topic).agg(F.count("*").alias("docs"))
    return rows.join(first, topic).select(topic, "docs", (F.col("docs") / total).alias("share"), (F.col(topic).cast("string") == "-1").alias("outliers"), "examples")


def assign_topics(df: DataFrame, key: str, vec: str, k: int, dims: int = 5, outlier_quantile: float = 0.9, seed: int = 1) -> DataFrame:
    """(key, topic): PCA, k-means, and -1 for those farther from their centre than the quantile. Not density clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.col(vec)).alias("features"))
    small = PCA(k=dims, inputCol="features", outputCol="pca").fit(rows).transform(rows).select(key, "pca")
    model = KMeans(k=k, seed=seed, featuresCol="pca", predictionCol="topic").fit(small)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(small).withColumn("x", vector_to_array("pca"))
    gap = F.zip_with(F.col("x"), F.element_at(centres, F.col("topic") + 1), lambda a, b: (a - b) * (a - b))
    out = materialize(out.select(key, "topic", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x).alias("d")), "topics")
    cut = out.approxQuantile("d", [outlier_quantile], 0.001)
    return out.select(key, F.when(F.col("d") > (cut[0] if cut else math.inf), -1).otherwise(F.col("topic")).alias("topic"))


def assign_subtopics(df: DataFrame, topics: DataFrame, key: str, vec: str, parent: int, k: int, **options) -> DataFrame:
    """Topics within one parent topic."""
    return assign_topics(df.join(topics.where(F.col("topic") == parent).select(key), key, "left_semi"), key, vec, k, **options)


def principal(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """(key, z): the first dims principal components; null where a vector is null, not finite, or of another length than most."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sound = is_finite(doubles(F.col(vec)))
    sizes = df.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not sizes or sizes["n"] < 1:
        return df.select(key, F.lit(None).cast("array<double>").alias("z"))
    rows = df.withColumn("_ok", sound & (F.size(vec) == sizes["n"]))
    good = rows.where("_ok").select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    small = PCA(k=min(dims, sizes["n"]), inputCol="_v", outputCol="_z").fit(good).transform(good).select(key, vector_to_array("_z").alias("z"))
    return small.unionByName(rows.where("not _ok").select(key, F.lit(None).cast("array<double>").alias("z")))


def density_topics(df: DataFrame, key: str, vec: str, eps: float, min_points: int, dims: int = 5, min_size: int = 1) -> DataFrame:
    """(key, topic): density clusters of the first principal components, numbered from 0 by size; -1 outliers and clusters below min_size."""
    z = materialize(principal(df, key, vec, dims), "topic-components")
    found = materialize(density_clusters(z, key, "z", dims, eps, min_points), "topic-clusters")
    sizes = found.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    topics = with_ordinal(sizes.withColumn("_o", -F.col("n")), ["_o", "cluster"], "topic").select("cluster", "topic")
    return found.join(topics, "cluster", "left").select(key, F.coalesce(F.col("topic").cast("int"), F.lit(-1)).alias("topic"))


def density_subtopics(df: DataFrame, topics: DataFrame, key: str, vec: str, parent: int, **options) -> DataFrame:
    """Density topics within one parent topic, from components of its own vectors."""
    return density_topics(df.join(topics.where(F.col("topic") == parent).select(key), key, "left_semi"), key, vec, **options)


def balanced_prefix(df: DataFrame, entity: str, order: list[str], length: str, max_docs: int, min_chars: int) -> DataFrame:
    """The first ceil(max_docs / entities) documents of each entity that are long enough, max_docs in all, in corpus order."""
    rows = df.where(F.col(length) >= min_chars)
    each = math.ceil(max_docs / max(1, rows.select(entity).distinct().count()))
    nth = F.row_number().over(W.partitionBy(entity).orderBy(*order))
    kept = rows.withColumn("_n", nth).where(F.col("_n") <= each).drop("_n")
    return with_ordinal(kept, [entity, *order], "_at").where(F.col("_at") < max_docs).drop("_at")


def sample_views(reviews: DataFrame, entity: str, review: str, fraction: float, views: int, seed: int) -> DataFrame:
    """(view, entity, review): ceil(n * fraction) reviews of each entity for each view, without replacement."""
    sizes = reviews.groupBy(entity).agg(F.ceil(F.count("*") * fraction).alias("_take"))
    rows = reviews.join(sizes, entity).withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    nth = F.row_number().over(W.partitionBy(entity, "view").orderBy(md5_order(seed, "view", review), review))
    return rows.withColumn("_n", nth).where(F.col("_n") <= F.col("_take")).select("view", entity, review)


def anchored_subset(ids: DataFrame, key: str, anchors: list, n: int, seed: int) -> DataFrame:
    """n ids: the anchors in their order, then others by seeded md5. A missing anchor raises ValueError."""
    known = {r[0] for r in ids.where(F.col(key).isin(anchors)).select(key).distinct().collect()}
    if missing := [a for a in anchors if a not in known]:
        raise ValueError(f"no such ids: {missing}")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, anchors)), F.col(key)), F.lit(0))
    return ids.select(key).distinct().withColumn("_p", F.when(place > 0, place)).orderBy(F.asc_nulls_last("_p"), md5_order(seed, key), key).limit(n).select(key)


def epoch_batches(entities: DataFrame, key: str, size_col: str, order: str, batch: int, steps: int, seed: int = 0) -> DataFrame:
    """(step, key): order is random, largest, smallest or file; passes repeat until `steps` batches."""
    per_pass = max(1, math.ceil(entities.count() / batch))
    passes = math.ceil(steps / per_pass)
    rows = entities.select(key, size_col).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    by = {"random": md5_order(seed, "_pass", key), "largest": -F.col(size_col), "smallest": F.col(size_col), "file": F.lit(0)}[order]
    rows = with_ordinal(rows.withColumn("_by", by), ["_pass", "_by", key], "_at").withColumn("_first", F.lit(0))
    start = entities.count()
    step = F.col("_pass") * per_pass + F.floor((F.col("_at") - F.col("_pass") * start) / batch)
    return rows.select(step.cast("long").alias("step"), key).where(F.col("step") < steps)


def with_fold(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Folds 0..k-1 whose sizes differ by one at most, over a seeded order."""
    n = df.count()
    at = with_ordinal(df.withColumn("_h", md5_order(seed, key)), ["_h", key], "_at")
    big, small = n % k, n // k
    cut = big * (small + 1)
    fold = F.when(F.col("_at") < cut, F.floor(F.col("_at") / (small + 1))).otherwise(big + F.floor((F.col("_at") - cut) / max(1, small)))
    return at.withColumn(name, fold.cast("int")).drop("_h", "_at")


def split3(df: DataFrame, key: str, fractions=(0.7, 0.15), seed: int = 0) -> DataFrame:
    """train, val or test by a seeded order; sizes are n * fraction, halves to even; validation and test get one row at least."""
    n = df.count()
    train = min(max(1, round(n * fractions[0])), max(1, n - 2))
    val = min(max(1, round(n * fractions[1])), max(1, n - train - 1))
    rows = with_ordinal(df.withColumn("_h", md5_order(seed, key)), ["_h", key], "_at")
    return rows.withColumn("split", F.when(F.col("_at") < train, "train").when(F.col("_at") < train + val, "val").otherwise("test")).drop("_h", "_at")


def group_split(df: DataFrame, groups: list[str], ratio: float, seed: int) -> DataFrame:
    """Add held_out: whole groups (their values joined by |), round(groups * ratio) of them, one at least."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in groups])
    rows = df.withColumn("group", name)
    names = rows.select("group").distinct()
    take = max(1, round(names.count() * ratio))
    out = names.orderBy(md5_order(seed, "group"), "group").limit(take).withColumn("held_out", F.lit(True))
    return rows.join(out, "group", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """(held_out, key) of all rows but the held-out one; for tables of tens of rows, at most MAX_QUERIES."""
    ids = df.select(key).distinct()
    if ids.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError("too many rows for leave-one-out")
    held = F.broadcast(ids.select(F.col(key).alias("held_out")))
    return held.join(ids, F.col("held_out") != F.col(key))


def best_threshold(scores: DataFrame, by: list[str], score: str, truth: str, grid: list[float]) -> DataFrame:
    """(by, threshold, f1): the first threshold with the best F1."""
    rows = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, grid)))).withColumn("_p", F.col(score) >= F.col("threshold"))
    f1 = rows.groupBy(*by, "threshold").agg(F.count_if(F.col("_p") & F.col(truth)).alias("tp"), F.count_if(F.col("_p") != F.col(truth)).alias("off"))
    f1 = f1.withColumn("f1", F.when(2 * F.col("tp") + F.col("off") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("off"))).otherwise(0.0))
    best = f1.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(*by, (-F.col("b.t")).alias("threshold"), "b.f1")


def top_errors(df: DataFrame, y: str, yhat: str, key: str, by: str, k: int) -> DataFrame:
    """k rows by prediction, truth or error, largest first."""
    rows = df.withColumn("error", F.abs(F.col(yhat) - F.col(y)))
    return rows.orderBy(F.desc({"prediction": yhat, "truth": y, "error": "error"}[by]), key).limit(k)


def separated_top(df: DataFrame, key: str, x: str, y: str, weight: str, distance: float, n: int) -> DataFrame:
    """At most n points, heaviest first, each at least distance from all kept. One job a kept point; n is tens."""
    rows, kept = materialize(df.select(key, x, y, weight), "separated"), []
    far = F.lit(True)
    while len(kept) < n:
        best = rows.where(far).agg(F.max(F.struct(weight, (-F.col(key)).alias("k"), x, y)).alias("b")).first()["b"]
        if best is None:
            break
        kept.append((-best["k"], float(best[x]), float(best[y]), float(best[weight])))
        far = far & (F.hypot(F.col(x) - best[x], F.col(y) - best[y]) >= distance)
    return df.sparkSession.createDataFrame(kept, f"{key} long, {x} double, {y} double, {weight} double")


def near_neighbours(df: DataFrame, queries: DataFrame, key: str, vec: str, k: int, radius: float | None = None, seed: int = 1) -> DataFrame:
    """(query, nth, key, distance): the k nearest other rows of unit length, exactly, by an index that bounds what is looked at.

    radius is not needed for that and without effect.
    """
    return nearest(df, queries, key, vec, k, seed, unit=True)
