"""Queries for run tables, probes, sources and incremental jobs."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from reviewlake.operators import aggregates as A, probes as P, ranking as R, runs as X
from reviewlake.plans.registry import Tables, query
from reviewlake.plans.statistics import rounded, vectors
from reviewlake.session import shared_dir
from reviewlake.sources import objects as O, tables as S
from reviewlake.streaming import jobs

RUNS_SQL = "r AS (SELECT o_custkey % 40 AS cell, CASE WHEN o_orderkey % 2 = 0 THEN 'grl' ELSE 'nogrl' END AS arm, max(o_totalprice) / 1000 AS score, min(o_totalprice) / 1000 AS reco FROM orders GROUP BY 1, 2)"


def cells(t: Tables):
    arm = F.when(F.col("o_orderkey") % 2 == 0, "grl").otherwise("nogrl")
    return t.orders.groupBy((F.col("o_custkey") % 40).alias("cell"), arm.alias("arm")).agg((F.max("o_totalprice") / 1000).alias("score"), (F.min("o_totalprice") / 1000).alias("reco"))


@query("x1_grid_expand", "SELECT n_nationkey AS dim, r_regionkey AS views, CASE WHEN arm = 1 THEN 'grl' ELSE 'nogrl' END AS arm, 'd' || n_nationkey || '_v' || r_regionkey || '_a' || CASE WHEN arm = 1 THEN 'grl' ELSE 'nogrl' END AS combo_id FROM nation, region, (SELECT unnest([1, 2]) AS arm) WHERE NOT (n_nationkey = r_regionkey)")
def x1(t: Tables):
    dims, views = t.nation.select(F.col("n_nationkey").alias("dim")), t.region.select(F.col("r_regionkey").alias("views"))
    exclude = t.region.select(F.col("r_regionkey").alias("dim"), F.col("r_regionkey").alias("views"))
    return X.expand_grid(t.spark, {"dim": dims, "views": views, "arm": ["grl", "nogrl"]}, exclude)


@query("x2_config_hash", "SELECT o_orderkey, substr(sha1('o_custkey=' || o_custkey || '|o_orderstatus=' || o_orderstatus), 1, 16) AS config_hash FROM orders")
def x2(t: Tables):
    return X.config_hash(t.orders, ["o_orderstatus", "o_custkey"]).select("o_orderkey", "config_hash")


@query("x3_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def x3(t: Tables):
    return X.latest_state(t.events, "user_id", "event_id", ["event_type", "value"])


@query(
    "x4_run_classification",
    "SELECT o_orderkey AS combo_id, o_custkey AS config_hash, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'stale' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) THEN 'trained_no_eval' ELSE 'done' END AS status FROM orders",
)
def x4(t: Tables):
    grid = t.orders.select(F.col("o_orderkey").alias("combo_id"), F.col("o_custkey").alias("config_hash"))
    manifests = grid.where("combo_id % 5 <> 0").withColumn("config_hash", F.col("config_hash") + F.when(F.col("combo_id") % 7 == 0, 1).otherwise(0))
    return X.classify_runs(grid, manifests, t.lineitem.where("l_linenumber = 3").select(F.col("l_orderkey").alias("combo_id")))


@query("x5_detail_tables", "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS position, l_linenumber, l_partkey FROM lineitem")
def x5(t: Tables):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("rows"))
    return X.explode_reports(nested, "l_orderkey", "rows")


@query("x6_arm_deltas", f"WITH {RUNS_SQL} SELECT t.cell, round(t.score - c.score, 6) AS delta_score, round(abs(t.reco) - abs(c.reco), 6) AS delta_reco FROM r t JOIN r c USING (cell) WHERE t.arm = 'grl' AND c.arm = 'nogrl'")
def x6(t: Tables):
    return rounded(X.arm_deltas(cells(t), ["cell"], "arm", "grl", "nogrl", ["score", "reco"], ["reco"]), "delta_score", "delta_reco")


@query("x7_best_candidate", f"WITH {RUNS_SQL} SELECT cell, arm, 'done' AS status, CASE WHEN cell % 3 <> 0 THEN score END AS loss FROM r WHERE arm = 'grl' ORDER BY CASE WHEN cell % 3 <> 0 THEN score ELSE 'infinity'::DOUBLE END, cell LIMIT 1")
def x7(t: Tables):
    rows = cells(t).select("cell", "arm", F.when(F.col("arm") == "grl", "done").otherwise("running").alias("status"), F.when(F.col("cell") % 3 != 0, F.col("score")).alias("loss"))
    return X.best_run(rows, "cell", "loss")


@query("x8_history_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END AS loss FROM orders")
def x8(t: Tables):
    old = t.orders.where("o_orderkey % 8 <> 4").select("o_orderkey", F.col("o_totalprice").alias("loss"))
    return X.merge_history(old, t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(0.0).alias("loss")), "o_orderkey")


@query("x9_prune_rules", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN p_size = 4 AND p_brand LIKE '%1' THEN 'pair' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part WHERE p_size < 5")
def x9(t: Tables):
    rules = {"small": F.col("p_size") < 5, "pair": (F.col("p_size") == 4) & F.col("p_brand").like("%1")}
    return X.prune_report(t.part.select("p_partkey", "p_size", "p_brand"), rules).select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


@query("x10_grid_shard", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) WHERE pos % 3 = 1")
def x10(t: Tables):
    return X.grid_shard(t.part.select("p_partkey"), ["p_partkey"], 1, 3)


@query("s12_composite_score", "SELECT event_id, round(0.30 * value / 100 + 0.30 * (user_id % 10) / 10 + 0.15 * (value / 100 + 1) / 2 + 0.15 * least(user_id / 25, 1.0) - 0.05 * greatest(value / 100 - 0.5, 0) - 0.05 * abs(value / 100 - 0.5), 9) AS score FROM events")
def s12(t: Tables):
    v = F.col("value") / 100
    rows = t.events.select("event_id", v.alias("tag_micro_f1"), ((F.col("user_id") % 10) / 10).alias("hit_at_5"), v.alias("mean_text_cosine"), F.col("user_id").alias("pr"), (v - 0.5).alias("sentiment_r2"), (v - 0.5).alias("recommendation_pearson"))
    return rows.select("event_id", F.round(X.composite_score(rows), 9).alias("score"))


def rated(t: Tables):
    """Vectors with a target in 0..1 that a linear model can learn in part."""
    return vectors(t).withColumn("y", (1 + F.tanh(F.col("v")[0] * 3 - F.col("v")[5] * 2)) / 2)


@query("m1_ridge_fit_apply")
def m1(t: Tables):
    w, b = P.ridge_fit(rated(t), "v", ["y"], 10.0)
    return P.ridge_predict(rated(t), "v", w[:, 0], b[0], "prediction", "clip").select("vec_id", "y", "prediction")


@query("m2_nested_cv")
def m2(t: Tables):
    out, _ = P.ridge_cv(R.with_fold(rated(t), "vec_id", 5, 3), "vec_id", "v", "y", "fold", [1.0, 10.0, 100.0], "clip")
    return A.regression_metrics(out, "y", "prediction", "vec_id", ["fold"])


@query("m2_nested_ridge")
def m2n(t: Tables):
    out, _ = P.nested_ridge(R.with_fold(rated(t), "vec_id", 5, 3), "vec_id", "v", "y", "fold", [1.0, 10.0, 100.0], 3, "sigmoid", 3)
    return A.regression_metrics(out, "y", "prediction", "vec_id", ["fold"])


@query("m3_tag_probe")
def m3(t: Tables):
    rows = R.with_fold(vectors(t), "vec_id", 3, 1).select("vec_id", "v", "fold", *[(F.col("label") == i).cast("int").alias(f"tag{i}") for i in range(4)])
    return P.tag_probe(rows, "vec_id", "v", [f"tag{i}" for i in range(4)], "fold", 3)


COEF = "list_transform(range(64), lambda i: (i % 7 - 3) / 4.0)"


@query("m4_probe_apply", f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, tag, round(CASE tag WHEN 'none' THEN 0 ELSE 1 / (1 + exp(-greatest(least(list_dot_product(v, CAST({COEF} AS DOUBLE[])) + 0.25, 50), -50))) END, 6) AS p FROM v, (SELECT unnest(['a', 'none']) AS tag)")
def m4(t: Tables):
    params = {"a": ([(i % 7 - 3) / 4 for i in range(64)], 0.25), "none": None}
    return rounded(P.apply_probe(vectors(t).select("vec_id", "v"), "v", params).drop("v"), "p")


@query("m5_rate_probe_apply", f"WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x - 0.01) / 2) AS v FROM embeddings), p AS (SELECT vec_id, 1 / (1 + exp(-(list_dot_product(v, CAST({COEF} AS DOUBLE[])) - 0.5))) AS p FROM v) SELECT vec_id, round(p, 6) AS positive, round(1 - p, 6) AS negative FROM p")
def m5(t: Tables):
    out = P.apply_rate_probe(vectors(t), "v", [0.01] * 64, [2.0] * 64, [(i % 7 - 3) / 4 for i in range(64)], -0.5)
    return rounded(out.select("vec_id", "positive", "negative"), "positive", "negative")


@query("m6_score_regression")
def m6(t: Tables):
    means = A.summarize_vectors(vectors(t), "label", "v", "mean").withColumn("d1", F.col("summary")[0] * 10).withColumn("d2", F.col("summary")[1] * 10)
    grid = [{"scaler": s, "pca": p, "alpha": a} for s in ("standard", "l2", "none") for p in (2, 4) for a in (0.1, 1.0)]
    return P.best_config(P.score_grid(means, "label", "summary", ["d1", "d2"], grid, -3.0, 3.0))


@query("m7_score_head_apply", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(greatest(least(2 * v[1] - v[2] + 0.1, 1), -1), 6) AS d1, round(greatest(least(v[2] * 3, 1), -1), 6) AS d2 FROM v")
def m7(t: Tables):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(64)]
    out = P.apply_score_head(vectors(t), "v", [0.0] * 64, [1.0] * 64, [unit(0), unit(1)], [[2.0, -1.0], [0.0, 3.0]], [0.1, 0.0], -1.0, 1.0, ["d1", "d2"])
    return rounded(out.select("vec_id", "d1", "d2"), "d1", "d2")


@query("m8_sentiment_r2")
def m8(t: Tables):
    return P.sentiment_r2(R.with_fold(rated(t), "vec_id", 5, 3), "vec_id", "v", "y", "fold")


@query(
    "m9_selectivity",
    """WITH m AS (SELECT l_suppkey AS run, l_linenumber % 2 AS code, avg(l_quantity) AS c, avg(l_discount) AS s, avg(l_tax) AS r FROM lineitem GROUP BY 1, 2),
       j AS (SELECT a.run, b.c / a.c AS c, b.s / a.s AS s, b.r / a.r AS r FROM m a JOIN m b ON a.run = b.run AND a.code = 0 AND b.code = 1)
       SELECT run, round(c, 6) AS retention_content_f1, round(s, 6) AS retention_subjective_f1, round(r, 6) AS retention_sentiment_r2, round(c - r, 6) AS gap, CASE WHEN c - r > 0.2 THEN 'selective' WHEN c - r > 0.05 THEN 'weak' ELSE 'none' END AS verdict FROM j""",
)
def m9(t: Tables):
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("run"), (F.col("l_linenumber") % 2).alias("code")).agg(F.avg("l_quantity").alias("content_f1"), F.avg("l_discount").alias("subjective_f1"), F.avg("l_tax").alias("sentiment_r2"))
    out = P.selectivity(m.where("code = 0"), m.where("code = 1"))
    return rounded(out, "retention_content_f1", "retention_subjective_f1", "retention_sentiment_r2", "gap")


@query(
    "m10_variant_report",
    """WITH s AS (SELECT l_suppkey AS appid, l_returnflag AS tag, ['neutral', 'positive', 'negative'][1 + l_linenumber % 3] AS variant, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3)
       SELECT a.variant, round(avg(a.score - b.score), 8) AS mean_delta, round(avg(abs(a.score - b.score)), 8) AS mean_abs_delta, count(*) AS n FROM s a JOIN s b ON a.appid = b.appid AND a.tag = b.tag AND b.variant = 'neutral' WHERE a.variant <> 'neutral' GROUP BY 1""",
)
def m10(t: Tables):
    variant = F.element_at(F.array(F.lit("neutral"), F.lit("positive"), F.lit("negative")), (1 + F.col("l_linenumber") % 3).cast("int"))
    scores = t.lineitem.groupBy(F.col("l_suppkey").alias("appid"), F.col("l_returnflag").alias("tag"), variant.alias("variant")).agg(F.avg("l_discount").alias("score"))
    return rounded(P.variant_report(scores), "mean_delta", "mean_abs_delta", digits=8)


@query("m10_variant_robustness")
def m10r(t: Tables):
    tags = [f"tag{i}" for i in range(4)]
    rows = R.split3(vectors(t), "vec_id", seed=2).select("vec_id", "v", "split", *[(F.col("label") % 4 == i).cast("int").alias(k) for i, k in enumerate(tags)])
    less = lambda n: F.transform("v", lambda z, i: F.when(i < n, z).otherwise(z / 2))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), less(n).alias("v")) for k, n in (("neutral", 64), ("positive", 40), ("negative", 24), ("noname", 8))]))
    variants = rows.where("vec_id % 3 <> 0").select("vec_id", kinds.alias("x")).select("vec_id", "x.variant", "x.v")
    out = P.variant_robustness(rows, variants, "vec_id", "variant", "v", tags, "split", [1.0, 10.0, 100.0])
    return rounded(out, *[c for c in out.columns if c not in ("part", "n")])


@query("m11_binary_loo")
def m11(t: Tables):
    means = A.summarize_vectors(vectors(t), "label", "v", "mean").withColumn("d1", F.col("summary")[0]).withColumn("d2", F.col("summary")[1])
    return P.loo_group_f1(means, "label", "summary", ["d1", "d2"], {"d1": "functional", "d2": "psychological"})


@query("m11_binary_loo_pca")
def m11p(t: Tables):
    means = A.summarize_vectors(vectors(t), "label", "v", "mean").withColumn("d1", F.col("summary")[0]).withColumn("d2", F.col("summary")[1])
    return P.loo_pca_f1(means, "label", "summary", ["d1", "d2"], {"d1": "functional", "d2": "psychological"})


@query("m12_mlp_apply")
def m12(t: Tables):
    rng = np.random.default_rng(5)
    layers = [(rng.normal(size=(64, 16)) / 8, np.zeros(16)), (rng.normal(size=(16, 1)), np.zeros(1))]
    return P.apply_mlp(vectors(t), "v", layers).groupBy("label").agg(F.avg("score").alias("sentiment"))


@query("m13_embed_sentences")
def m13(t: Tables):
    return P.embed(t.conversations.select("conv_id", "turn", "text"), "text", P.hashing_provider(32), 32).drop("text")


def scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/reviewlake/{name}-{uuid.uuid4().hex}"


@query("a1_scan_reviews", "SELECT CAST(doc_id AS VARCHAR) AS appid, md5(replace(text, chr(13), '')) AS review, CAST(n_chars AS VARCHAR) AS recommend FROM documents")
def a1(t: Tables):
    """Written as CSV and read back with columns inferred."""
    path = scratch(t, "csv")
    rows = t.documents.select(F.col("doc_id").alias("App_ID"), F.replace("text", F.lit("\r"), F.lit("")).alias("Review_Text"), F.col("n_chars").alias("Score"))
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.with_logical_columns(S.scan_reviews(t.spark, path, "csv")).withColumn("review", F.md5("review"))


@query("a2_infer_columns", "SELECT CAST(doc_id AS VARCHAR) AS appid, md5(text) AS review, lang AS name, n_chars AS recommend FROM documents")
def a2(t: Tables):
    """Columns under names that only their letters and digits give away."""
    odd = t.documents.select(F.col("doc_id").cast("string").alias(" App-ID"), F.col("text").alias("Review.Text"), F.col("lang").alias("Game  Name"), F.col("n_chars").alias("Voted/Up"))
    return S.with_logical_columns(odd).withColumn("review", F.md5("review"))


def filed(t: Tables, name: str, rows, key: str) -> str:
    """Write rows (key, value) as text, a file for each key."""
    path = scratch(t, name)
    rows.repartition(key).write.partitionBy(key).text(path)
    return path


@query("a3_scan_entities", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, s_acctbal AS balance FROM supplier")
def a3(t: Tables):
    entry = F.struct(F.col("s_suppkey").cast("string"), F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    objects = t.supplier.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return S.scan_entities(t.spark, filed(t, "entities", objects, "s_nationkey"), "name string, balance double")


@query("a3_scan_large_entities", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_acctbal AS balance FROM customer")
def a3l(t: Tables):
    entry = F.struct(F.col("c_custkey").cast("string"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.array(F.struct(F.lit("a } in a string").alias("note"))).alias("more")))
    files = t.customer.groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return O.scan_large_entities(t.spark, filed(t, "large-entities", files, "c_nationkey"), "name string, balance double")


@query("a7_scan_treebank", "SELECT p_name AS phrase, CAST(p_partkey AS VARCHAR) AS phrase_id FROM part")
def a7(t: Tables):
    path = scratch(t, "treebank")
    t.part.select(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string"))).write.text(path)
    return S.scan_treebank(t.spark, path, ["phrase", "phrase_id"])


@query("a7_scan_lines", "SELECT CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS row, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer")
def a7l(t: Tables):
    line = F.struct("c_custkey", F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("line"))
    files = t.customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("value"))
    return S.scan_lines(t.spark, filed(t, "lines", files, "c_nationkey"), ["id", "name"])


@query("a8_scan_reports", "SELECT CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS id, CASE WHEN c_nationkey % 5 <> 0 THEN count(*) END AS customers, CASE WHEN c_nationkey % 5 = 0 THEN 'bad_json' ELSE 'ok' END AS status FROM customer GROUP BY c_nationkey")
def a8(t: Tables):
    """A report for each nation; those of every fifth are torn."""
    reports = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers")).withColumn("json", F.to_json(F.struct(F.col("c_nationkey").alias("id"), "customers")))
    torn = F.when(F.col("c_nationkey") % 5 == 0, F.expr("substring(json, 1, 5)")).otherwise(F.col("json"))
    path = filed(t, "reports", reports.select("c_nationkey", torn.alias("value")), "c_nationkey")
    return S.scan_reports(t.spark, path, "id long, customers long").select("id", "customers", "status")


@query("a4_write_reviews", "SELECT source AS appid, count(*) AS reviews FROM documents GROUP BY 1")
def a4(t: Tables):
    path = scratch(t, "reviews")
    S.write_reviews(t.documents.select(F.col("source").alias("appid"), "doc_id"), path, 8)
    return t.spark.read.parquet(path).groupBy("appid").agg(F.count("*").alias("reviews"))


@query("a5_write_corpus", "SELECT (SELECT count(DISTINCT source) FROM documents) AS games, (SELECT count(*) FROM documents) AS reviews, (SELECT count(*) FROM conversations) AS sentences")
def a5(t: Tables):
    path = scratch(t, "corpus")
    S.write_corpus(t.documents.select("source").distinct(), t.documents.select("source", "doc_id"), t.conversations, path)
    games, reviews, sentences = S.read_corpus(t.spark, path)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(games, "games").crossJoin(n(reviews, "reviews")).crossJoin(n(sentences, "sentences"))  # one row each


@query("a9_export_tables", "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS id, NULL::VARCHAR AS region FROM nation UNION ALL SELECT r_name, NULL, CAST(r_regionkey AS VARCHAR) FROM region")
def a9(t: Tables):
    path = scratch(t, "export")
    S.export_table([t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))], path, "csv", ["name"])
    return t.spark.read.csv(path, header=True)


def streamed(t: Tables, name: str):
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name[:-1]}[{name[-1]}].parquet")


def taken(t: Tables, df):
    return jobs.run_available(df, scratch(t, "stream"))


@query("w1_follow_run_log", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def w1(t: Tables):
    return taken(t, jobs.stream_latest(streamed(t, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")).select("user_id", "event_type", "value")


@query("w1_follow_recent_runs", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def w1r(t: Tables):
    changes = jobs.follow_runs(streamed(t, "events").select("user_id", "event_id", "ts", "event_type", "value"), "user_id", "event_id", "ts", "40 days")
    return jobs.merge_available(changes, scratch(t, "stream"), "user_id", "event_id").select("user_id", "event_type", "value")


@query("w2_incremental_prep", "SELECT source AS appid, count(*) AS kept FROM documents WHERE length(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))) > 300 GROUP BY 1")
def w2(t: Tables):
    return taken(t, jobs.stream_review_counts(streamed(t, "documents"), "source", "text"))
