"""Queries for retrieval, topics, samples, splits, tags and flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import text as T, vectors as V
from reviewlake.operators import aggregates as A, flow, ranking as R, tags as G
from reviewlake.plans.registry import Tables, query
from reviewlake.plans.statistics import LONG, rounded, vectors

VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("f1_l2_normalize", f"WITH {VEC} SELECT vec_id, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-8), 6) AS a, round(v[2] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS b FROM v")
def f1(t: Tables):
    return vectors(t).select("vec_id", F.round(V.l2_normalize(F.col("v"))[0], 6).alias("a"), F.round(V.l2_normalize(F.col("v"), mode="clip")[1], 6).alias("b"))


CENTRES = f"{LONG}, m AS (SELECT label, list(a ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS a FROM x GROUP BY 1, 2) GROUP BY 1), {VEC}"


@query("f2_cosine", f"WITH {CENTRES} SELECT vec_id, round(list_dot_product(v, c) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(c, c)) + 1e-8)), 6) AS cosine FROM v JOIN m USING (label)")
def f2(t: Tables):
    centres = A.summarize_vectors(vectors(t), "label", "v", "mean")
    return vectors(t).join(centres, "label").select("vec_id", F.round(V.cosine(F.col("v"), F.col("summary")), 6).alias("cosine"))


PAIRED = "q AS (SELECT vec_id AS query, v AS q FROM v WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id, round(list_dot_product(v, q) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(q, q)) + 1e-8)), 9) AS sim FROM v, q)"
SIMS = f"WITH {VEC}, {PAIRED}"
SCALED = f"WITH {LONG}, d AS (SELECT dim, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS s FROM x GROUP BY 1), v AS (SELECT vec_id, list((x - m) / s ORDER BY dim) AS v FROM x JOIN d USING (dim) GROUP BY 1), {PAIRED}"
RANKS = "a AS (SELECT query, sim AS aim FROM s WHERE vec_id = query + 1) SELECT query, round(max(aim), 6) AS similarity, 1 + count(*) FILTER (sim > aim AND vec_id <> query + 1) AS rank FROM s JOIN a USING (query) GROUP BY 1"
BEST = "SELECT query, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS nth, vec_id, round(sim, 6) AS sim FROM s QUALIFY nth <= 5"


def retrieved(t: Tables, scaled: bool = False):
    rows = vectors(t)
    if scaled:
        rows = A.apply_scaler(rows, A.fit_scaler(rows, "v"), "v")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), (F.col("vec_id") + 1).alias("target"), "v")
    return R.retrieve(rows, queries, "vec_id", "v", 5)


@query("f3_retrieval_rank", f"{SIMS}, {RANKS}")
def f3(t: Tables):
    return rounded(retrieved(t)[0], "similarity")


@query("f3_retrieval_top", f"{SIMS} {BEST}")
def f3t(t: Tables):
    return rounded(retrieved(t)[1], "sim")


@query("f3_scaled_rank", f"{SCALED}, {RANKS}")
def f3s(t: Tables):
    return rounded(retrieved(t, True)[0], "similarity")


@query("f3_scaled_top", f"{SCALED} {BEST}")
def f3st(t: Tables):
    return rounded(retrieved(t, True)[1], "sim")


@query(
    "f4_match_by_tags",
    """WITH s AS (SELECT c_nationkey AS query, c_mktsegment AS tag, avg(c_acctbal) AS score FROM customer GROUP BY 1, 2), w AS (SELECT o_orderpriority || '' AS appid, c_mktsegment AS tag, sum(o_totalprice) AS weight FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
       p AS (SELECT query, appid, tag, score * weight AS part FROM s JOIN w USING (tag)), b AS (SELECT query, appid, sum(part) AS dot, array_to_string(list(tag ORDER BY part DESC, tag) FILTER (part > 0)[1:5], ',') AS why FROM p GROUP BY 1, 2),
       m AS (SELECT query, appid, dot / (nq * na) AS m, coalesce(why, '') AS why FROM b JOIN (SELECT query, sqrt(sum(score * score)) + 1e-8 AS nq FROM s GROUP BY 1) USING (query) JOIN (SELECT appid, sqrt(sum(weight * weight)) + 1e-8 AS na FROM w GROUP BY 1) USING (appid))
       SELECT query, row_number() OVER (PARTITION BY query ORDER BY m DESC, appid) AS nth, appid, round(m, 6) AS "match", why FROM m QUALIFY nth <= 3""",
)
def f4(t: Tables):
    scores = t.customer.groupBy(F.col("c_nationkey").alias("query"), F.col("c_mktsegment").alias("tag")).agg(F.avg("c_acctbal").alias("score"))
    weights = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("o_orderpriority").alias("appid"), F.col("c_mktsegment").alias("tag")).agg(F.sum("o_totalprice").alias("weight"))
    return rounded(R.match_by_tags(scores, weights, 3), "match")


@query(
    "f5_topic_words",
    """WITH w AS (SELECT doc_id, lang AS topic, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents),
       t AS (SELECT doc_id, topic, unnest(w || list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda x: x IS NOT NULL)) AS term FROM w),
       d AS (SELECT topic, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY 1, 2),
       k AS (SELECT term, sum(tf) AS f FROM d GROUP BY 1 HAVING sum(df) >= 2 AND sum(df) <= 0.95 * (SELECT count(*) FROM documents)),
       x AS (SELECT d.topic, term, tf, f, sum(tf) OVER (PARTITION BY d.topic) AS size FROM d JOIN k USING (term)), a AS (SELECT avg(size) AS a FROM (SELECT DISTINCT topic, size FROM x))
       SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(tf / size * ln(1 + a / f), 9) DESC, term) AS nth, term, round(tf / size * ln(1 + a / f), 6) AS score FROM x, a QUALIFY nth <= 10""",
)
def f5(t: Tables):
    return rounded(R.topic_words(t.documents, "lang", "text"), "score")


@query("f6_topic_assignment")
def f6(t: Tables):
    return R.assign_topics(vectors(t), "vec_id", "v", 8)


@query("f7_subtopics")
def f7(t: Tables):
    topics = R.assign_topics(vectors(t), "vec_id", "v", 4)
    return R.assign_subtopics(vectors(t), topics, "vec_id", "v", 0, 3)


@query("e23_topic_table", "SELECT lang, count(*) AS docs, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, FALSE AS outliers, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') AS examples FROM documents GROUP BY 1")
def e23(t: Tables):
    return rounded(R.topic_report(t.documents, "lang", "doc_id").withColumn("outliers", F.coalesce("outliers", F.lit(False))), "share")


def density_topics(t: Tables):
    return R.density_topics(vectors(t), "vec_id", "v", eps=0.15, min_points=8, min_size=20)


@query("f6_density_topics")
def f6d(t: Tables):
    return density_topics(t)


@query("f7_density_subtopics")
def f7d(t: Tables):
    return R.density_subtopics(vectors(t), density_topics(t), "vec_id", "v", 0, eps=0.14, min_points=8, min_size=10)


@query(
    "f8_balanced_prefix",
    """WITH q AS (SELECT source, doc_id FROM documents WHERE n_chars >= 400), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM q)
       SELECT source, doc_id FROM (SELECT *, row_number() OVER (ORDER BY source, doc_id) AS pos FROM k WHERE n <= ceil(90 / (SELECT count(DISTINCT source) FROM q))) WHERE pos <= 90""",
)
def f8(t: Tables):
    return R.balanced_prefix(t.documents, "source", ["doc_id"], "n_chars", 90, 400).select("source", "doc_id")


VIEWS_SQL = "SELECT view, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, view ORDER BY md5('3:' || view || ':' || doc_id), doc_id) AS n, ceil(count(*) OVER (PARTITION BY source, view) * 0.3) AS take FROM documents, (SELECT unnest([0, 1]) AS view)) WHERE n <= take"


@query("f9_view_sample", VIEWS_SQL)
def f9(t: Tables):
    return R.sample_views(t.documents.select("source", "doc_id"), "source", "doc_id", 0.3, 2, 3)


@query(
    "f10_sentence_view_mean",
    f"""WITH {LONG}, s AS (SELECT view, label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label, view ORDER BY md5('5:' || view || ':' || vec_id), vec_id) AS n, ceil(count(*) OVER (PARTITION BY label, view) * 0.5) AS take FROM embeddings, (SELECT unnest([0, 1, 2]) AS view)) WHERE n <= take),
       m AS (SELECT view, label, dim, avg(x) AS x FROM s JOIN x USING (label, vec_id) GROUP BY 1, 2, 3) SELECT label, dim AS i, round(avg(x), 6) AS x FROM m GROUP BY 1, 2""",
)
def f10(t: Tables):
    from reviewlake.plans.statistics import summary_rows

    picked = R.sample_views(vectors(t), "label", "vec_id", 0.5, 3, 5).join(vectors(t).select("vec_id", "v"), "vec_id")
    means = A.summarize_vectors(picked.withColumn("key", F.struct("view", "label")), "key", "v", "mean")
    return summary_rows(A.summarize_vectors(means.select("key.label", F.col("summary").alias("s")), "label", "s", "mean"))


@query("f11_anchored_subset", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE p_partkey WHEN 7 THEN 1 WHEN 3 THEN 2 END NULLS LAST, md5('11:' || p_partkey), p_partkey) AS n FROM part) WHERE n <= 40")
def f11(t: Tables):
    return R.anchored_subset(t.part, "p_partkey", [7, 3], 40, 11)


@query(
    "f12_epoch_batches",
    """WITH e AS (SELECT s_suppkey, s_acctbal, (SELECT count(*) FROM supplier) AS n FROM supplier), o AS (SELECT *, row_number() OVER (ORDER BY -s_acctbal, s_suppkey) - 1 AS pos FROM e),
       p AS (SELECT s_suppkey, pos, n, unnest(range(0, CAST(ceil(9 / ceil(n / 4.0)) AS INT))) AS pass FROM o)
       SELECT CAST(pass * ceil(n / 4.0) + floor(pos / 4) AS BIGINT) AS step, s_suppkey FROM p WHERE pass * ceil(n / 4.0) + floor(pos / 4) < 9""",
)
def f12(t: Tables):
    return R.epoch_batches(t.supplier, "s_suppkey", "s_acctbal", "largest", 4, 9)


@query("f13_k_fold", "SELECT doc_id, ntile(5) OVER (ORDER BY md5('4:' || doc_id), doc_id) - 1 AS fold FROM documents")
def f13(t: Tables):
    return R.with_fold(t.documents.select("doc_id"), "doc_id", 5, 4)


@query("f14_split3", "SELECT p_partkey, CASE WHEN pos < round_even(n * 0.7, 0) THEN 'train' WHEN pos < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('2:' || p_partkey), p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part)")
def f14(t: Tables):
    return R.split3(t.part.select("p_partkey"), "p_partkey", seed=2)


@query(
    "f15_group_split",
    """WITH g AS (SELECT p_partkey, p_brand || '|' || p_size AS "group" FROM part), n AS (SELECT DISTINCT "group" FROM g),
       h AS (SELECT "group", row_number() OVER (ORDER BY md5('6:' || "group"), "group") <= greatest(1, round_even((SELECT count(*) FROM n) * 0.2, 0)) AS held_out FROM n) SELECT p_partkey, "group", held_out FROM g JOIN h USING ("group")""",
)
def f15(t: Tables):
    return R.group_split(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], 0.2, 6).select("p_partkey", "group", "held_out")


@query("f16_leave_one_out", "SELECT a.n_nationkey AS held_out, b.n_nationkey FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey")
def f16(t: Tables):
    return R.leave_one_out(t.nation, "n_nationkey")


GRID = [0.1 + 0.8 * k / 16 for k in range(17)]


@query(
    "f17_threshold_sweep",
    f"""WITH s AS (SELECT event_type, value / 100 AS score, user_id % 3 = 0 AS truth FROM events), g AS (SELECT unnest([{', '.join(map(repr, GRID))}]::DOUBLE[]) AS threshold),
       f AS (SELECT event_type, threshold, count(*) FILTER (score >= threshold AND truth) AS tp, count(*) FILTER ((score >= threshold) <> truth) AS off FROM s, g GROUP BY 1, 2),
       r AS (SELECT *, CASE WHEN 2 * tp + off > 0 THEN 2 * tp / (2 * tp + off) ELSE 0 END AS f1 FROM f) SELECT event_type, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY f1 DESC, threshold) = 1""",
)
def f17(t: Tables):
    rows = t.events.select("event_type", (F.col("value") / 100).alias("score"), (F.col("user_id") % 3 == 0).alias("truth"))
    return rounded(R.best_threshold(rows, ["event_type"], "score", "truth", GRID), "threshold", "f1")


@query("f18_top_errors", "SELECT o_orderkey, o_totalprice AS y, o_custkey * 100.0::DOUBLE AS yhat, abs(o_custkey * 100.0::DOUBLE - o_totalprice) AS error FROM orders ORDER BY error DESC, o_orderkey LIMIT 25")
def f18(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("y"), (F.col("o_custkey") * 100.0).alias("yhat"))
    return R.top_errors(rows, "y", "yhat", "o_orderkey", "error", 25)


@query("f19_greedy_separation")
def f19(t: Tables):
    rows = t.part.select("p_partkey", (F.col("p_size") / 5).alias("x"), (F.col("p_partkey") % 97 / 10).alias("y"), F.col("p_retailprice").alias("w"))
    return R.separated_top(rows, "p_partkey", "x", "y", "w", 2.5, 8)


@query(
    "f19_separated_points",
    """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size / 5 AS x, (p_partkey % 97) / 10 AS y, p_retailprice AS w FROM part),
       g AS (SELECT 0 AS n, CAST([] AS STRUCT(k BIGINT, x DOUBLE, y DOUBLE, w DOUBLE)[]) AS kept
         UNION ALL SELECT n + 1, list_append(kept, (SELECT {'k': k, 'x': x, 'y': y, 'w': w} FROM p WHERE len(list_filter(g.kept, lambda q: sqrt((q.x - x) * (q.x - x) + (q.y - y) * (q.y - y)) < 2.45)) = 0 ORDER BY w DESC, k LIMIT 1)) FROM g WHERE n < 8)
       SELECT q.k AS p_partkey, q.x AS x, q.y AS y, q.w AS w FROM (SELECT unnest(kept) AS q FROM g WHERE n = 8) WHERE q.k IS NOT NULL""",
)
def f19s(t: Tables):
    """As f19, at a distance that no two points have exactly."""
    rows = t.part.select("p_partkey", (F.col("p_size") / 5).alias("x"), (F.col("p_partkey") % 97 / 10).alias("y"), F.col("p_retailprice").alias("w"))
    return R.separated_top(rows, "p_partkey", "x", "y", "w", 2.45, 8)


@query(
    "f20_near_neighbours",
    f"""WITH {VEC}, u AS (SELECT vec_id, list_transform(v, lambda z: z / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM v),
       d AS (SELECT a.vec_id AS query, b.vec_id, round(list_distance(a.u, b.u), 9) AS distance FROM u a, u b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id)
       SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS nth, vec_id, round(distance, 6) AS distance FROM d QUALIFY nth <= 5""",
)
def f20(t: Tables):
    return rounded(R.near_neighbours(vectors(t), vectors(t).where("vec_id % 20 = 0"), "vec_id", "v", 5), "distance")


TAGS = "SELECT l_suppkey, l_returnflag || l_linestatus AS tag, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2"
MAPPING = [("AF", "old"), ("RF", "old"), ("NF", "del"), ("NO", "new")]


def mapped(t: Tables):
    tags = t.lineitem.groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("tag")).agg(F.max("l_quantity").alias("weight"))
    return G.map_tags(tags, t.spark.createDataFrame(MAPPING, "fine string, coarse string"), "l_suppkey")


MAPPED = f"m AS (SELECT l_suppkey, c AS tag, max(weight) AS weight FROM (SELECT *, CASE tag WHEN 'AF' THEN 'old' WHEN 'RF' THEN 'old' WHEN 'NO' THEN 'new' END AS c FROM ({TAGS})) WHERE c IS NOT NULL GROUP BY 1, 2)"


@query("s1_tag_mapping", f"WITH {MAPPED} SELECT * FROM m")
def s1(t: Tables):
    return mapped(t)


@query("s2_tag_matrix", f"WITH {MAPPED} SELECT s_suppkey AS l_suppkey, [CAST(coalesce(max(weight) FILTER (tag = 'new'), 0) > 0 AS INT), CAST(coalesce(max(weight) FILTER (tag = 'old'), 0) > 0 AS INT)] AS labels, [coalesce(max(weight) FILTER (tag = 'new'), 0), coalesce(max(weight) FILTER (tag = 'old'), 0)] AS weights FROM supplier LEFT JOIN m ON m.l_suppkey = s_suppkey GROUP BY 1")
def s2(t: Tables):
    return G.tag_matrix(mapped(t), t.supplier.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", ["new", "old"])


KEYWORDS = {"the": ["then", "there"], "que": ["para"], "und": ["der", "die"]}
POINTS = {k: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {1.0 if len(w) > 3 else 0.5} ELSE 0 END" for w in dict.fromkeys([k, *v])) for k, v in KEYWORDS.items()}


@query("s3_keyword_scores", f"WITH p AS (SELECT doc_id, unnest(['the', 'que', 'und']) AS tag, CAST(unnest([{POINTS['the']}, {POINTS['que']}, {POINTS['und']}]) AS DOUBLE) AS p FROM documents) SELECT doc_id, tag, round(CASE WHEN max(p) OVER (PARTITION BY doc_id) > 0 THEN p / max(p) OVER (PARTITION BY doc_id) ELSE 0 END, 6) AS score FROM p")
def s3(t: Tables):
    return rounded(G.keyword_scores(t.documents, "doc_id", "text", KEYWORDS), "score")


@query("s4_blend_prior", "SELECT l_orderkey, l_linenumber, round(0.7 * l_discount + 0.3 * l_tax, 6) AS p FROM lineitem")
def s4(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(T.blend(F.col("l_discount"), F.col("l_tax"), 0.3), 6).alias("p"))


@query(
    "s5_pr_at_k",
    """WITH s AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS score, max(l_suppkey) % 3 = 0 AS truth FROM lineitem GROUP BY 1, 2),
       n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS n, count(*) FILTER (truth) OVER (PARTITION BY l_orderkey) AS k FROM s)
       SELECT l_orderkey, k, count(*) FILTER (truth AND n <= k) AS hits, round(count(*) FILTER (truth AND n <= k) / k, 6) AS value FROM n WHERE k > 0 GROUP BY 1, 2""",
)
def s5(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("score"), (F.max("l_suppkey") % 3 == 0).alias("truth"))
    return rounded(G.pr_at_k(rows, "l_orderkey", "l_linenumber", "score", "truth"), "value")


@query("s6_logit_sigmoid", "SELECT event_id, round(ln(greatest(least(value / 100, 0.9999), 0.0001) / (1 - greatest(least(value / 100, 0.9999), 0.0001))), 6) AS logit, round(1 / (1 + exp(-greatest(least(value, 50), -50))), 6) AS sigmoid FROM events")
def s6(t: Tables):
    return t.events.select("event_id", F.round(T.logit(F.col("value") / 100), 6).alias("logit"), F.round(T.sigmoid(F.col("value")), 6).alias("sigmoid"))


SCORE = "(p_size - 25) / 10.0"
BUCKETS = f"CASE WHEN {SCORE} <= -1.8 THEN 1 WHEN {SCORE} <= -0.6 THEN 2 WHEN {SCORE} < 0.6 THEN 3 WHEN {SCORE} < 1.8 THEN 4 ELSE 5 END"


@query("s7_score_bucket", f"SELECT p_partkey, {BUCKETS} AS score, ['very_low', 'low', 'medium', 'high', 'very_high'][{BUCKETS}] AS name FROM part")
def s7(t: Tables):
    score = F.expr("(p_size - 25) / 10.0D")
    return t.part.select("p_partkey", T.bucket_score(score).alias("score"), T.bucket_name(score).alias("name"))


TEMPLATES = {"a": ["The pace is {}.", "Pace: {}.", "Its tempo feels {}."], "b": ["Sound is {}.", "I call the sound {}."]}


def variant_number(salt: str) -> str:
    return f"CAST('0x' || substr(md5('9:' || p_partkey || ':' || variant || ':{salt}'), 1, 8) AS BIGINT)"


NAMES = "['very low', 'low', 'medium', 'high', 'very high']"
PART_SQL = {d: f"replace({TEMPLATES[d]!r}[{variant_number(d)} % {len(TEMPLATES[d])} + 1], '{{}}', {NAMES}[{BUCKETS if d == 'a' else '3'}])" for d in "ab"}


@query("s8_text_variants", f"SELECT p_partkey, variant, CASE WHEN {variant_number('order:a')} <= {variant_number('order:b')} THEN {PART_SQL['a']} || ' ' || {PART_SQL['b']} ELSE {PART_SQL['b']} || ' ' || {PART_SQL['a']} END AS text FROM part, (SELECT unnest([0, 1]) AS variant)")
def s8(t: Tables):
    rows = t.part.select("p_partkey", F.expr("(p_size - 25) / 10.0D").alias("a"), F.lit(0.0).alias("b"))
    return G.text_variants(rows, "p_partkey", ["a", "b"], TEMPLATES, 2, 9)


@query("s9_variant_discovery", "SELECT appid, variant, min(path) AS path FROM (SELECT CAST(user_id AS VARCHAR) AS appid, CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'positive' END AS variant, '/d/' || user_id || CASE event_id % 3 WHEN 0 THEN '_text_positive.txt' WHEN 1 THEN '_text.txt' ELSE '_text_postive.txt' END AS path FROM events) GROUP BY 1, 2")
def s9(t: Tables):
    path = F.expr("concat('/d/', user_id, CASE event_id % 3 WHEN 0 THEN '_text_positive.txt' WHEN 1 THEN '_text.txt' ELSE '_text_postive.txt' END)")
    return G.discover_variants(t.events.select(path.alias("path")), "path", {"positive": "positive", "postive": "positive", "text": "neutral"})


@query("s10_attribution", f"WITH {LONG}, i AS (SELECT label, vec_id, sum(abs(x * (1 + dim))) AS a, sum(x * (1 + dim)) AS s FROM x GROUP BY 1, 2) SELECT label, vec_id, round(a, 5) AS importance, round(s, 5) AS signed, round(a / max(a) OVER (PARTITION BY label), 6) AS share FROM i")
def s10(t: Tables):
    return rounded(rounded(G.attribution(vectors(t), "label", "vec_id", "v", [1.0 + d for d in range(64)]), "importance", "signed", digits=5), "share")


@query("s11_json_cells", "SELECT s_suppkey, '{\"a\":' || s_nationkey || ',\"b\":' || s_suppkey || '}' AS cells FROM supplier")
def s11(t: Tables):
    return t.supplier.select("s_suppkey", T.to_json_sorted(F.expr("map('b', s_suppkey, 'a', s_nationkey)")).alias("cells"))


POINTS_SQL = "SELECT CAST(floor((l_linenumber - 1) / 2) AS INT) AS cohort, l_orderkey * 10 + l_linenumber AS id, l_quantity / 5 AS x, l_discount * 100 AS y, l_extendedprice AS w FROM lineitem"


def points(t: Tables):
    return t.lineitem.select(
        F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("cohort"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_quantity") / 5).alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("w"))


BOX = (-1.0, 11.0, -1.0, 11.0)
KERNEL = f"k AS (SELECT unnest(range(-8, 9)) AS d, unnest([{', '.join(map(repr, flow.kernel(2.0)))}]::DOUBLE[]) AS w)"


@query(
    "h1_heat_grid",
    f"""WITH p AS ({POINTS_SQL}), {KERNEL}, b AS (SELECT cohort, CAST(least(greatest(floor((x + 1) / (12.0 / 31)), 0), 31) AS INT) AS ix, CAST(least(greatest(floor((y + 1) / (12.0 / 31)), 0), 31) AS INT) AS iy, sum(p.w) AS h FROM p GROUP BY 1, 2, 3),
       x AS (SELECT cohort, ix + d AS ix, iy, sum(h * w) AS h FROM b, k WHERE ix + d BETWEEN 0 AND 31 GROUP BY 1, 2, 3), y AS (SELECT cohort, ix, iy + d AS iy, sum(h * w) AS h FROM x, k WHERE iy + d BETWEEN 0 AND 31 GROUP BY 1, 2, 3)
       SELECT cohort, ix, iy, round(h / sum(h) OVER (PARTITION BY cohort), 9) AS heat FROM y""",
)
def h1(t: Tables):
    return rounded(flow.heat_grid(points(t), "cohort", 32, BOX, 2.0), "heat", digits=9)


@query("h2_center_of_mass", f"SELECT cohort, round(sum(w * x) / sum(w), 6) AS cx, round(sum(w * y) / sum(w), 6) AS cy FROM ({POINTS_SQL}) GROUP BY 1")
def h2(t: Tables):
    return rounded(flow.center_of_mass(points(t), "cohort"), "cx", "cy")


@query("h3_lanes")
def h3(t: Tables):
    return flow.assign_lanes(points(t), 4)


LANES = f"l AS (SELECT *, id % 3 AS lane FROM ({POINTS_SQL})), h AS (SELECT lane, cohort, sum(w) / sum(sum(w)) OVER (PARTITION BY cohort) AS heat FROM l GROUP BY 1, 2)"


@query("h4_lane_heat", f"WITH {LANES} SELECT lane, cohort, round(heat, 9) AS heat FROM h")
def h4(t: Tables):
    return rounded(flow.lane_heat(points(t).withColumn("lane", F.col("id") % 3), "cohort"), "heat", digits=9)


@query(
    "h3_lane_names",
    f"""WITH {LANES}, m AS (SELECT lane, sum(w * x) / sum(w) AS lx, sum(w * y) / sum(w) AS ly FROM l GROUP BY 1), c AS (SELECT cohort, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM l GROUP BY 1)
       SELECT lane, cohort AS name FROM m, c QUALIFY row_number() OVER (PARTITION BY lane ORDER BY round(pow(lx - cx, 2) + pow(ly - cy, 2), 9), cohort) = 1""",
)
def h3n(t: Tables):
    return flow.lane_names(points(t).withColumn("lane", F.col("id") % 3), "cohort")


@query("h5_lane_flow")
def h5l(t: Tables):
    return flow.lane_flow(flow.assign_lanes(points(t), 4), "cohort", 24, BOX)


@query("h5_transport")
def h5(t: Tables):
    return flow.transport(flow.cells_of(points(t), "cohort", 12, BOX), "cohort")


def moved(t: Tables):
    """A plan that SQL can repeat: each source cell sends halves to two fixed places."""
    cells = points(t).groupBy(F.col("cohort").cast("long").alias("step"), F.floor("x").alias("sx"), F.floor("y").alias("sy")).agg(F.sum("w").alias("mass"))
    both = cells.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return both.select("step", F.col("sx").cast("double"), F.col("sy").cast("double"), (F.col("sx") + F.col("k")).cast("double").alias("dx"), (F.col("sy") - F.col("k") / 2).alias("dy"), (F.col("mass") / 2).alias("mass"))


@query("h6_displacement_field", f"SELECT CAST(cohort AS BIGINT) AS step, floor(x) AS sx, floor(y) AS sy, 1.5 AS ux, -0.75 AS uy, round(sum(w), 2) AS mass FROM ({POINTS_SQL}) GROUP BY 1, 2, 3")
def h6(t: Tables):
    return rounded(rounded(flow.displacement(moved(t)), "ux", "uy"), "mass", digits=2)


@query("h6_flow_field")
def h6f(t: Tables):
    return flow.flow_field(flow.displacement(moved(t)), 24, BOX, 1.5)


@query(
    "h7_projected_density",
    f"""WITH {KERNEL}, c AS (SELECT CAST(cohort AS BIGINT) AS step, floor(x) AS sx, floor(y) AS sy, sum(w) / 2 AS m FROM ({POINTS_SQL}) GROUP BY 1, 2, 3), q AS (SELECT step, part, sx + part / 3 * j AS z, m FROM c, (SELECT unnest([1, 2]) AS j), (SELECT unnest([0, 1, 2]) AS part)),
       b AS (SELECT step, part, CAST(least(greatest(floor((z + 1) / (13.0 / 39)), 0), 39) AS INT) AS bin, sum(m) AS m FROM q GROUP BY 1, 2, 3), s AS (SELECT step, part, bin + d AS bin, sum(m * w) AS m FROM b, k WHERE bin + d BETWEEN 0 AND 39 GROUP BY 1, 2, 3)
       SELECT step, part, bin, round(m / sum(m) OVER (PARTITION BY step, part), 9) AS density FROM s""",
)
def h7(t: Tables):
    return rounded(flow.river(moved(t), (1.0, 0.0), 40, -1.0, 12.0, 3, 2.0), "density", digits=9)


@query("h8_stream_bands", f"WITH {LANES}, s AS (SELECT *, -(sum(heat) OVER (PARTITION BY cohort) + 0.012 * (count(*) OVER (PARTITION BY cohort) - 1)) / 2 + coalesce(sum(heat + 0.012) OVER (PARTITION BY cohort ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM h) SELECT cohort, lane, round(lo, 8) AS lo, round(lo + heat, 8) AS hi FROM s")
def h8(t: Tables):
    heat = flow.lane_heat(points(t).withColumn("lane", F.col("id") % 3), "cohort")
    return rounded(flow.bands(heat, "cohort", 0.012), "lo", "hi", digits=8)
