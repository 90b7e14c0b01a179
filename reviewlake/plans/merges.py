"""Queries over several sources of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import merging as M
from reviewlake.plans.registry import Tables, query


def three_sources(t: Tables):
    a = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_name").alias("name"))
    b = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_brand").alias("name"))
    c = t.part.select("p_partkey", F.col("p_type").alias("name"))
    return [a, b, c]


@query("d1_first_source_wins", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS name FROM part")
def d1(t: Tables):
    return M.merge_sources(three_sources(t), "p_partkey")


@query("d2_patch_merge", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_brand END AS release FROM part WHERE p_partkey % 4 <> 3 OR p_partkey % 2 = 1")
def d2(t: Tables):
    base = t.part.where("p_partkey % 4 <> 3").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END").alias("release"))
    patch = t.part.where("p_partkey % 2 = 1 OR p_partkey % 5 = 0").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_brand END").alias("release"))
    return M.patch_entities(base, patch, "p_partkey", ["release"])


@query("d3_complete_entities", "SELECT l_partkey AS appid, CASE WHEN l_partkey % 7 = 0 THEN 'unknown' ELSE p_name END AS name FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.05) JOIN part ON p_partkey = l_partkey")
def d3(t: Tables):
    known = t.part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("appid"), F.col("p_name").alias("name"))
    allowed = t.lineitem.where("l_discount > 0.05").select(F.col("l_partkey").alias("appid")).join(t.part.select(F.col("p_partkey").alias("appid")), "appid", "left_semi")
    return M.complete_entities(known, allowed, "appid", {"name": F.lit("unknown")})


@query(
    "d4_source_overlap",
    """WITH s AS (SELECT 0 AS prio, p_partkey FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 1, p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 2, p_partkey FROM part),
       m AS (SELECT *, min(prio) OVER (PARTITION BY p_partkey) AS f FROM s), g AS (SELECT prio, count(*) AS ids, count(*) FILTER (f = prio) AS new FROM m GROUP BY 1)
       SELECT prio, ids, new, ids - new AS duplicate, CAST(sum(new) OVER (ORDER BY prio) AS BIGINT) AS unique_so_far FROM g""",
)
def d4(t: Tables):
    return M.source_overlap(three_sources(t), "p_partkey")


@query(
    "d5_enrich_entities",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name WHEN s_suppkey % 3 <> 0 THEN n_name ELSE '' END AS name,
         CASE WHEN s_suppkey % 3 <> 0 THEN '{"base":1.0,"extra":' || CAST(s_nationkey AS DOUBLE) || '}' ELSE '{"base":1.0}' END AS tags
       FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def d5(t: Tables):
    from reviewlake.functions.text import to_json_sorted

    base = t.supplier.select("s_suppkey", F.expr("CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END").alias("name"), F.expr("map('base', 1.0D)").alias("tags"))
    details = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        "s_suppkey", (F.col("s_suppkey") % 3 != 0).alias("success"), F.col("n_name").alias("name"), F.expr("map('base', 9.0D, 'extra', CAST(s_nationkey AS DOUBLE))").alias("tags"))
    return M.enrich(base, details, "s_suppkey", ["name"], "tags").withColumn("tags", to_json_sorted(F.col("tags")))


@query(
    "d6_entity_metadata",
    """WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders GROUP BY 1),
       j AS (SELECT c_custkey, CASE WHEN p + n > 0 THEN p ELSE c_nationkey END AS positive, CASE WHEN p + n > 0 THEN n ELSE c_custkey % 3 END AS negative,
               CASE WHEN p + n > 0 THEN 'reviews' WHEN c_nationkey + c_custkey % 3 > 0 THEN 'record' ELSE 'none' END AS label_source FROM customer LEFT JOIN c ON o_custkey = c_custkey)
       SELECT c_custkey, positive, negative, CASE WHEN positive + negative > 0 THEN positive / (positive + negative) END AS rate, label_source FROM j""",
)
def d6(t: Tables):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("positive"), F.count_if(F.col("o_orderstatus") != "F").alias("negative"))
    record = t.customer.select("c_custkey", F.col("c_nationkey").alias("positive"), (F.col("c_custkey") % 3).alias("negative"))
    return M.entity_metadata(record, counts, "c_custkey")


@query(
    "d7_build_treebank",
    """SELECT l_orderkey * 10 + l_linenumber AS sentence_index, p_name AS sentence, CASE WHEN p.k IS NOT NULL THEN p.k / 10000 END AS score, ['train', 'test', 'dev'][1 + l_linenumber % 3] AS split
       FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT p_name AS phrase, max(p_partkey) AS k FROM part WHERE p_size > 10 GROUP BY 1) p ON p.phrase = p_name""",
)
def d7(t: Tables):
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sentence_index")
    lines = t.lineitem.groupBy(key, "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    sentences = lines.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("sentence_index", F.col("p_name").alias("sentence"))
    phrases = t.part.where("p_size > 10").select(F.col("p_name").alias("phrase"), F.col("p_partkey").alias("phrase_id"))
    scores = t.part.select(F.col("p_partkey").alias("phrase_id"), (F.col("p_partkey") / 10000).alias("score"))
    return M.build_treebank(sentences, phrases, scores, lines.select("sentence_index", (1 + F.col("l_linenumber") % 3).alias("split_code")))


@query(
    "d8_match_entities",
    """WITH a AS (SELECT min(n_nationkey) AS k, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM nation WHERE n_nationkey % 5 <> 0 GROUP BY 2),
       b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'land ' || s_nationkey END AS name, s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)
       SELECT a.k AS n_nationkey, min(s_suppkey) AS s_suppkey FROM b JOIN nation x ON x.n_nationkey = b.s_nationkey JOIN a ON a.n = trim(regexp_replace(lower(x.n_name), '[^a-z0-9]+', ' ', 'g')) GROUP BY 1""",
)
def d8(t: Tables):
    both = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    b = both.select("s_suppkey", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN upper(n_name) ELSE concat('Land-', s_nationkey) END").alias("name"))
    aliases = t.nation.select(F.concat(F.lit("land "), "n_nationkey").alias("alias"), F.col("n_name").alias("name"))
    return M.match_entities(t.nation.where("n_nationkey % 5 <> 0"), b, "n_nationkey", "n_name", "s_suppkey", "name", aliases)


@query("d9_match_pages")
def d9(t: Tables):
    titles = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    names = t.pages.select(F.col("page_id").alias("entity"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("name"))
    return M.match_pages(names, titles, "entity", "name", "page_id", "title", [r"\(video game\)"], ["soundtrack", "film"])


@query("d9_find_pages")
def d9f(t: Tables):
    part = lambda pattern: F.regexp_extract("html", pattern, 1)
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)", 1), "<[^>]*>", " "), r"\s+", " ")
    pages = t.pages.select("page_id", part("<title>([^<]*)</title>").alias("title"), body.alias("extract"))
    names = t.pages.select(F.col("page_id").alias("entity"), F.substring_index(part("<h1>([^<]*)</h1>"), ".", 1).alias("name"), part("<h1>([^<]*)</h1>").alias("alias"))
    terms = M.PageTerms(positive=("the", "und", "que", "les"), negative=("%%%", "***"), kinds=("on",), suffixes=("video game", "series"))
    return M.find_pages(names, pages, "entity", "name", "page_id", "title", "extract", terms, "alias", search_floor=4.0)


@query("d10_genre_catalog", "SELECT s_suppkey, s_name, coalesce((SELECT string_agg(g, '|' ORDER BY g) FROM (SELECT DISTINCT l_suppkey, l_returnflag AS g FROM lineitem WHERE l_quantity > 49) x WHERE x.l_suppkey = s_suppkey), '') AS genres FROM supplier")
def d10(t: Tables):
    bridge = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
    return M.genre_catalog(t.supplier.select("s_suppkey", "s_name"), bridge, "s_suppkey", "l_returnflag")


@query("d11_fan_out", "SELECT s.l_orderkey, s.l_linenumber, s.l_suppkey, b.genre FROM lineitem s LEFT JOIN (SELECT DISTINCT s_suppkey, s_nationkey % 3 AS genre FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 7 FROM supplier WHERE s_suppkey % 4 = 0) b ON b.s_suppkey = s.l_suppkey")
def d11(t: Tables):
    even = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 3).alias("genre"))
    bridge = even.unionByName(t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(7).cast("long").alias("genre")))
    return M.fan_out(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), bridge, "l_suppkey")


@query("d12_align", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT vec_id FROM embeddings)")
def d12(t: Tables):
    return M.align(t.documents.select("doc_id", "source"), t.labels, t.embeddings.select(F.col("vec_id").alias("doc_id")), key="doc_id")


@query("d13_variant_pairs", "SELECT a.user_id, a.event_type AS a, b.event_type AS b FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def d13(t: Tables):
    return M.variant_pairs(t.events, "user_id", "event_type")


@query("d14_dedupe_entities", "SELECT p_type, min(p_partkey) AS p_partkey, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS genres FROM part GROUP BY 1")
def d14(t: Tables):
    return M.dedupe_entities(t.part, "p_type", "p_partkey", "p_brand")


@query("d15_duplicate_flags", "SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS seen_before, count(*) OVER (PARTITION BY o_orderstatus) > 1 AS name_repeats, regexp_matches(o_orderstatus, '^[0-9]+$') AS numeric_name FROM orders")
def d15(t: Tables):
    return M.flag_duplicates(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("d16_set_check", "SELECT 'missing' AS side, c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'extra', o_custkey FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE TRUE)")
def d16(t: Tables):
    return M.set_check(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("m14_sync_column", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE n_name END AS name FROM nation JOIN region ON r_regionkey = n_regionkey")
def m14(t: Tables):
    old = t.nation.select("n_nationkey", F.expr("CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE n_name END").alias("name"))
    new = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.col("r_name").alias("name"))
    return M.sync_column(old, new, "n_nationkey", "name")
