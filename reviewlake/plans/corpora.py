"""Queries over the corpus: offsets, shards, batches, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions.vectors import doubles
from reviewlake.operators import corpus
from reviewlake.plans import sql as S
from reviewlake.plans.registry import Tables, query

CORPUS = f"c AS (SELECT source AS appid, doc_id AS review_id, len({S.sentences('text')}) AS n_sentences FROM documents), r AS (SELECT * FROM c WHERE n_sentences > 0)"
RUNNING = 'sum(n_sentences) OVER (ORDER BY appid, review_id)'


def reviews(t: Tables):
    return corpus.sentence_counts(t.documents, "source", "doc_id", "text")


@query("c6_build_offsets", f'WITH {CORPUS} SELECT appid, review_id, n_sentences, CAST({RUNNING} - n_sentences AS BIGINT) AS start, CAST({RUNNING} AS BIGINT) AS "end" FROM r')
def c6(t: Tables):
    return corpus.with_offsets(reviews(t))


@query("c6_entity_offsets", f'WITH {CORPUS}, s AS (SELECT appid, count(*) AS n FROM r GROUP BY 1) SELECT appid, CAST(sum(n) OVER (ORDER BY appid) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY appid) AS BIGINT) AS "end" FROM s')
def c6e(t: Tables):
    return corpus.entity_offsets(reviews(t))


@query("c7_validate_corpus", 'SELECT unnest([\'length\', \'negative\', \'order\', \'overlap\', \'start\', \'total\']) AS "check", CAST(0 AS BIGINT) AS violations FROM (SELECT count(*) FROM documents)')
def c7(t: Tables):
    return corpus.validate_offsets(corpus.with_offsets(reviews(t)))


@query(
    "c7_validate_damaged",
    f"""WITH {CORPUS}, o AS (SELECT *, CAST({RUNNING} - n_sentences AS BIGINT) AS s, CAST({RUNNING} AS BIGINT) AS e FROM r),
       d AS (SELECT CASE WHEN review_id % 11 = 5 THEN -s WHEN review_id % 13 = 7 THEN 0 ELSE s + 1 END AS s, CASE WHEN review_id % 7 = 3 THEN e - 1 ELSE e + 1 END AS e, CASE WHEN review_id % 17 = 2 THEN 0 ELSE n_sentences END AS n FROM o)
       SELECT unnest(['length', 'negative', 'order', 'overlap', 'start', 'total']) AS "check", CAST(unnest([count(*) FILTER (e - s <> n), count(*) FILTER (s < 0 OR n < 1), count(*) FILTER (e < s), count(*) - count(DISTINCT s), CASE WHEN min(s) <> 0 THEN 1 ELSE 0 END, CASE WHEN max(e) <> sum(n) THEN 1 ELSE 0 END]) AS BIGINT) AS violations FROM d""",
)
def c7d(t: Tables):
    """Starts turned negative or to 0, ends short by one, and empty reviews, by review number."""
    start = F.expr("CASE WHEN review_id % 11 = 5 THEN -start WHEN review_id % 13 = 7 THEN 0 ELSE start + 1 END")
    end = F.expr("CASE WHEN review_id % 7 = 3 THEN end - 1 ELSE end + 1 END")
    n = F.expr("CASE WHEN review_id % 17 = 2 THEN 0 ELSE n_sentences END")
    return corpus.validate_offsets(corpus.with_offsets(reviews(t)).select("appid", "review_id", start.alias("start"), end.alias("end"), n.alias("n_sentences")))


@query("c8_corpus_counts", f"WITH {CORPUS} SELECT appid, count(*) AS reviews, CAST(sum(n_sentences) AS BIGINT) AS sentences FROM r GROUP BY 1")
def c8(t: Tables):
    return corpus.corpus_counts(reviews(t))


@query(
    "c9_prepend_metadata",
    """SELECT p_partkey, i - 1 AS review_id, 'meta' AS kind, [p_name, p_type, p_brand][i] AS text FROM part, range(1, 4) AS x(i)
       UNION ALL SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag || l_linestatus) + 2, 'review', l_returnflag || l_linestatus FROM lineitem""",
)
def c9(t: Tables):
    rows = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("flags"))
    return corpus.with_metadata(t.part, "p_partkey", ["p_name", "p_type", "p_brand"], rows, ["l_orderkey", "l_linenumber", "flags"], "flags")


SHARDS = 's AS (SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 400) AS BIGINT) AS shard, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders), p AS (SELECT shard, min(ordinal) AS start, max(ordinal) + 1 AS "end", count(*) AS rows FROM s GROUP BY 1)'


@query("c10_ordinal_shards", f'WITH {SHARDS} SELECT shard, start, "end", rows FROM p')
def c10(t: Tables):
    return corpus.plan_shards(t.orders, ["o_orderkey"], 400)


@query("c11_shard_audit", f"""WITH {SHARDS}, d AS (SELECT shard, start, "end", rows - CASE WHEN shard = 1 THEN 1 ELSE 0 END AS rows FROM p WHERE shard <> 2)
    SELECT shard, start, "end", rows, CASE WHEN shard <> row_number() OVER (ORDER BY shard) - 1 THEN 'id' WHEN start <> coalesce(lag("end") OVER (ORDER BY shard), 0) THEN 'range' WHEN rows <> "end" - start THEN 'rows' END AS problem FROM d""")
def c11(t: Tables):
    damaged = corpus.plan_shards(t.orders, ["o_orderkey"], 400).where("shard <> 2").withColumn("rows", F.col("rows") - F.when(F.col("shard") == 1, 1).otherwise(0))
    return corpus.audit_shards(damaged)


@query("c11_merge_shards", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def c11m(t: Tables):
    rows = corpus.with_ordinal(t.orders.select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.floor(F.col("ordinal") / 400).alias("shard"), (F.col("ordinal") % 400).alias("local"))
    return corpus.merge_shards(rows, corpus.plan_shards(t.orders, ["o_orderkey"], 400)).select("o_orderkey", "ordinal")


def walked(order: str, first: str, batch: str, state: str) -> str:
    """SQL that goes through each source's documents in an order, with a state carried from row to row."""
    return f"""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY {order}) AS k FROM documents),
        w AS (SELECT source, doc_id, n_chars, k, CAST(0 AS BIGINT) AS batch, {first} FROM d WHERE k = 1
          UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.k, CASE WHEN {batch} THEN w.batch + 1 ELSE w.batch END, {state}
          FROM w JOIN d ON d.source IS NOT DISTINCT FROM w.source AND d.k = w.k + 1)
        SELECT source, doc_id, n_chars, batch FROM w"""


FULL = "w.used + greatest(1, d.n_chars) > 20000 OR w.n >= 16"
ROOM = "least(16, greatest(1, 20000 // greatest(1, d.n_chars)))"


@query("c12_greedy_pack", walked("doc_id", "greatest(1, n_chars) AS used, 1 AS n", FULL, f"CASE WHEN {FULL} THEN greatest(1, d.n_chars) ELSE w.used + greatest(1, d.n_chars) END, CASE WHEN {FULL} THEN 1 ELSE w.n + 1 END"))
def c12(t: Tables):
    return corpus.greedy_pack(t.documents, "source", "doc_id", "n_chars", 20_000, 16)


@query("c13_token_pack", walked("n_chars DESC, doc_id", f"{ROOM} - 1 AS room", "w.room = 0", f"CASE WHEN w.room = 0 THEN {ROOM} ELSE w.room END - 1"))
def c13(t: Tables):
    return corpus.token_pack(t.documents, "source", "doc_id", "n_chars", 20_000, 16)


@query(
    "c14_balanced_buckets",
    """WITH RECURSIVE s AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1), d AS (SELECT *, row_number() OVER (ORDER BY size DESC, source) AS k FROM s),
       w AS (SELECT source, size, k, CAST(0 AS INT) AS bucket, [size, 0, 0, 0] AS t FROM d WHERE k = 1
         UNION ALL SELECT d.source, d.size, d.k, CAST(list_position(w.t, list_min(w.t)) - 1 AS INT),
           list_transform(range(1, 5), lambda i: w.t[i] + CASE WHEN i = list_position(w.t, list_min(w.t)) THEN d.size ELSE 0 END) FROM w JOIN d ON d.k = w.k + 1)
       SELECT source, size, bucket FROM w""",
)
def c14(t: Tables):
    return corpus.balanced_buckets(t.documents.groupBy("source").agg(F.sum("n_chars").alias("size")), "source", "size", 4)


@query("c15_build_sequences", "SELECT label, count(*) AS n, round(sum(v[1]), 6) AS firsts, arg_min(vec_id, vec_id) AS head FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) GROUP BY 1")
def c15(t: Tables):
    vectors = t.embeddings.select("label", "vec_id", F.struct("vec_id", doubles(F.col("embedding")).alias("v")).alias("v"))
    rows = corpus.build_sequences(vectors.select("label").distinct(), vectors, "label", "vec_id", "v")
    return rows.groupBy("label").agg((F.max("position") + 1).alias("n"), F.round(F.sum(F.col("vector.v")[0]), 6).alias("firsts"), F.min_by("vector.vec_id", "position").alias("head"))


@query("c15_sequence_errors", "SELECT p_partkey, 'no vectors' AS error FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT DISTINCT l_partkey, 'no target' FROM lineitem WHERE l_quantity > 40 AND l_partkey NOT IN (SELECT p_partkey FROM part)")
def c15e(t: Tables):
    return corpus.sequence_errors(t.part.select("p_partkey"), t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query(
    "c16_pad_sequences",
    """WITH s AS (SELECT l_orderkey, l_orderkey % 50 AS batch, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT l_orderkey, batch, max(n) OVER (PARTITION BY batch) AS padded, n AS real_ones FROM s""",
)
def c16(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.array("l_quantity", "l_discount")).alias("vectors")).withColumn("batch", F.col("l_orderkey") % 50)
    padded = corpus.pad_sequences(rows, "batch", "vectors", 2)
    total = F.aggregate("mask", F.lit(0), lambda s, x: s + x).cast("long")
    return padded.select("l_orderkey", "batch", F.size("vectors").cast("long").alias("padded"), total.alias("real_ones"))


@query("a6_resume_skip", "SELECT o_orderkey, md5(CAST(o_custkey AS VARCHAR)) AS hash FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < TIMESTAMP '1995-01-01' AND o_custkey % 3 <> 0)")
def a6(t: Tables):
    inputs = t.orders.select("o_orderkey", F.md5(F.col("o_custkey").cast("string")).alias("hash"))
    done = t.orders.where("o_custkey % 3 <> 0").join(t.lineitem.where("l_shipdate < timestamp '1995-01-01'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return corpus.pending(inputs, done.select("o_orderkey", F.md5(F.col("o_custkey").cast("string")).alias("hash")), ["o_orderkey", "hash"])
