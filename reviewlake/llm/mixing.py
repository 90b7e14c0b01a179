"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. The mix takes, of each source, all documents whose hash lies
below the source's threshold (once more than the others). The threshold is found without sorting documents: words
are summed by source and hash bucket, a running sum over at most 4096 buckets finds the bucket in which the budget
ends, and only that bucket is split further by the next 12 bits of the hash. The budgets of the first and the
second copy are nested: a document that is taken twice would also be taken once, and a larger budget never drops
a document that a smaller one takes.

Defined results: null text has size 0; a null source is a source of its own, sorted last; rows with the same doc_id
share a hash and are taken or left together; a null doc_id is hashed by its text; an empty table gives an empty
table; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewlake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP_BITS = 60, 12


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    """A hash in [0, 2**60) that any SQL engine with md5 repeats."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit("none"))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share=1.5, max_repeats=2) -> DataFrame:
    """(source, source_size) -> the same with target (double).

    The weights repeat over the sources in code point order, null last. `share` times all words is dealt by weight;
    a source takes at most max_repeats times its size, and what it can't take goes to the others by weight. Sources
    in order of size per weight fill up first, so one running sum finds the level at which the rest is shared.
    One row per source, which is the only table that a window without keys ever sees here.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    filled = (
        caps.withColumn("k", F.row_number().over(order))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_here", F.col("rest") / F.col("rest_weight"))
    )
    fits = F.col("level_here") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct("k", "level_here"))).over(everything)["level_here"]
    return (
        filled.withColumn("level", level)
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level"))))
        .select("source", "source_size", "target")
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of every document: all that finding thresholds needs."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h"))


def mix_thresholds(rows: DataFrame, weights=(3, 1, 2), share=1.5, max_repeats=2) -> DataFrame:
    """Rows of `sized` -> per source: source_size, target, whole copies that all get, and the hash below which one more is due."""
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = source_targets(sizes, weights, share, max_repeats).withColumn("copies", copies)
    open_ = materialize(
        targets.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")),
        "mix-targets",
    )
    plan, done, shift = open_.select("source", "source_size", "target", "copies"), None, HASH_BITS
    while shift > 0:
        shift -= STEP_BITS
        within = open_.select(F.col("source").alias("s"), "budget", "prefix")
        at = F.shiftright("h", shift)
        hist = (
            rows.join(within, rows["source"].eqNullSafe(within["s"]))
            .where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
            .groupBy("source", "budget", at.alias("b"))
            .agg(F.sum("size").alias("words"), F.min("h").alias("h_min"), F.max("h").alias("h_max"))
        )
        upto = F.sum("words").over(W.partitionBy("source").orderBy("b"))
        edge = (
            hist.withColumn("upto", upto)
            .where((F.col("budget") < F.col("upto")) & (F.col("budget") >= F.col("upto") - F.col("words")))
            .withColumn("budget", F.col("budget") - F.col("upto") + F.col("words"))
        )
        edge = materialize(edge, "mix-edge")
        single = (F.col("h_min") == F.col("h_max")) | F.lit(shift == 0)
        cut = F.col("h_min") + F.when(F.col("words") / 2 <= F.col("budget"), 1).otherwise(0)
        found = edge.where(single).select("source", cut.alias("threshold"))
        done = found if done is None else done.unionByName(found)
        open_ = edge.where(~single).select("source", "budget", F.col("b").alias("prefix"))
        if open_.isEmpty():
            break
    done = done.withColumnRenamed("source", "s")
    out = plan.join(done, plan["source"].eqNullSafe(done["s"]), "left").select(plan["*"], F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))
    return materialize(out, "mix-thresholds")


def apply_mix(rows: DataFrame, thresholds: DataFrame, h: Column, size: Column) -> DataFrame:
    """Add size, source_size, target, copies and taken to rows with a source; the thresholds have a row per source."""
    t = thresholds.select([F.col(c).alias(f"_mix_{c}") for c in thresholds.columns])
    copies = F.col("_mix_copies") + F.when(h < F.col("_mix_threshold"), 1).otherwise(0)
    # a join by = on a key made non-null: every source has a row here, so AQE may split a hot source's partition
    name = lambda c: F.concat(F.when(c.isNull(), "1").otherwise("0"), F.coalesce(c, F.lit("")))
    return rows.join(t, name(rows["source"]) == name(t["_mix_source"])).select(
        *[rows[c] for c in rows.columns if c not in ("size", "source_size", "target", "copies", "taken")],
        size.alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        copies.cast("int").alias("copies"), (size * copies).cast("long").alias("taken"),
    )


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share=1.5, max_repeats=2) -> DataFrame:
    """All columns of docs with size, source_size, target, copies and taken (words the mix takes, repeats counted)."""
    thresholds = mix_thresholds(materialize(sized(docs), "mix-sizes"), weights, share, max_repeats)
    return apply_mix(docs, thresholds, hash60(docs["doc_id"], docs["text"]), word_count(docs["text"]))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it."""
    return mix_sources(docs, **parameters).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def mix_report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target and taken; reads the texts once."""
    rows = materialize(sized(docs), "mix-sizes")
    return apply_mix(rows, mix_thresholds(rows, **parameters), rows["h"], rows["size"]).select("doc_id", "source", "size", "source_size", "target", "taken")


#: The result of mix_report for tables in DuckDB: sorts each source by hash where Spark splits buckets.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, 'none')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS k,
        1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
      FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
l AS (SELECT first(rest / rest_weight ORDER BY k) AS level FROM f WHERE rest / rest_weight * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM f, l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT d.doc_id, d.source, d.size, c.source_size, c.target,
  CAST(d.size * (c.copies + CASE WHEN r.before + r.words / 2 <= c.target - c.copies * c.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
"""
