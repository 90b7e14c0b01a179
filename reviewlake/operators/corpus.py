"""The three-level corpus: entities, reviews, sentences; ordinals and offsets, shards, batches, sequences."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window as W, functions as F

from reviewlake.functions.text import clean_text
from reviewlake.operators.chains import visited
from reviewlake.operators.splitting import sentence_array, sentence_count
from reviewlake.session import materialize, ship


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal", weight: str | None = None) -> DataFrame:
    """Number rows from 0 in a total order; with weight, the running sum of weight before each row instead.

    Rows are dealt by range, each range is summed, and the sums of the ranges before (a row a partition) are added to
    a running sum inside each range: no task sees more than a range.
    """
    return with_running(df, order, {name: weight})


def with_running(df: DataFrame, order: list, sums: dict[str, str | None]) -> DataFrame:
    """Several such numbers at once: name -> column to add up, or None to count rows. order may hold expressions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordinal")
    one = {k: F.coalesce(F.col(w), F.lit(0)).cast("long") if w else F.lit(1).cast("long") for k, w in sums.items()}
    total = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in one.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = total.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_ahead_{k}") for k in one])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = {k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in one.items()}
    return parts.join(ahead, "_part").select(*df.columns, *[(F.col(f"_ahead_{k}") + c).alias(k) for k, c in local.items()])


def build_corpus(docs: DataFrame, entity: str, review: str, text: str) -> DataFrame:
    """(appid, review_id, n_sentences, sentences) of reviews with at least one sentence."""
    rows = docs.select(F.col(entity).alias("appid"), F.col(review).alias("review_id"), sentence_array(F.col(text)).alias("sentences"))
    return rows.withColumn("n_sentences", F.size("sentences")).where("n_sentences > 0")


def sentence_counts(docs: DataFrame, entity: str, review: str, text: str) -> DataFrame:
    """(appid, review_id, n_sentences) of reviews with at least one sentence: one pass over the texts, written as narrow rows."""
    rows = docs.select(F.col(entity).alias("appid"), F.col(review).alias("review_id"), sentence_count(F.col(text)).alias("n_sentences"))
    return materialize(rows, "sentence-counts").where("n_sentences > 0")


def with_offsets(reviews: DataFrame) -> DataFrame:
    """Add start and end: the range of a review's sentences in the whole corpus by (appid, review_id)."""
    rows = with_ordinal(reviews, ["appid", "review_id"], "start", "n_sentences")
    return rows.withColumn("end", F.col("start") + F.col("n_sentences"))


def entity_offsets(reviews: DataFrame) -> DataFrame:
    """(appid, start, end): the range of an entity's reviews."""
    sizes = reviews.groupBy("appid").agg(F.count("*").alias("n"))
    return with_ordinal(sizes, ["appid"], "start", "n").select("appid", "start", (F.col("start") + F.col("n")).alias("end"))


def validate_offsets(reviews: DataFrame, key: list[str] = ["appid", "review_id"]) -> DataFrame:
    """(check, violations) of a table with start, end and n_sentences, one row a check."""
    total = reviews.agg(F.sum("n_sentences").alias("total"))
    flags = {
        "length": F.col("end") - F.col("start") != F.col("n_sentences"),
        "negative": (F.col("start") < 0) | (F.col("n_sentences") < 1),
        "order": F.col("end") < F.col("start"),
    }
    out = reviews.agg(*[F.count_if(c).alias(k) for k, c in flags.items()], F.min("start").alias("first"), F.max("end").alias("last"), F.sum("n_sentences").alias("total"), (F.count("*") - F.countDistinct("start")).alias("overlap"))
    out = out.withColumn("start", (F.col("first") != 0).cast("long")).withColumn("total", (F.col("last") != F.col("total")).cast("long"))
    names = ["length", "negative", "order", "overlap", "start", "total"]
    return out.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("violations")) for n in names])).alias("x")).select("x.*")


def corpus_counts(reviews: DataFrame) -> DataFrame:
    """Reviews and sentences by entity."""
    return reviews.groupBy("appid").agg(F.count("*").alias("reviews"), F.sum("n_sentences").alias("sentences"))


def with_metadata(entities: DataFrame, key: str, texts: list[str], reviews: DataFrame, order: list[str], text: str) -> DataFrame:
    """(key, review_id, kind, text): each entity's metadata texts as reviews 0, 1, ..., then its reviews in order."""
    meta = entities.select(key, F.posexplode(F.array(*[clean_text(F.col(c)) for c in texts])).alias("review_id", "text"))
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order)) + len(texts) - 1
    body = reviews.select(key, nth.alias("review_id"), F.col(text).alias("text"))
    return meta.withColumn("kind", F.lit("meta")).unionByName(body.withColumn("kind", F.lit("review")))


def plan_shards(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """(shard, start, end, rows): [0, n) in ranges of size."""
    rows = with_ordinal(df.select(*order), order)
    return rows.groupBy(F.floor(F.col("ordinal") / size).alias("shard")).agg(F.min("ordinal").alias("start"), (F.max("ordinal") + 1).alias("end"), F.count("*").alias("rows"))


def audit_shards(shards: DataFrame) -> DataFrame:
    """Shards with `problem`: ids not continuous from 0, ranges not adjacent, or rows other than the range; null when sound.

    One row per shard, so the one window without keys is over a small table.
    """
    w = W.orderBy("shard")
    problem = (
        F.when(F.col("shard") != F.row_number().over(w) - 1, "id")
        .when(F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0)), "range")
        .when(F.col("rows") != F.col("end") - F.col("start"), "rows")
    )
    return shards.withColumn("problem", problem)


def merge_shards(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows of (shard, local, ...) with `ordinal` in the merged order."""
    return rows.join(shards.select("shard", "start"), "shard").withColumn("ordinal", F.col("start") + F.col("local")).drop("start")


def _batched(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """columns and batch, from rows with `place` (their number over all keys) and `next` (the place where the next batch would begin).

    A batch ends with its key at the latest, so one walk over all keys visits the first row of each.
    """
    ends = rows.groupBy(key).agg((F.max("place") + 1).alias("_end"), F.min("place").alias("_first"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    rows = rows.join(ends.select(F.col(key).alias("_key"), "_end", "_first"), same)
    found = visited(rows.select(*columns, "place", "_first", F.least("next", "_end").alias("next")))
    # batches begun before a row, over all keys; less those before its key's first row
    counted = materialize(with_running(found.withColumn("_start", F.col("start").cast("long")), ["place"], {"_begun": "_start"}), "batches")
    base = counted.where(F.col("place") == F.col("_first")).select("_first", F.col("_begun").alias("_base"))
    return counted.join(base, "_first").select(*columns, (F.col("_begun") + F.col("_start") - F.col("_base") - 1).alias("batch"))


def greedy_pack(df: DataFrame, key: str, item: str, cost: str, budget: int, max_items: int = 2**31) -> DataFrame:
    """(key, item, cost, batch): in order of item, a new batch when the budget or max_items would be passed.

    A row costs 1 at least; one above the budget is a batch of its own. With running sums over all rows, the place
    where the batch after one begun at a row begins is the number of rows whose sums stay within that row's and the
    budget. Which rows do begin a batch is found by doubling (`chains`), so no task sees a whole key.
    """
    rows = df.select(key, item, F.col(cost).cast("long").alias(cost)).withColumn("_c", F.greatest(F.lit(1).cast("long"), F.coalesce(F.col(cost), F.lit(1))))
    rows = materialize(with_running(rows, [key, item, cost], {"place": None, "_before": "_c"}), "pack-rows")
    ends = rows.select((F.col("_before") + F.col("_c")).alias("sum"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("place"))
    asks = rows.select((F.col("_before") + budget).alias("sum"), F.lit(1).alias("asks"), "place")
    merged = with_running(ends.unionByName(asks).withColumn("_is_end", 1 - F.col("asks")), ["sum", "asks", "place"], {"_ended": "_is_end"})
    after = merged.where("asks = 1").select("place", "_ended")
    nxt = F.least(F.greatest(F.col("_ended"), F.col("place") + 1), F.col("place") + max_items)
    return _batched(rows.join(after, "place").withColumn("next", nxt), key, [key, item, cost])


def token_pack(df: DataFrame, key: str, item: str, length: str, budget: int, max_batch: int) -> DataFrame:
    """(key, item, length, batch): longest first, batches of min(max_batch, budget // longest) items, found like those of greedy_pack."""
    rows = df.select(key, item, F.col(length).cast("long").alias(length))
    rows = materialize(with_running(rows, [F.col(key), F.desc(length), F.col(item)], {"place": None}), "pack-rows")
    longest = F.greatest(F.lit(1).cast("long"), F.coalesce(F.col(length), F.lit(1)))
    room = F.greatest(F.lit(1).cast("long"), F.least(F.lit(max_batch).cast("long"), F.floor(F.lit(budget).cast("long") / longest)))
    return _batched(rows.withColumn("next", F.col("place") + room), key, [key, item, length])


def balanced_buckets(sizes: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """(key, size, bucket): largest first to the smallest bucket. sizes has a row per entity; the walk holds n numbers."""
    ship(sizes.sparkSession)

    def run(batches):
        heap = [(0, k) for k in range(n)]
        for pdf in batches:
            out = []
            for s in pdf[size]:
                total, k = heapq.heappop(heap)
                heapq.heappush(heap, (total + int(s), k))
                out.append(k)
            yield pdf.assign(bucket=out)

    rows = sizes.select(F.col(key), F.col(size).cast("long").alias(size))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", bucket int"
    return rows.repartition(1).sortWithinPartitions(F.desc(size), F.col(key)).mapInPandas(run, schema)


def build_sequences(targets: DataFrame, vectors: DataFrame, key: str, order: str, vec: str) -> DataFrame:
    """(key, position, vector): the vectors of each target in order, from position 0. No key's vectors meet in one row or task."""
    rows = with_ordinal(vectors.join(targets.select(key), key, "left_semi").select(key, order, F.col(vec).alias("vector")), [key, order], "_at")
    first = rows.groupBy(key).agg(F.min("_at").alias("_first"))
    return rows.join(first, key).select(key, (F.col("_at") - F.col("_first")).alias("position"), "vector")


def sequence_errors(targets: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, error) of targets without vectors and vectors without target."""
    a = targets.select(key).distinct().join(vectors, key, "left_anti").withColumn("error", F.lit("no vectors"))
    b = vectors.select(key).distinct().join(targets, key, "left_anti").withColumn("error", F.lit("no target"))
    return a.unionByName(b)


def pad_sequences(df: DataFrame, batch: str, vectors: str, dim: int) -> DataFrame:
    """Pad vectors to the longest of the batch with zeros; mask is 1 for real ones."""
    longest = df.groupBy(batch).agg(F.max(F.size(vectors)).alias("_longest"))
    rows = df.join(longest, batch)
    zero = F.array_repeat(F.lit(0.0), dim)
    n = F.size(vectors)
    padded = F.concat(F.col(vectors), F.array_repeat(zero, F.col("_longest") - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("_longest") - n))
    return rows.withColumn("mask", mask).withColumn(vectors, padded).drop("_longest")


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose key and content are not done yet."""
    return inputs.join(done.select(keys).distinct(), keys, "left_anti")
