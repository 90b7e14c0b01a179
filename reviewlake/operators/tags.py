"""Tag mapping, matrices, keyword scores, text variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def map_tags(tags: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """(key, tag, weight): fine tags to coarse by the mapping (fine, coarse), coarse ones as they are; `del` and unknown ones drop."""
    both = mapping.where("coarse <> 'del'")
    names = both.select("fine", "coarse").unionByName(both.select(F.col("coarse").alias("fine"), "coarse")).distinct()
    rows = tags.join(names.withColumnRenamed("fine", "tag"), "tag")
    return rows.groupBy(key, F.col("coarse").alias("tag")).agg(F.max("weight").alias("weight"))


def tag_matrix(tags: DataFrame, entities: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, labels, weights): multi-hot and weights of each entity in the order of names."""
    m = tags.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tag", "weight"))).alias("m"))
    rows = entities.select(key).distinct().join(m, key, "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,double>")))
    weights = F.transform(F.array(*map(F.lit, names)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0)))
    return rows.select(key, weights.alias("weights")).select(key, F.transform("weights", lambda w: (w > 0).cast("int")).alias("labels"), "weights")


def keyword_scores(texts: DataFrame, key: str, text: str, keywords: dict[str, list[str]]) -> DataFrame:
    """(key, tag, score): distinct keywords of a tag (and its name) in the text, 1 or 0.5 up to 3 letters, over the best tag's."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def points(tag: str) -> Column:
        words = dict.fromkeys(w.lower() for w in [tag, *keywords[tag]] if w)
        return sum((F.when(F.contains(low, F.lit(w)), 1.0 if len(w) > 3 else 0.5).otherwise(0.0) for w in words), F.lit(0.0))

    scores = F.array(*[F.struct(F.lit(t).alias("tag"), points(t).alias("score")) for t in sorted(keywords)])
    rows = texts.select(key, scores.alias("s")).withColumn("best", F.array_max(F.transform("s", lambda s: s["score"])))
    return rows.select(key, "best", F.explode("s").alias("s")).select(key, "s.tag", F.when(F.col("best") > 0, F.col("s.score") / F.col("best")).otherwise(0.0).alias("score"))


def pr_at_k(scores: DataFrame, key: str, tag: str, score: str, truth: str) -> DataFrame:
    """(key, k, hits, value): hits among the k best scores, k the number of true tags; precision and recall are equal there."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), tag))
    k = F.count_if(F.col(truth)).over(W.partitionBy(key))
    rows = scores.withColumn("_n", nth).withColumn("k", k).where("k > 0")
    return rows.groupBy(key, "k").agg(F.count_if(F.col(truth) & (F.col("_n") <= F.col("k"))).alias("hits")).withColumn("value", F.col("hits") / F.col("k"))


def attribution(sentences: DataFrame, entity: str, item: str, vec: str, coef: list[float]) -> DataFrame:
    """(entity, item, importance, signed, share) under a linear head: sums of |coef * x| and coef * x, over the entity's largest."""
    c = F.array(*[F.lit(float(x)) for x in coef])
    parts = F.zip_with(F.col(vec), c, lambda x, w: x * w)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = sentences.select(entity, item, add(F.transform(parts, F.abs)).alias("importance"), add(parts).alias("signed"))
    return rows.withColumn("share", F.col("importance") / F.max("importance").over(W.partitionBy(entity)))


def discover_variants(files: DataFrame, path: str, aliases: dict[str, str]) -> DataFrame:
    """(appid, variant, path) of <appid>_text[_<alias>].txt names; the first alias of a variant wins."""
    name = F.regexp_extract(path, r"([^/]+)\.txt$", 1)
    alias = F.coalesce(F.nullif(F.regexp_extract(name, r"^[^_]+_(?:text_)?([a-z]+)$", 1), F.lit("")), F.lit("text"))
    order = list(aliases)
    place = F.array_position(F.array(*map(F.lit, order)), alias)
    rows = files.select(F.substring_index(name, "_", 1).alias("appid"), place.alias("p"), F.col(path)).where("p > 0")
    names = F.element_at(F.array(*[F.lit(aliases[a]) for a in order]), F.col("p").cast("int"))
    return rows.groupBy("appid", names.alias("variant")).agg(F.min_by(path, F.struct("p", path)).alias(path))


def text_variants(rows: DataFrame, key: str, dims: list[str], templates: dict[str, list[str]], n: int, seed: int) -> DataFrame:
    """(key, variant, text): for each dimension a template of its bucket's name, chosen and ordered by md5."""
    from reviewlake.functions.text import bucket_name

    out = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    number = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("variant").cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
    parts = []
    for d in dims:
        options = F.array(*map(F.lit, templates[d]))
        chosen = F.element_at(options, (number(d) % len(templates[d]) + 1).cast("int"))
        parts.append(F.struct(number("order:" + d).alias("o"), F.replace(chosen, F.lit("{}"), F.replace(bucket_name(F.col(d)), F.lit("_"), F.lit(" "))).alias("s")))
    return out.select(key, "variant", F.array_join(F.transform(F.array_sort(F.array(*parts)), lambda x: x["s"]), " ").alias("text"))
