"""Filters and the review preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.text import clean_id, clean_text, to_recommend
from reviewlake.session import materialize

MIN_LENGTH, MIN_COUNT = 300, 500


def at_least(c: Column, n: int, strict: bool) -> Column:
    return c > n if strict else c >= n


def filter_length(df: DataFrame, col: str, n: int = MIN_LENGTH, strict: bool = True) -> DataFrame:
    """Rows whose cleaned text has more than n code points, or n and more."""
    return df.where(at_least(F.length(clean_text(F.col(col))), n, strict))


def filter_count(df: DataFrame, key: str, n: int = MIN_COUNT, strict: bool = True) -> DataFrame:
    """Rows of keys with more than n rows, or n and more. Counts are partial sums; the join is Spark's choice by size."""
    kept = df.groupBy(key).count().where(at_least(F.col("count"), n, strict)).select(key)
    return df.join(kept, key, "left_semi")


def prepare_reviews(
    df: DataFrame, entity: str, text: str, label: str | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, strict: bool = True
) -> DataFrame:
    """appid, review and recommend of long enough reviews of entities with enough of them; blank ids vanish.

    Texts are cleaned once: an exploded array of one, which the length filter empties, is worked out in one place, and the
    rows are written before their entities are counted.
    """
    label = to_recommend(F.col(label)) if label else F.lit("")
    review = F.explode(F.filter(F.array(clean_text(F.col(text))), lambda x: at_least(F.length(x), min_length, strict)))
    rows = df.select(clean_id(F.col(entity)).alias("appid"), review.alias("review"), label.alias("recommend")).where(F.col("appid") != "")
    return filter_count(materialize(rows, "prepared"), "appid", min_count, strict)


def skip_meta(df: DataFrame, col: str = "review_id", first: int = 3) -> DataFrame:
    """Without the metadata texts, which have the review ids below first."""
    n = F.col(col).try_cast("int")
    return df.where(n.isNull() | (n >= first))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def completeness(df: DataFrame, required: list[str], any_of: list[str]) -> DataFrame:
    """Each row with `complete`: all required columns and one of any_of are not blank."""
    ok = F.lit(True)
    for c in required:
        ok = ok & ~blank(F.col(c).cast("string"))
    some = F.lit(not any_of)
    for c in any_of:
        some = some | ~blank(F.col(c).cast("string"))
    return df.withColumn("complete", ok & some)


def completeness_report(prepared: DataFrame, enriched: DataFrame, key: str) -> DataFrame:
    """Prepared entities that are enriched, incomplete or missing; enriched has key and complete."""
    rows = prepared.select(key).distinct().join(enriched.select(key, "complete"), key, "left")
    return rows.agg(
        F.count("*").alias("prepared"), F.count_if(F.col("complete")).alias("complete"),
        F.count_if(~F.col("complete")).alias("incomplete"), F.count_if(F.col("complete").isNull()).alias("missing"),
    )
