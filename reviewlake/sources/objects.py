"""Large JSON objects keyed by id, read by many tasks: a file is cut at closing braces, wherever splits fall.

Spark's text reader cuts a file at a separator in parallel, by any splits; here that is `}`. Whether a brace belongs to a string,
and how deep it stands, depends on all text before it, but only through two running sums: unescaped quotes (their number
is odd inside a string) and opened less closed brackets outside strings. Where a record of the top level closes, its pieces
are put together. No task sees more than a range of pieces, or one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.operators.corpus import with_running
from reviewlake.session import materialize


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, json) of the entries of each file's top-level object; json is null for a null. Files are well-formed objects."""
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    pieces = materialize(pieces.withColumn("quotes", count(plain, '"')), "object-pieces")
    pieces = materialize(with_running(pieces, ["file", "split", "id"], {"at": None, "before": "quotes"}), "object-pieces")

    first = pieces.groupBy("file").agg(F.min("before").alias("first"))  # a file's own quotes, whatever other files hold
    inside = (F.col("before") - F.col("first")) % 2
    text = F.regexp_replace(F.concat(F.when(inside == 1, '"').otherwise(""), plain), '"[^"]*("|$)', "")
    shut = ((F.col("before") - F.col("first") + F.col("quotes")) % 2 == 0).cast("int")  # the brace after the piece is no part of a string
    depth = count(text, "{") + count(text, "[") - count(text, "]") - shut
    narrow = pieces.join(first, "file").select("at", "file", depth.cast("long").alias("turn"), shut.alias("shut"))
    narrow = with_running(narrow, ["at"], {"deep": "turn"})
    start = narrow.groupBy("file").agg(F.min_by("deep", "at").alias("start"))
    level = F.col("deep") - F.col("start") + F.col("turn")
    ends = narrow.join(start, "file").select("at", level.alias("level"), ((F.col("shut") == 1) & (level <= 1)).cast("long").alias("ends"))
    records = with_running(ends, ["at"], {"record": "ends"})

    rows = records.join(pieces.select("at", "file", "value"), "at")
    # the brace that closes the file's object is left off
    part = F.struct("at", F.concat("value", F.when((F.col("level") <= 0) & (F.col("ends") == 1), "").otherwise("}")).alias("v"))
    whole = rows.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["v"]), "").alias("v"))
    entry = F.concat(F.lit("{"), F.regexp_replace("v", r"^\s*[{,]", ""), F.lit("}"))
    return whole.select("file", F.explode(F.from_json(entry, "map<string,string>")).alias("key", "json"))


def scan_large_entities(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Rows of JSON objects keyed by id, record being the DDL of a value; values that aren't objects drop out. As scan_entities, for files of any size."""
    rows = object_entries(spark, path).where(F.col("json").startswith("{"))
    return rows.select("key", F.from_json("json", record).alias("r")).where("r is not null").select("key", "r.*")
