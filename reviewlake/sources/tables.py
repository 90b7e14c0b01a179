"""Readers and writers of review tables, entity records, corpora, treebanks and reports."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Names under which a column may come, most wanted first.
CANDIDATES = {
    "appid": ["app_id", "appid", "app id", "game_id", "game id", "id"],
    "name": ["app_name", "app name", "game_name", "game name", "name", "title"],
    "review": ["review_text", "review text", "review", "text", "content"],
    "recommend": ["recommend", "recommended", "voted_up", "review_score", "review score", "sentiment", "score"],
    "helpfulness": ["review_votes", "review votes", "votes", "helpful", "helpfulness"],
    "user": ["user", "author", "username", "steamid", "steam_id"],
    "playtime": ["playtime", "hours", "playtime_forever", "author_playtime_forever"],
    "post_date": ["post_date", "date", "timestamp_created", "created_at", "posted"],
    "release_date": ["release_date", "release date", "release_time", "release time", "released", "release"],
}
REQUIRED = ("appid", "review")


def scan_reviews(spark: SparkSession, path: str, fmt: str | None = None, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text. The format follows the suffix; a folder is read whole. Zip archives are not read.

    In CSV an empty field is null and a quoted one is empty text; white space and control characters stay as they are.
    """
    name = path.lower().removesuffix(".gz")
    fmt = fmt or ("parquet" if name.endswith(".parquet") else "tsv" if name.endswith(".tsv") else "csv")
    if name.endswith(".zip"):
        raise ValueError("unpack zip archives first")
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    sep = sep or ("\t" if fmt == "tsv" else ",")
    # a null value that no text has: Spark takes equal texts for null, quoted or not; without the escape's escape, a NUL in quotes counts as one
    kept = {"nullValue": uuid.uuid4().hex, "charToEscapeQuoteEscaping": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=encoding, multiLine=True, escape='"', quote='"', **kept)


def infer_columns(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Logical to physical column names, compared by their letters a-z and digits. An override must exist; appid and review must be found."""
    norm = lambda c: re.sub("[^a-z0-9]", "", c.lower())
    there = {}
    for c in df.columns:
        there.setdefault(norm(c), c)
    found = {}
    for logical, names in CANDIDATES.items():
        if (o := (overrides or {}).get(logical)) is not None:
            if norm(o) not in there:
                raise ValueError(f"no column {o!r} for {logical}")
            found[logical] = there[norm(o)]
        elif hit := next((there[n] for n in map(norm, names) if n in there), None):
            found[logical] = hit
    if missing := [c for c in REQUIRED if c not in found]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return found


def with_logical_columns(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    found = infer_columns(df, overrides)
    return df.select(*[F.col(f"`{p}`").alias(c) for c, p in found.items()])


def scan_entities(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Rows of a JSON object keyed by id, record being the DDL of a value; values that aren't objects drop out.

    A file is one object and is read whole; for tables beyond some hundred MB use JSON lines and spark.read.json.
    """
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "json")).where(F.col("json").startswith("{"))
    return rows.select("key", F.from_json("json", record).alias("r")).where("r is not null").select("key", "r.*")


def write_reviews(df: DataFrame, path: str, buckets: int = 64, key: str = "appid") -> None:
    """Parquet in hash buckets of the entity, sorted inside, never a file an entity."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_corpus(games: DataFrame, reviews: DataFrame, sentences: DataFrame, path: str, version: str = "review_text.v1") -> None:
    """Three tables and a manifest row with version and counts."""
    for name, df in (("games", games), ("reviews", reviews), ("sentences", sentences)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = games.sparkSession
    counts = [spark.read.parquet(f"{path}/{n}").count() for n in ("games", "reviews", "sentences")]
    spark.createDataFrame([(version, *counts)], "version string, games long, reviews long, sentences long").write.mode("overwrite").parquet(f"{path}/manifest")


def read_corpus(spark: SparkSession, path: str, version: str = "review_text.v1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables; another version or a count that differs from the manifest raises ValueError."""
    m = spark.read.parquet(f"{path}/manifest").first()
    if m["version"] != version:
        raise ValueError(f"version {m['version']}, not {version}")
    tables = tuple(spark.read.parquet(f"{path}/{n}") for n in ("games", "reviews", "sentences"))
    if any(t.count() != m[n] for n, t in zip(("games", "reviews", "sentences"), tables)):
        raise ValueError("counts differ from the manifest")
    return tables


def scan_treebank(spark: SparkSession, path: str, columns: list[str], sep: str = "|", header: bool = False) -> DataFrame:
    """Pipe or tab file without quoting, columns in order."""
    return spark.read.csv(path, sep=sep, quote="", header=header, inferSchema=False).toDF(*columns)


def scan_lines(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """(row, columns) of a folder of text files whose lines belong together by number: row counts from 0 within each file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("row", "line"))
    parts = F.split("line", re.escape(sep), len(columns))
    return lines.select("row", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def scan_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested JSON reports with their file; a report that can't be read has status bad_json."""
    df = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    status = F.when(F.col("_bad").isNotNull(), "bad_json").otherwise("ok")
    return df.select(*[c for c in df.columns if c != "_bad"], F.input_file_name().alias("file"), status.alias("status"))


def scan_embedded(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(appid, review_id, sentence_id, text, vector) of nested review -> sentence_N -> {text, vector} files.

    Sentences without vector drop out; a vector of another length, or a file without any sentence, raises.
    """
    inner = "map<string,map<string,struct<sentence_text:string,vector:array<double>>>>"
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("file"), F.from_json("value", inner).alias("m"))
    files = files.withColumn("m", F.when(F.coalesce(F.size("m"), F.lit(0)) < 1, F.raise_error(F.concat(F.lit("no sentence in "), "file"))).otherwise(F.col("m")))
    rows = files.select(F.substring_index("file", "_", 1).alias("appid"), F.explode("m").alias("review_id", "s")).select("appid", F.col("review_id").cast("int"), F.explode("s").alias("name", "s"))
    rows = rows.where("s.vector is not null")
    vector = F.when(F.size("s.vector") != dim, F.raise_error(F.lit(f"a vector is not of length {dim}"))).otherwise(F.col("s.vector"))
    return rows.select("appid", "review_id", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("sentence_id"), F.col("s.sentence_text").alias("text"), vector.alias("vector"))


def export_table(dfs: list[DataFrame], path: str, fmt: str = "csv", preferred: list[str] = ()) -> None:
    """All frames in one file format with the union of their columns, preferred ones first."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    cols = [c for c in preferred if c in out.columns] + [c for c in out.columns if c not in preferred]
    writer = out.select(cols).write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if fmt == "csv" else writer.json(path)


def largest_table(folder: str) -> str:
    """The largest readable table file of a local folder."""
    names = [os.path.join(folder, n) for n in os.listdir(folder) if n.lower().endswith((".csv", ".csv.gz", ".tsv", ".parquet"))]
    if not names:
        raise FileNotFoundError(folder)
    return max(names, key=os.path.getsize)
