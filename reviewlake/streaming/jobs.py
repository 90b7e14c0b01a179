"""Incremental jobs: run state from an append-only log, review counts from arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from reviewlake.operators.cleaning import MIN_LENGTH, at_least
from reviewlake.functions.text import clean_id, clean_text
from reviewlake.operators.runs import latest_state

LOG = "combo_id string, status string, config_hash string, attempts long, heartbeat string, ts string"


def read_log(spark: SparkSession, folder: str, schema: str = LOG) -> DataFrame:
    """Stream of a folder of JSON-lines files; torn lines have no combo_id and drop out."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder).where("combo_id is not null")


def stream_latest(log: DataFrame, key: str = "combo_id", seq: str = "ts", keep_days: int | None = None, now: str | None = None) -> DataFrame:
    """Current state of each run. keep_days leaves out records older than that; the state keeps every run seen (see follow_runs)."""
    if keep_days is not None:
        log = log.where(F.to_timestamp(seq) >= F.to_timestamp(F.lit(now) if now else F.current_timestamp()) - F.expr(f"interval {keep_days} days"))
    return latest_state(log, key, seq, [c for c in log.columns if c != key])


def stream_review_counts(reviews: DataFrame, entity: str, text: str, min_length: int = MIN_LENGTH, strict: bool = True) -> DataFrame:
    """Kept reviews of each entity so far: the preparation's filters over an unbounded table."""
    rows = reviews.select(clean_id(F.col(entity)).alias("appid"), clean_text(F.col(text)).alias("review"))
    return rows.where((F.col("appid") != "") & at_least(F.length("review"), min_length, strict)).groupBy("appid").agg(F.count("*").alias("kept"))


def run_available(df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Take all files that are there and give the result, with a checkpoint in place of resume files.

    Each batch writes the whole result as Parquet under the folder, which all machines share; the last one's is read.
    """
    last: list[str] = []

    def write(batch: DataFrame, n: int) -> None:
        last[:] = [f"{folder}/result-{n}"]
        batch.write.mode("overwrite").parquet(last[0])

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(*last) if last else spark.createDataFrame([], df.schema)


def follow_runs(log: DataFrame, key: str, seq: str, time: str, keep: str) -> DataFrame:
    """Stream of changes of each run's last record by seq, for update mode, with a state that forgets.

    The event time `time` has a watermark of `keep`. A run's state is dropped when the watermark passes its last record by
    `keep`, and records older than the watermark are left out, so the state holds the runs of about two such spans and
    no more. Changes already given stay true: what is left out is older than what was given. Rows without key, seq or time
    are left out. One record a run and trigger comes out, and none that is no later than the state's.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    spark, cols = log.sparkSession, [c for c in log.columns if c != key]
    rows = log.where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, keep)
    span = spark.range(1).select(((F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {keep}")).cast("double") * 1000).cast("long")).first()[0]
    schema = rows.schema
    kept = StructType([f for f in schema.fields if f.name == seq])

    def latest(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for pdf in frames:
            row = pdf.loc[[pdf[seq].idxmax()]]
            best = row if best is None or row[seq].iloc[0] > best[seq].iloc[0] else best
        at, last = best[seq].iloc[0], state.get[0] if state.exists else None
        now = int(best[time].iloc[0].timestamp() * 1000)
        if last is None or at > last:
            state.update((at.item() if hasattr(at, "item") else at,))
            yield best[[key, *cols]]
        state.setTimeoutTimestamp(max(now + span, state.getCurrentWatermarkMs() + 1))

    out = StructType([schema[key], *[schema[c] for c in cols]])
    return rows.groupBy(key).applyInPandasWithState(latest, out, kept, "update", GroupStateTimeout.EventTimeTimeout)


def merge_available(changes: DataFrame, folder: str, key: str, seq: str) -> DataFrame:
    """Take all files that are there, add each batch's changes to the folder, and give the last one of each key.

    A batch writes its changes only, under its number, so a batch that runs again replaces its own; runs before this one, with the
    same folder, are part of the result.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    query = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = changes.sparkSession
    rows = spark.read.schema(changes.schema).parquet(f"{folder}/changes") if _has_changes(spark, folder) else spark.createDataFrame([], changes.schema)
    return latest_state(rows, key, seq, [c for c in changes.columns if c != key])


def _has_changes(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
