"""Session settings, and intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
CHECKPOINT = "spark.checkpoint.dir"
FEW_SPLITS = 16


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies at the same path as on the driver.

    A cluster that installs the package on its machines needs nothing of this. Batches sent to Python are kept
    to 1000 rows, because a few texts are thousands of times longer than the median; Spark bounds their bytes too.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a new local one if all runs on this machine, else an error."""
    where = spark.conf.get(CHECKPOINT, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT} to a folder that all machines share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-reviewlake-')}"
        spark.conf.set(CHECKPOINT, where)
    return where.rstrip("/")


def spread(table: DataFrame) -> DataFrame:
    """A table as read, or dealt over all cores where its files give only a few splits.

    That happens to small tables, whose rows often lie in one row group: text work on them would be one task. Larger
    tables are not shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() <= min(cores, FEW_SPLITS) else table


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, replaces: DataFrame | None = None) -> DataFrame:
    """Write a frame as Parquet under the shared folder and read it back.

    Cuts the lineage like a checkpoint does, survives lost executors, and keeps column pruning and real size
    statistics, so that Spark broadcasts the small ones by itself. The tables stay until the folder is cleared, but for
    `replaces`: a table of this function that nothing reads any more once the new one is written, as in a loop.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reviewlake/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if replaces is not None and (old := getattr(replaces, "_written_to", None)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out
