"""Experiment grids and run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

METRICS = ("composite_score", "tag_micro_f1", "sentiment_r2", "recommendation_pearson", "hit_at_5", "pr", "mean_text_cosine")


def expand_grid(spark: SparkSession, dims: dict[str, list | DataFrame], exclude: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Every combination of the values with its combo_id; rows of exclude (any of the columns) take theirs out.

    Values are a list, or the distinct rows of a frame that has the dimension's column. The grid is what is asked for, so the
    frames are crossed; all their rows count.
    """
    lists = {k: vs for k, vs in dims.items() if not isinstance(vs, DataFrame)}
    grid = spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(k) for k, vs in lists.items()])
    grid = reduce(lambda df, k: df.withColumn(k, F.explode(k)), lists, grid)
    grid = reduce(lambda df, k: df.crossJoin(dims[k].select(k).distinct()), [k for k in dims if k not in lists], grid).select(*dims)
    if exclude is not None:
        number = lambda c: isinstance(grid.schema[c].dataType, NumericType)
        same = lambda c: F.abs(grid[c].cast("double") - exclude[c].cast("double")) < tolerance if number(c) else grid[c] == exclude[c]
        grid = grid.join(exclude, reduce(lambda a, b: a & b, map(same, exclude.columns)), "left_anti")
    return grid.withColumn("combo_id", F.concat_ws("_", *[F.concat(F.lit(k[:1]), F.col(k).cast("string")) for k in dims]))


def config_hash(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add config_hash: 16 hex digits over the columns in order of name."""
    return df.withColumn("config_hash", F.substring(F.sha1(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(cols)])), 1, 16))


def latest_state(log: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """Last record of each run by seq."""
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("s"))
    return last.select(key, "s.*")


def classify_runs(grid: DataFrame, manifests: DataFrame, reports: DataFrame, key: str = "combo_id", config: str = "config_hash") -> DataFrame:
    """Add status: missing, stale, trained without evaluation, or done."""
    m = manifests.select(key, F.col(config).alias("_m"))
    r = reports.select(key, F.lit(True).alias("_r")).distinct()
    status = F.when(F.col("_m").isNull(), "missing").when(F.col("_m") != F.col(config), "stale").when(F.col("_r").isNull(), "trained_no_eval").otherwise("done")
    return grid.join(m, key, "left").join(r, key, "left").withColumn("status", status).drop("_m", "_r")


def explode_reports(reports: DataFrame, key: str, array: str) -> DataFrame:
    """(key, position, fields) of a nested array of structs."""
    return reports.select(key, F.posexplode(array).alias("position", "x")).select(key, "position", "x.*")


def composite_score(df: DataFrame) -> Column:
    """Weighted score of a run; null where a part is missing. The weights are fixed values."""
    return (
        0.30 * F.col("tag_micro_f1") + 0.30 * F.col("hit_at_5") + 0.15 * (F.col("mean_text_cosine") + 1) / 2
        + 0.15 * F.when(F.col("pr").isNotNull(), F.least(F.col("pr") / 25, F.lit(1.0)))
        - 0.05 * F.when(F.col("sentiment_r2").isNotNull(), F.greatest(F.col("sentiment_r2"), F.lit(0.0))) - 0.05 * F.abs("recommendation_pearson")
    )


def arm_deltas(rows: DataFrame, keys: list[str], arm: str, treated, control, metrics: list[str], absolute: list[str] = ()) -> DataFrame:
    """Treated less control of each metric in cells that have both; `absolute` ones by their absolute values."""
    v = lambda c: F.abs(c) if c in absolute else F.col(c)
    side = lambda name, p: rows.where(F.col(arm) == name).select(*keys, *[v(m).alias(f"{p}{m}") for m in metrics])
    both = side(treated, "t_").join(side(control, "c_"), keys)
    return both.select(*keys, *[(F.col(f"t_{m}") - F.col(f"c_{m}")).alias(f"delta_{m}") for m in metrics])


def best_run(rows: DataFrame, key: str, loss: str) -> DataFrame:
    """The done run with the smallest loss; a missing loss is infinite, the key settles ties."""
    return rows.where(F.col("status") == "done").orderBy(F.coalesce(F.col(loss), F.lit(float("inf"))), key).limit(1)


def merge_history(history: DataFrame, rows: DataFrame, epoch: str) -> DataFrame:
    """History with the epochs of rows replaced or added."""
    return history.join(rows.select(epoch), epoch, "left_anti").unionByName(rows)


def prune_report(grid: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Grid rows that some rule prunes, with the reasons."""
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return grid.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def grid_shard(grid: DataFrame, order: list[str], i: int, n: int) -> DataFrame:
    """Rows whose ordinal is i modulo n."""
    from reviewlake.operators.corpus import with_ordinal

    return with_ordinal(grid, order, "_at").where(F.col("_at") % n == i).drop("_at")
