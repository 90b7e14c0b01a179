"""Run logs followed with a state that forgets."""

import datetime as dt

from reviewlake.operators import runs
from reviewlake.streaming import jobs

SCHEMA = "run string, n long, ts timestamp, status string"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def write(spark, folder, n, rows):
    spark.createDataFrame([(r, k, DAY + dt.timedelta(days=d) if d is not None else None, s) for r, k, d, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def follow(spark, log, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{log}/*")
    return jobs.merge_available(jobs.follow_runs(stream, "run", "n", "ts", "2 days"), folder, "run", "n")


def test_old_runs_leave_the_state_and_stay_in_the_result(spark, tmp_path):
    log, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/follow"
    write(spark, log, 0, [("a", 1, 0, "running"), ("a", 2, 0.1, "done"), ("b", 1, 0, "running"), (None, 1, 0, "x"), ("c", None, 0, "x"), ("d", 1, None, "x")])
    first = {r["run"]: r["status"] for r in follow(spark, log, folder).collect()}
    assert first == {"a": "done", "b": "running"}
    write(spark, log, 1, [("b", 2, 1, "done"), ("b", 1, 0, "running"), ("e", 5, 1, "running")])
    assert {r["run"]: r["status"] for r in follow(spark, log, folder).collect()} == {"a": "done", "b": "done", "e": "running"}
    write(spark, log, 2, [("f", 1, 20, "running")])
    follow(spark, log, folder).count()
    write(spark, log, 3, [("g", 1, 21, "done"), ("b", 9, 1, "too late")])
    last = follow(spark, log, folder)
    assert {r["run"]: r["status"] for r in last.collect()} == {"a": "done", "b": "done", "e": "running", "f": "running", "g": "done"}
    held = {r["key"]["run"] for r in spark.read.format("statestore").load(f"{folder}/state").collect()}
    assert held == {"f", "g"}  # the others went when the watermark passed them
    batch = runs.latest_state(spark.read.schema(SCHEMA).parquet(f"{log}/*").where("n IS NOT NULL AND ts IS NOT NULL AND status <> 'too late'"), "run", "n", ["ts", "status"])
    assert sorted(map(tuple, batch.select("run", "status").collect())) == sorted(map(tuple, last.select("run", "status").collect()))


def test_no_files(spark, tmp_path):
    (tmp_path / "log" / "0").mkdir(parents=True)
    assert follow(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/follow").count() == 0
