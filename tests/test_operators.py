"""Operators without an oracle in SQL: invariants and plain-Python twins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import aggregates, corpus, flow, merging, probes, ranking, runs
from reviewlake.sources import tables
from reviewlake.streaming import jobs


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    y = 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 3])))
    rows = [(i, [float(z) for z in v], float(t), int(i % 4)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, v array<double>, y double, label int"), x, y


def test_greedy_and_token_pack(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 60)) for k in "ab" for i in range(50)] + [("a", 99, 500)]
    df = spark.createDataFrame(rows, "k string, i int, c int")
    got = corpus.greedy_pack(df, "k", "i", "c", 100, 5).collect()
    for k in "ab":
        batch, used, n = 0, 0, 0
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["i"]):
            c = max(1, r["c"])
            if n and (used + c > 100 or n >= 5):
                batch, used, n = batch + 1, 0, 0
            used, n = used + c, n + 1
            assert r["batch"] == batch
    packs = {}
    for r in corpus.token_pack(df, "k", "i", "c", 100, 4).collect():
        packs.setdefault((r["k"], r["batch"]), []).append(r["c"])
    assert all(len(x) == 1 or len(x) <= 4 and len(x) * max(x) <= 100 for x in packs.values())


def test_balanced_buckets(spark):
    df = spark.createDataFrame([(i, 100 - i) for i in range(30)], "k int, n int")
    total = {}
    for r in corpus.balanced_buckets(df, "k", "n", 4).collect():
        total[r["bucket"]] = total.get(r["bucket"], 0) + r["n"]
    assert max(total.values()) - min(total.values()) <= 100


def test_ordinals_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"))
    assert all(r["k"] == r["ordinal"] for r in corpus.with_ordinal(df, ["k"]).collect())


def test_folds_and_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    sizes = [r["count"] for r in ranking.with_fold(df, "k", 5, 1).groupBy("fold").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1
    assert {r["split"]: r["count"] for r in ranking.split3(df, "k").groupBy("split").count().collect()} == {"train": 72, "val": 15, "test": 16}
    with pytest.raises(ValueError):
        ranking.anchored_subset(df, "k", [1000], 5, 1)


def test_samples_take_the_ceiling(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 7), ("b", 1)) for i in range(n)], "k string, i int")
    got = {(r["view"], r["k"]): r["count"] for r in ranking.sample_views(df, "k", "i", 0.3, 2, 1).groupBy("view", "k").count().collect()}
    assert got == {(v, k): math.ceil(n * 0.3) for v in (0, 1) for k, n in (("a", 7), ("b", 1))}


def test_separated_points(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(0, 5), rng.uniform(0, 5), rng.random()) for i in range(80)]
    got = {r["k"] for r in ranking.separated_top(spark.createDataFrame(pts, "k long, x double, y double, w double"), "k", "x", "y", "w", 1.0, 10).collect()}
    kept = []
    for p in sorted(pts, key=lambda p: -p[3]):
        if len(kept) < 10 and all(math.hypot(p[1] - q[1], p[2] - q[2]) >= 1.0 for q in kept):
            kept.append(p)
    assert got == {p[0] for p in kept}


@pytest.mark.parametrize("radius", [0.2, 0.6, 1.2])
def test_near_neighbours_against_brute_force(vectors, radius):
    """k rows a query whatever the radius, and recall of nine tenths."""
    df, x, _ = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = np.linalg.norm(u[:, None] - u[None], axis=2)
    np.fill_diagonal(far, np.inf)
    got = {}
    for r in ranking.near_neighbours(df, df.where("id % 20 = 0"), "id", "v", 5, radius).collect():
        got.setdefault(r["query"], {})[r["id"]] = r["distance"]
        assert abs(r["distance"] - far[r["query"], r["id"]]) < 1e-6
    assert set(got) == set(range(0, 200, 20)) and all(len(ids) == 5 for ids in got.values())
    assert sum(len(set(ids) & set(np.argsort(far[q])[:5].tolist())) for q, ids in got.items()) >= 0.9 * 50


def test_pages_match_names_of_short_and_accented_words(spark):
    names = ["De De De", "Que tá", "Война", "Игра 3", "Portal", "!!"]
    titles = ["de de de", "Que Tá!", "война", "Фильм 3", "Portal", "Игра 33", "..."]
    a = spark.createDataFrame(list(enumerate(names)), "entity long, name string")
    b = spark.createDataFrame(list(enumerate(titles)), "page long, title string")
    got = {r["entity"]: (r["page"], r["score"]) for r in merging.match_pages(a, b, "entity", "name", "page", "title", [], []).collect()}
    assert {k: v for k, v in got.items() if k != 3} == {0: (0, 6.0), 1: (1, 6.0), 2: (2, 6.0), 4: (4, 6.0)}
    assert got[3][0] == 5 and got[3][1] < 6


def test_ridge_is_the_closed_form(vectors):
    df, x, y = vectors
    w, b = probes.ridge_fit(df, "v", ["y"], 5.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 5 * np.eye(8), z.T @ (y - y.mean()))
    assert np.allclose(w[:, 0] * x.std(0), want, atol=1e-10)
    got = [r["p"] for r in probes.ridge_predict(df, "v", w[:, 0], b[0], "p").orderBy("id").collect()]
    assert np.allclose(got, z @ want + y.mean(), atol=1e-9)
    out, chosen = probes.ridge_cv(ranking.with_fold(df, "id", 4, 1), "id", "v", "y", "fold", [0.1, 1.0, 1000.0], "clip")
    assert set(chosen.values()) <= {0.1, 1.0} and aggregates.regression_metrics(out, "y", "prediction", "id", []).first()["r2"] > 0.8


def test_probe_learns_a_tag(vectors):
    df, x, _ = vectors
    rows = ranking.with_fold(df.withColumn("t", (F.col("v")[0] > 0).cast("int")).withColumn("never", F.lit(0)), "id", 3, 1)
    got = probes.tag_probe(rows, "id", "v", ["t", "never"], "fold", 3).collect()
    assert {r["tag"] for r in got} == {"t"} and sum(r["tp"] for r in got) > 0.85 * (x[:, 0] > 0).sum()


def test_variance_matches_numpy(vectors):
    df, x, _ = vectors
    c = np.cov(x.T, bias=True)
    got = aggregates.participation_ratio(df, "v").first()[0]
    assert abs(got - np.trace(c) ** 2 / (c**2).sum()) < 1e-9
    s = aggregates.fit_scaler(df, "v").first()
    assert np.allclose(s["mean"], x.mean(0)) and np.allclose(s["std"], x.std(0))


@pytest.mark.parametrize("zscored", [False, True])
def test_spectrum_matches_numpy(vectors, zscored):
    df, x, _ = vectors
    want = np.linalg.eigvalsh(np.corrcoef(x.T) if zscored else np.cov(x.T, bias=True))[::-1]
    got = aggregates.spectrum(df, "v", 5, zscored).orderBy("nth").collect()
    assert np.allclose([r["eigenvalue"] for r in got], want[:5]) and np.allclose([r["share"] for r in got], want[:5] / want.sum())


def test_probe_is_at_its_optimum(vectors):
    """Counts of the probes equal those of a plain fit by gradient steps until it stands still."""
    df, x, _ = vectors
    rows = ranking.with_fold(df.withColumn("t", (F.col("v")[0] + F.col("v")[1] > 0.3).cast("int")), "id", 3, 1).repartition(3)
    got = {r["fold"]: (r["tp"], r["fp"], r["fn"]) for r in probes.tag_probe(rows, "id", "v", ["t"], "fold", 3, grid=[0.5]).collect()}
    data = rows.select("v", "t", "fold").collect()
    z = np.array([r["v"] for r in data])
    z = np.column_stack([z / np.linalg.norm(z, axis=1, keepdims=True), np.ones(len(z))])
    y, fold = np.array([r["t"] for r in data]), np.array([r["fold"] for r in data])
    for k in range(3):
        w, t = z[fold != k], y[fold != k]
        weight = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
        b, keep = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 0)
        for _ in range(20_000):
            b -= 0.005 * (w.T @ (weight * (1 / (1 + np.exp(-w @ b)) - t)) + keep * b)
        said, true = z[fold == k] @ b >= 0, y[fold == k] == 1
        assert got[k] == ((said & true).sum(), (said & ~true).sum(), (~said & true).sum())


def test_topics(vectors):
    df, *_ = vectors
    got = ranking.assign_topics(df, "id", "v", 3, dims=2).groupBy("topic").count().collect()
    assert sum(r["count"] for r in got) == 200 and 10 <= next(r["count"] for r in got if r["topic"] == -1) <= 30


def test_transport_keeps_mass(spark):
    rng = random.Random(3)
    pts = spark.createDataFrame([(c, i, rng.uniform(0, 10), rng.uniform(0, 10), rng.random() + 0.1) for c in range(3) for i in range(60)], "cohort int, id long, x double, y double, w double")
    cells = flow.cells_of(pts, "cohort", 8, (-1.0, 11.0, -1.0, 11.0))
    plan = flow.transport(cells, "cohort").cache()
    for step in (0, 1):
        part = plan.where(F.col("step") == step)
        assert abs(part.agg(F.sum("mass")).first()[0] - 1) < 1e-6
        total = cells.where(F.col("cohort") == step + 1).agg(F.sum("w")).first()[0]
        want = {(round(r["x"], 9), round(r["y"], 9)): r["w"] / total for r in cells.where(F.col("cohort") == step + 1).collect()}
        for r in part.groupBy("dx", "dy").agg(F.sum("mass").alias("m")).collect():
            assert abs(r["m"] - want[round(r["dx"], 9), round(r["dy"], 9)]) < 1e-6
    heat = flow.heat_grid(pts, "cohort", 20, (-1.0, 11.0, -1.0, 11.0), 1.0).groupBy("cohort").agg(F.sum("heat").alias("h"))
    assert all(abs(r["h"] - 1) < 1e-9 for r in heat.collect())
    lanes = {r["lane"] for r in flow.assign_lanes(pts, 3).select("lane").distinct().collect()}
    assert lanes == {0, 1, 2}


def test_embedding_once_per_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", "a b", None])], "i int, t string")
    got = {r["i"]: r["vector"] for r in probes.embed(df, "t", probes.hashing_provider(4), 4).collect()}
    assert got[0] == got[2] and len(got) == 4 and all(len(v) == 4 for v in got.values())
    with pytest.raises(Exception, match="dimensions"):
        probes.embed(df, "t", probes.hashing_provider(4), 5).collect()


def test_infer_columns(spark):
    df = spark.createDataFrame([("570", "x", "1")], "`App ID` string, Review string, score string")
    assert tables.infer_columns(df) == {"appid": "App ID", "review": "Review", "recommend": "score"}
    with pytest.raises(ValueError):
        tables.infer_columns(df.drop("Review"))
    with pytest.raises(ValueError):
        tables.infer_columns(df, {"user": "nobody"})


def test_json_sources(spark, tmp_path):
    (tmp_path / "games.json").write_text('{"10": {"name": "x", "tags": {"a": 2}}, "11": "no", "12": {"name": "y"}}')
    got = {r["key"]: r["name"] for r in tables.scan_entities(spark, str(tmp_path / "games.json"), "name string, tags map<string,double>").collect()}
    assert got == {"10": "x", "12": "y"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"score": 1.5}')
    (tmp_path / "r" / "b.json").write_text('{"score": ')
    assert sorted((r["status"], r["score"]) for r in tables.scan_reports(spark, str(tmp_path / "r"), "score double").collect()) == [("bad_json", None), ("ok", 1.5)]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "7_x.json").write_text('{"0": {"sentence_2": {"sentence_text": "b", "vector": [1, 2]}, "sentence_10": {"sentence_text": "c"}}}')
    assert [tuple(r) for r in tables.scan_embedded(spark, str(tmp_path / "e"), 2).collect()] == [("7", 0, 2, "b", [1.0, 2.0])]
    with pytest.raises(Exception, match="not of length 3"):
        tables.scan_embedded(spark, str(tmp_path / "e"), 3).collect()
    (tmp_path / "d.txt").write_text('a "b|1\n-LRB-|2\n')
    assert [tuple(r) for r in tables.scan_treebank(spark, str(tmp_path / "d.txt"), ["phrase", "id"]).collect()] == [('a "b', "1"), ("-LRB-", "2")]


def test_stream_is_the_batch(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0.jsonl").write_text('{"combo_id": "a", "status": "running", "ts": "1"}\n{"combo_id": "a", "status": "done", "ts": "2"}\n{"combo_id": "b", "sta')
    latest = jobs.run_available(jobs.stream_latest(jobs.read_log(spark, str(tmp_path / "log"))), f"file://{tmp_path}/c")
    batch = runs.latest_state(spark.read.schema(jobs.LOG).json(str(tmp_path / "log")), "combo_id", "ts", ["status"])
    assert [(r["combo_id"], r["status"]) for r in latest.collect()] == [(r["combo_id"], r["status"]) for r in batch.collect()] == [("a", "done")]
