"""Joins, vectors, archives and the pipeline against plain Python."""

import base64
import hashlib
import random
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlake.llm import graph, jaccard, mixing, neardup, packing, quality, secrets, warc


def classes(pairs):
    sets = {i: brute.shingles(t) for i, t in pairs}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, brute.components(ids, links)


def test_texts_to_verify_are_small_and_do_not_stay(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(0, 60, 3):
        base = [rng.choice(words) for _ in range(700)]
        # 25 words on end replaced: linked; 150: not
        rows += [(i + j, " ".join(base[:k] + [rng.choice(words) for _ in range(n)] + base[k + n :])) for j, (k, n) in enumerate([(0, 0), (90, 25), (300, 150)])]
    written, write = [], jaccard.materialize

    def seen(df, label, *args, **options):
        out = write(df, label, *args, **options)
        if label == "jaccard-sets":
            path = Path(out._written_to.removeprefix("file://").removeprefix("file:"))
            written.append((path, sum(f.stat().st_size for f in path.glob("*.parquet")), out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i - (i % 3 == 1) for i in range(60)}
    assert written and all(0 < size < 0.6 * 8 * 690 * n for _, size, n in written)
    assert not any(path.exists() for path, _, _ in written)


def test_jaccard_classes(docs, texts, empty, odd):
    sets, want = classes(texts)
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert jaccard.jaccard_classes(empty).count() == 0 and jaccard.jaccard_classes(odd).count() == odd.count()
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_one_row_of_each_class_stays(spark):
    """Ids that repeat, with equal and with other texts, and null ids."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "y"), (7, c, "x"), (7, c, "x"), (None, a, "x"), (None, d, "x"), (None, d, "x"), (None, d.upper(), "x"), (None, e, "x"), (9, None, "x"), (9, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], (r["text"] or "none").lower()) for r in jaccard.one_of_each(df).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (7, c), (None, d), (None, e), (9, "none"), (9, "none")], key=str)
    again = jaccard.one_of_each(spark.createDataFrame(rows[::-1], df.schema).repartition(5))
    assert sorted(again.collect(), key=str) == sorted(jaccard.one_of_each(df).collect(), key=str)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_large_groups_of_near_copies(spark, monkeypatch, hot):
    """Groups beyond GROUP, chains of similarity just at the limit, a shared passage, and salted hot n-grams."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "CHAIN_ROWS", 8)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"r{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, passage + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randint(3, 12)))) for i in range(40)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    _, want = classes(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    want = brute.components({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(got) >= {x for e in edges if e[0] != e[1] for x in e}


def linked(rows, threshold=0.9):
    """vec_id -> (links, component) by brute force, for rows with ids of their own."""
    ok = {i: np.array(v, float) for i, v in rows if v is not None and all(z is not None and np.isfinite(z) for z in v) and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    ids = list(unit)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    part = brute.components([i for i, _ in rows], pairs)
    return {i: (sum(i in p for p in pairs), part[i]) for i, _ in rows}, len(pairs)


@pytest.mark.parametrize("kind, cell_rows, block_rows", [("float", 512, 1000), ("double", 16, 1000), ("float", 16, 12)])
def test_near_duplicate_vectors(spark, monkeypatch, kind, cell_rows, block_rows):
    """Pairs, groups, copies, two lengths, huge components and odd vectors, in one cell, in many, and in cells over salts."""
    monkeypatch.setattr(neardup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    near = base[:40] + 0.1 * rng.normal(size=(40, 32)) * np.linalg.norm(base[:40], axis=1, keepdims=True) / np.sqrt(32)
    group = base[0] + 0.05 * rng.normal(size=(60, 32))
    x = np.vstack([base, near, group, base[10:14], base[10:14], 3 * base[20:22]]).astype(np.float32)
    few = np.vstack([base[:6, :3], base[:3, :3] * 1.001]).astype(np.float32)
    rows = [(i, [float(z) for z in v]) for i, v in enumerate([*x, *few])]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] + [1.0] * 31), (n + 3, [None] + [1.0] * 31), (n + 4, [float("inf")] * 32), (n + 5, []), (n + 6, [-0.0] * 32)]
    if kind == "double":
        rows += [(n + 7, [1e200 * float(z) for z in base[30]]), (n + 8, [1e-200 * float(z) for z in base[30]])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links int")
    want, n_pairs = linked(rows)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert set(got) == set(want)
    assert all(got[i]["n_links"] <= k for i, (k, _) in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 2 * 0.97 * n_pairs
    assert sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= 0.98 * len(want)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    """Rows of one id and several vectors keep the links of each; rows without an id have none."""
    a, b, c = ([float(k == i) + 0.01 * k for k in range(8)] for i in range(3))
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (4, a), (None, a), (None, c)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 1, False), (0, 0, 0, True), (0, 0, 0, True)])


def test_search_plan_reaches_its_recall():
    plan = neardup.search_plan(5000)
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * other
    lines, signs = neardup.directions(32, neardup.LINES, 0), neardup.directions(32, plan.tables * plan.bits, 1)
    count = (abs(a @ lines - b @ lines) <= plan.width).sum(axis=1)
    same = ((a @ signs > 0) == (b @ signs > 0)).reshape(len(a), plan.tables, plan.bits).all(axis=2).any(axis=1)
    assert ((count >= plan.min_count) & same).mean() > 0.97
    assert (abs(a @ lines - np.roll(a, 1, axis=0) @ lines) <= plan.width).sum(axis=1).max() < plan.min_count


def test_windows_count_collisions():
    rng = np.random.default_rng(1)
    q, y = rng.normal(size=(30, 5)), rng.normal(size=(50, 5))
    got = neardup.Windows(q, y, 0.7).collisions(slice(3, 20), slice(10, 50))
    assert (got == (abs(q[3:20, None] - y[None, 10:50]) <= 0.7).sum(axis=2)).all()


def test_archives(spark):
    html = [None, "", "a" * 1000, "é" * 700, "a" * 1000, "WARC/1.1\r\n\r\nfake", "z" * 50, "z" * 50]
    rows = [(i, None if i == 2 else f"http://x/{i}\nq", h) for i, h in enumerate(html)] + [(None, "u", "a" * 1000), (6, "again", "z" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_report(pages, chunk_bytes=64).collect()
    assert len(got) == len(rows)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    for r in got:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        h = html[r["page_id"]]
        least = first[digest(h)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((h or "").encode()), digest(h))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if least == r["page_id"] else ("revisit", least))
    assert warc.archive_report(pages.limit(0)).count() == 0
    big = {r["page_id"]: r["record_type"] for r in warc.archive_report(pages.where("page_id < 6"), min_bytes=10).collect()}
    assert big[1] == "response" and big[4] == "revisit"


def test_pages_with_further_columns(spark):
    """Columns named like the operator's own, and pages without id whose payloads are equal."""
    rows = [(1, "u", "x" * 90, "row", "chunk", 5, "d"), (2, "u", "x" * 90, "row", "chunk", 5, "d"), (None, "u", "x" * 90, "row", "chunk", 5, "d"), (None, "u", "x" * 90, "row", "chunk", 5, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string, chunk string, payload_bytes int, payload_digest string")
    got = warc.archive_report(pages, chunk_bytes=32)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.collect()) == [(0, "response", None, 90)] * 2 + [(1, "response", None, 90), (2, "revisit", 1, 90)]
    heads = [bytes(r["data"]) for r in warc.write_records(pages, chunk_bytes=32).where("chunk = 0").collect()]
    assert len({h.split(b"WARC-Record-ID: ")[1].split(b"\r")[0] for h in heads}) == 4


def test_a_record_is_a_warc_record(spark):
    chunks = warc.write_records(spark.createDataFrame([(1, "http://x/", "b" * 300)], "page_id long, url string, html string"), chunk_bytes=128).orderBy("chunk").collect()
    data = b"".join(bytes(c["data"]) for c in chunks)
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1") and rest.endswith(b"b" * 300 + b"\r\n\r\n") and len(rest) - 4 == int(fields["Content-Length"])
    assert max(len(c["data"]) for c in chunks[1:]) <= 128
    sums = [c["sha1_so_far"] for c in chunks if c["sha1_so_far"]]
    assert sums[-1] == fields["WARC-Payload-Digest"].removeprefix("sha1:") and len(sums) == len(set(sums))


def test_damage_is_seen(spark):
    chunks = warc.write_records(spark.createDataFrame([(1, "http://x/", "b" * 300)], "page_id long, url string, html string"), chunk_bytes=128)
    torn = chunks.withColumn("data", F.when(F.col("chunk") == 2, F.encode(F.lit("x" * 128), "utf-8")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="digests differ"):
        warc.read_records(torn).collect()


def test_pipeline_stages(spark, docs, texts):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing", "packing"]
    now = docs
    kept = {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}
    now = stages["quality rules"](spark, now, "")
    assert {r["doc_id"] for r in now.collect()} == kept and now.columns == docs.columns
    _, want = classes([(i, t) for i, t in texts if i in kept])
    now = stages["n-gram Jaccard join"](spark, now, "")
    assert {r["doc_id"] for r in now.collect()} == {i for i, c in want.items() if i == c} and now.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in now.collect()}
    now = stages["secret scans"](spark, now, "")
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == set(before)
    for r in now.collect():
        assert r["n_chars"] == len(r["text"]) and not brute.base_spans(r["text"], brute.SECRETS)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(now).collect()}
    now = stages["mixing"](spark, now, "")
    assert {r["doc_id"]: r["count"] for r in now.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n} and now.columns == docs.columns
    last = stages["packing"](spark, now, "")
    assert sum(r["length"] for r in last.collect()) == sum(r["length"] for r in packing.token_pieces(now).collect())


def test_pipeline_runs(spark, docs, tmp_path):
    docs.where("text is not null").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0
    assert secrets.find_secrets(docs).count() == docs.count()
