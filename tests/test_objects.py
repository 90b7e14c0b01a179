"""Large JSON objects against json.loads, with splits in the middle of everything."""

import json
import random

import pytest

from reviewlake.sources import objects, tables


def some_object(rng, n):
    odd = ['a "quoted" }', "{", "}}", "back\\slash", 'end\\"', "\\", "], [", "é 日本", "\n\t", "", ',"x":{', "}" * 50]
    value = lambda: rng.choice([rng.choice(odd), rng.random(), None, True, [rng.choice(odd), {"in": rng.choice(odd)}, [[]]], {"deep": {"er": rng.choice(odd), "l": [{}]}}, {}])
    out = {}
    for i in range(n):
        kind = rng.random()
        out[f"{i}{rng.choice(odd) if kind < 0.1 else ''}"] = {"name": rng.choice(odd), "n": i, "more": value(), "last": value()} if kind < 0.85 else value()
    return out


@pytest.mark.parametrize("split", ["64", "1000", "100000000"])
def test_entries_are_those_of_the_parser(spark, tmp_path, split):
    rng = random.Random(int(split))
    want = {}
    for k, (n, style) in enumerate([(60, {}), (1, {}), (0, {}), (40, {"indent": 1}), (25, {"ensure_ascii": False, "separators": (",", ":")})]):
        data = some_object(rng, n)
        (tmp_path / f"f{k}.json").write_text(json.dumps(data, **style) + ("\n" if k % 2 else ""))
        want |= {(f"f{k}.json", key): v for key, v in data.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        if split == "64":
            assert spark.read.option("lineSep", "}").text(f"file://{tmp_path}").rdd.getNumPartitions() > 50
        rows = objects.object_entries(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    got = {(r["file"].rsplit("/", 1)[1], r["key"]): r["json"] for r in rows}
    assert set(got) == set(want) and len(rows) == len(want)
    for k, v in want.items():
        assert got[k] == v if isinstance(v, str) else (got[k] is None) == (v is None) and (v is None or json.loads(got[k]) == v), k


def test_large_entities_are_the_entities(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"1": {"name": "x}", "n": 3}, "2": 5, "3": {"name": None}, "4": "{}", "5": {"n": 7, "z": [1]}}))
    path = f"file://{tmp_path}"
    got = {tuple(r) for r in objects.scan_large_entities(spark, path, "name string, n long").collect()}
    assert got == {tuple(r) for r in tables.scan_entities(spark, path, "name string, n long").collect()} and len(got) >= 3
