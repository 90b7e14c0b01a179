"""Texts written as CSV come back as they were."""

import hashlib
import random

from reviewlake import plans
from reviewlake.sources import tables

ODD = [None, "", " ", "\t", "\r", "  lead", "trail ", "\n", "\nlead", "trail\n", "\x0b", "x\x1f", "\0", "\0lead", "trail\0", '"', '""', '"\0"', 'a\0"b', ' "x" ', "\\", 'a\\"', "a\r\nb", "null", "#c", ","]


def test_reviews_come_back_from_csv_as_they_were(spark, tmp_path):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice('"\\, \n\t\0a#\'') for _ in range(rng.randint(0, 7))) for _ in range(500)]
    rows = spark.createDataFrame([(i, t, i if i % 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r["appid"]): (r["review"], r["recommend"]) for r in plans.QUERIES["a1_scan_reviews"](spark, str(tmp_path)).collect()}
    md5 = lambda t: None if t is None else hashlib.md5(t.replace("\r", "").encode()).hexdigest()
    assert got == {i: (md5(t), str(i) if i % 3 else None) for i, t in enumerate(texts)}


def test_empty_fields_are_null_and_quoted_ones_empty(spark, tmp_path):
    (tmp_path / "r.csv").write_text('app_id,review\n1,\n2,""\n3," a ""b"""\n4, c \n')
    assert [tuple(r) for r in tables.scan_reviews(spark, str(tmp_path / "r.csv")).collect()] == [("1", None), ("2", ""), ("3", ' a "b"'), ("4", " c ")]
