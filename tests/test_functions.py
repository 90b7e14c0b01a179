"""Scalar and text operators against plain Python."""

import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.operators import cleaning, splitting

EDGE = [None, "", "  ", "a b", "a  b ", "\x1ca\x1f b\u0085", "570", "570.0", " 570.5 ", "1e3", "9" * 17 + ".0", "1d", "1_0", "nan", "inf", "-1", "True", " Recommended ",
        "not recommended", "maybe", "0", "0.4", "v1.2", "2 ... ok", "Hi! Yes?。 No！ x", "a.\r\n\r\nb; c； d", "emoji \U0001f600. end", "<p>A&amp;B</p><script>x</script>done [b]x[/b] !!!!", "Café ﬁne",
        "x [1] Seven words are in this sentence here. And again seven words are in this one! No.", "sentence_10", "a_b_c", "-LRB-x-RRB-"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(EDGE)], "i int, x string")


def values(rows, column):
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def clean(x):
    return re.sub(r"\s+", " ", x or "").strip()


def test_clean_text(rows):
    assert values(rows, T.clean_text(F.col("x"))) == [clean(x) for x in EDGE]


def number(x):
    x = (x or "").strip()
    return float(x) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", x) else None


def test_clean_id(rows):
    def want(x):
        n = number(x)
        return str(int(n)) if n is not None and n == int(n) and abs(n) < 2**53 else (x or "").strip()

    assert values(rows, T.clean_id(F.col("x"))) == [want(x) for x in EDGE]


def test_to_recommend(rows):
    def want(x):
        t = (x or "").strip().lower()
        if t in T.POSITIVE_WORDS:
            return T.POSITIVE
        if t in T.NEGATIVE_WORDS or t == "nan":
            return T.NEGATIVE
        n = number(x)
        return "" if n is None else T.POSITIVE if n > 0 else T.NEGATIVE

    assert values(rows, T.to_recommend(F.col("x"))) == [want(x) for x in EDGE]


def test_numbers(rows):
    assert values(rows, T.parse_number(F.col("x"))) == [number(x) for x in EDGE]


def test_titles_and_slugs(rows):
    folded = lambda x: unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode()
    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    assert values(rows, T.normalize_title(F.col("x"))) == [norm(folded(x)) for x in EDGE]
    assert values(rows, T.slug(F.col("x"))) == [re.sub("[^A-Za-z0-9_.-]+", "_", (x or "").strip()).strip("._") or "unknown" for x in EDGE]


def test_html(rows):
    got = values(rows, T.clean_html(F.col("x")))
    assert got[EDGE.index("<p>A&amp;B</p><script>x</script>done [b]x[/b] !!!!")] == "A&B. done x!"
    assert all(html.unescape(g) == g for g in got)


def test_repair(spark):
    broken = "cafÃ© Â« -LRB-x-RRB-"
    assert spark.range(1).select(T.repair_text(F.lit(broken))).first()[0] == "café « (x)"


@pytest.mark.parametrize(
    "mode, want",
    [
        ("fallback", lambda x: [p.strip() for p in re.split(rf"(?<=[{splitting.ENDS}])\s+", clean(x)) if p.strip()]),
        ("query", lambda x: [p.strip() for p in re.split(rf"(?:\r?\n)+|(?<=[{splitting.ENDS};；])\s*", (x or "").strip()) if p.strip()] or [(x or "").strip()]),
        ("prose", lambda x: [p for p in re.split(r"""(?<=[.!?])\s+(?=[A-Z0-9"'])""", clean(re.sub(r"\[[^\]]+\]", "", x or ""))) if 7 <= len(p.split()) <= 60]),
    ],
)
def test_sentences(rows, mode, want):
    assert values(rows, splitting.sentence_array(F.col("x"), mode)) == [want(x) for x in EDGE]


def test_sections(spark):
    body = "intro\n== Plot ==\nfirst\n\nsecond\n=== Plot ===\nthird\n== Empty ==\n"
    got = {r["section"]: r["text"] for r in splitting.split_sections(spark.createDataFrame([(1, body)], "page int, body string"), "page", "body").collect()}
    assert got == {"Lead": "intro", "Plot": "first\nsecond\nthird"}


def test_strict_and_open_limits(spark):
    df = spark.createDataFrame([("a" * n, n) for n in (299, 300, 301)], "t string, n int")
    assert {r["n"] for r in cleaning.filter_length(df, "t").collect()} == {301}
    assert {r["n"] for r in cleaning.filter_length(df, "t", strict=False).collect()} == {300, 301}
    keys = spark.createDataFrame([(k,) for k, n in (("x", 3), ("y", 4)) for _ in range(n)], "k string")
    assert {r["k"] for r in cleaning.filter_count(keys, "k", 3).collect()} == {"y"}
    assert {r["k"] for r in cleaning.filter_count(keys, "k", 3, strict=False).collect()} == {"x", "y"}


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (-1.8, -0.6, -0.59, 0.6, 1.8, None)], "x double")
    assert [r[0] for r in df.select(T.bucket_score(F.col("x"))).collect()] == [1, 2, 3, 4, 5, None]


def test_preparation_stays_out_of_python(spark):
    df = spark.createDataFrame([("1", "text", "yes")], "id string, t string, r string")
    plan = cleaning.prepare_reviews(df, "id", "t", "r", 1, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_marks_may_stand_alone(spark):
    texts = ["! ! b. c", "a! ! B", ". x", "...", "? ? ?", "", "Hello there. General. ! Kenobi"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", splitting.sentence_array(F.col("t")).alias("s"), splitting.sentence_count(F.col("t")).alias("n"))
    for r in df.collect():
        want = [x for x in re.split(r"(?<=[.!?])\s+", r["t"].strip()) if x]
        assert r["s"] == want and r["n"] == len(want)
