"""Quality rules as a short-circuit cascade.

A rule looks at one text and says whether it rejects it. On a random sample of bounded expected size the cascade measures what each rule
costs and how many texts it rejects, and then runs the rules in order of rejections per second; a text leaves at
the first rule that rejects it. The order changes the cost alone: a text is kept if no rule rejects it.

Defined results: null and empty texts have no words and fail the base rule; repeated rows get the same result;
an empty table gives an empty table; other columns pass through `filter_quality` untouched.
"""

from __future__ import annotations

import time
from collections import Counter
from functools import cached_property
from unicodedata import category

from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.batches import WORDS, map_rows

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"


class Text:
    """A text with the measures that rules share, each worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORDS.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that the text has twice or more; every word counts once."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        covered, upto = 0, 0
        for i, x in enumerate(windows):
            if often[x] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
        return covered


def few_words(t: Text) -> bool:
    return t.n_words < 50


def repeats_itself(t: Text) -> bool:
    return 100 * t.n_repeat_words > 50 * t.n_words


def symbol_share(t: Text) -> bool:
    return 100 * t.n_symbols > 10 * t.n_words


def repeated_lines(t: Text) -> bool:
    return 100 * t.n_dup_lines > 60 * len(t.lines)


def word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 15 * t.n_words


def shouting(t: Text) -> bool:
    """More than half of all cased characters are upper case."""
    upper = sum(map(str.isupper, t.text))
    return upper > 40 and 2 * upper > sum(map(str.isalpha, t.text))


def few_letters(t: Text) -> bool:
    """Fewer than three quarters of the characters in words are letters or combining marks."""
    letters = sum(map(str.isalpha, t.text))
    if 4 * letters >= 3 * t.word_chars:
        return False
    return 4 * (letters + sum(category(c)[0] == "M" for c in t.text)) < 3 * t.word_chars


BASE = (few_words, repeats_itself)
RULES = (symbol_share, repeated_lines, word_length, shouting, few_letters)


def measure_rules(docs: DataFrame, rules=BASE + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(rule, rows, rejected, seconds) on a random sample of some sample_rows texts, each rule on a fresh text.

    Sampled rows are measured where they are read; only a row a rule and task is shuffled.
    """

    def make():
        def one(text):
            for rule in rules:
                t, began = Text(text), time.perf_counter()
                out = rule(t)
                yield rule.__name__, int(out), time.perf_counter() - began

        return one

    sample = docs.select("text").sample(min(1.0, sample_rows / max(1, docs.count())), seed=1)
    return (
        map_rows(sample, make, "rule string, rejected long, seconds double")
        .groupBy("rule").agg(F.count("*").alias("rows"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    )


def order_rules(measured, rules) -> list:
    """Rules by rejections per second, best first; the name settles ties. One measured row per rule."""
    by = {r["rule"]: (r["rejected"] + 0.5) / (r["seconds"] + 1e-9) for r in measured}
    return sorted(rules, key=lambda rule: (-by.get(rule.__name__, 0.0), rule.__name__))


def quality_report(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, the base measures, base_failed, kept and the first rule that rejected it."""
    order = order_rules(measure_rules(docs, rules, sample_rows).collect(), rules)

    def make():
        def one(doc_id, text):
            t = Text(text)
            failed = any(rule(t) for rule in BASE)
            reason = "base" if failed else next((rule.__name__ for rule in order if rule(t)), None)
            yield doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, reason is None, reason

        return one

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, reason string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


def filter_quality(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of docs that no rule rejects, base rules included, all in one cascade; columns as they are."""
    every = BASE + tuple(rules)
    order = order_rules(measure_rules(docs, every, sample_rows).collect(), every)

    def run(batches):
        for batch in batches:
            keep = [not any(rule(t) for rule in order) for t in map(Text, batch.column(batch.schema.get_field_index("text")).to_pylist())]
            if any(keep):
                yield batch.filter(pa_array(keep))

    from pyarrow import array as pa_array

    from reviewlake.session import ship

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


#: The result of quality_report for tables in DuckDB, method rules included.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, t, ws, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_alpha, length(regexp_replace(t, '[^\p{M}]', '', 'g')) AS n_marks FROM w),
p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) AS x(k) GROUP BY 1),
b AS (SELECT m.*, coalesce(c.n, 0) AS n_repeat_words, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 60 * len(ls) OR NOT (word_chars BETWEEN 2 * n_words AND 15 * n_words)
    OR (n_upper > 40 AND 2 * n_upper > n_alpha) OR 4 * (n_alpha + n_marks) < 3 * word_chars) AS kept
FROM f
"""
