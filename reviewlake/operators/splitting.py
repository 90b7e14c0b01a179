"""Texts to sentences and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewlake.functions.text import clean_text, strip_ws

#: Marks that end a sentence, and the words of a sentence of prose.
ENDS = ".!?" + "".join(map(chr, (0x3002, 0xFF01, 0xFF1F)))
PROSE_WORDS = (7, 60)
#: A sentence of cleaned text: up to a mark before a space, or before a space and a start of the next one; a mark may stand alone.
SENTENCE = f"[^ ](?:(?<=[{ENDS}])(?= )|.*?(?:[{ENDS}](?= )|$))"
PROSE = """[^ ](?:(?<=[.!?])(?= [A-Z0-9"'])|.*?(?:[.!?](?= [A-Z0-9"'])|$))"""
#: A part of query text: up to a mark or the line's end.
QUERY_PART = rf"[^\r\n{ENDS};{chr(0xFF1B)}]*[{ENDS};{chr(0xFF1B)}]|[^\r\n{ENDS};{chr(0xFF1B)}]+"


def sentence_count(c: Column) -> Column:
    """Length of sentence_array(c), without making it."""
    return F.regexp_count(clean_text(c), F.lit(SENTENCE))


def sentence_array(c: Column, mode: str = "fallback", cap: int | None = None) -> Column:
    """Trimmed non-empty sentences. 'query' keeps newlines as ends and never gives an empty array; 'prose' keeps 7 to 60 words."""
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if mode == "query":
        parts = F.filter(F.transform(every(strip_ws(c), QUERY_PART), strip_ws), lambda s: s != "")
        parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(strip_ws(c)))
    elif mode == "prose":
        text = clean_text(F.regexp_replace(c, r"\[[^\]]+\]", ""))
        parts = F.filter(every(text, PROSE), lambda s: F.size(F.split(s, " ")).between(*PROSE_WORDS))
    else:
        parts = every(clean_text(c), SENTENCE)
    return F.slice(parts, 1, cap) if cap else parts


def split_sentences(df: DataFrame, col: str, mode: str = "fallback", cap: int | None = None, first: int = 1) -> DataFrame:
    """A row a sentence: the other columns, sentence_id from first, sentence. Texts without a sentence vanish."""
    rest = [c for c in df.columns if c != col]
    rows = df.select(*rest, F.posexplode(sentence_array(F.col(col), mode, cap)).alias("_at", "sentence"))
    return rows.select(*rest, (F.col("_at") + first).alias("sentence_id"), "sentence")


def split_sections(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, section, text): lines under `==Heading==` lines, `Lead` before the first; same names merge, empty ones vanish.

    Windows are by key, so a page's lines meet in one task; pages are bounded, the table is not.
    """
    return _sections(df, key, col).drop("first")


def _sections(df: DataFrame, key: str, col: str) -> DataFrame:
    """split_sections with `first`, the line on which a section begins."""
    lines = df.select(key, F.posexplode(F.split(F.col(col), r"\r?\n")).alias("at", "line")).withColumn("line", strip_ws(F.col("line")))
    heading = F.regexp_extract("line", r"^(={2,6})\s*(.+?)\s*\1$", 2)
    lines = lines.withColumn("heading", F.when(heading != "", heading))
    section = F.coalesce(F.last("heading", ignorenulls=True).over(W.partitionBy(key).orderBy("at")), F.lit("Lead"))
    body = lines.withColumn("section", section).where(F.col("heading").isNull() & (F.col("line") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return body.groupBy(key, "section").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), F.min("at").alias("first"))


def pick_description(sections: DataFrame, key: str, terms: list[str], n: int = 5) -> DataFrame:
    """(key, description): the first n prose sentences of sections whose name has a term, else the first n with a term in them."""
    has = lambda c: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(c), t))
    rows = split_sentences(sections.select(key, "section", "text"), "text", "prose")
    rows = rows.withColumn("named", has(F.col("section"))).withColumn("said", has(F.col("sentence"))).where("named or said")
    rows = rows.withColumn("tier", F.min(F.when(F.col("named"), 0).otherwise(1)).over(W.partitionBy(key))).where((F.col("tier") == 1) | F.col("named"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("section", "sentence_id"))).where(F.col("nth") <= n)
    picked = F.array_sort(F.collect_list(F.struct("nth", "sentence")))
    return rows.groupBy(key).agg(F.array_join(F.transform(picked, lambda x: x["sentence"]), " ").alias("description"))


#: What stands in for a part that a page does not have.
NO_GAMEPLAY = "The page has no passage on how it is played."
NO_STORY = "The page has no passage on a story."


def describe_pages(df: DataFrame, key: str, body: str, gameplay: tuple[list[str], list[str]], story: tuple[list[str], list[str]]) -> DataFrame:
    """(key, overview, gameplay, story) of every page with a key, from its prose sentences in order.

    overview is the first two sentences before any heading, else of the whole body. gameplay and story each have terms
    for headings and terms for sentences: the first three sentences under such headings, else the first three that have such a
    term, else a fixed remark. Null and blank bodies have an empty overview and both remarks.
    """
    has = lambda c, terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(c), t))
    one = F.struct("first", "section", sentence_array(F.col("text"), "prose").alias("ss"))
    pages = _sections(df.where(F.col(key).isNotNull()).select(key, body), key, body).groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_s"))
    under = lambda test: F.flatten(F.transform(F.filter("_s", lambda s: test(s["section"])), lambda s: s["ss"]))
    every = F.flatten(F.transform("_s", lambda s: s["ss"]))

    def part(terms: tuple[list[str], list[str]], none: str) -> Column:
        named, said = under(lambda c: has(c, terms[0])), F.filter(every, lambda s: has(s, terms[1]))
        text = lambda a: F.array_join(F.slice(a, 1, 3), " ")
        return F.coalesce(F.when(F.size(named) > 0, text(named)), F.when(F.size(said) > 0, text(said)), F.lit(none))

    lead = under(lambda c: c == "Lead")
    parts = pages.select(key, F.when(F.size(lead) > 0, F.array_join(F.slice(lead, 1, 2), " ")).alias("_lead"), part(gameplay, NO_GAMEPLAY).alias("gameplay"), part(story, NO_STORY).alias("story"))
    whole = F.array_join(F.slice(sentence_array(F.coalesce(body, F.lit("")), "prose"), 1, 2), " ")
    rows = df.where(F.col(key).isNotNull()).select(key, whole.alias("_whole")).join(parts, key, "left")
    return rows.select(key, F.coalesce("_lead", "_whole").alias("overview"), F.coalesce("gameplay", F.lit(NO_GAMEPLAY)).alias("gameplay"), F.coalesce("story", F.lit(NO_STORY)).alias("story"))
