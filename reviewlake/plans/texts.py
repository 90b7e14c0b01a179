"""Queries over texts: cleaning, filters, splitting, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.operators import cleaning, splitting
from reviewlake.plans import sql as S
from reviewlake.plans.registry import Tables, query
from reviewlake.session import materialize

STEP_0 = f"""
WITH c AS (SELECT doc_id, source, {S.clean('text')} AS review FROM documents),
f AS (SELECT * FROM c WHERE length(review) > 300), k AS (SELECT source FROM f GROUP BY 1 HAVING count(*) > 5)
SELECT source, count(*) AS kept, CAST(sum(quality) AS BIGINT) AS pos, round(sum(quality) / count(quality), 6) AS rate
FROM f SEMI JOIN k USING (source) LEFT JOIN labels USING (doc_id) GROUP BY 1
"""


@query("flagship_review_rates", STEP_0)
def flagship(t: Tables):
    """Clean, filter by length, keep entities with enough reviews, join labels, and give each entity's rate."""
    rows = materialize(cleaning.filter_length(t.documents, "text").select("doc_id", "source"), "long-enough")
    labelled = cleaning.filter_count(rows, "source", 5).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return labelled.groupBy("source").agg(
        F.count("*").alias("kept"), F.sum("quality").alias("pos"), F.round(F.sum("quality") / F.count("quality"), 6).alias("rate")
    )


@query("b1_clean_text", f"SELECT doc_id, md5({S.clean('text')}) AS review FROM documents")
def b1(t: Tables):
    return t.documents.select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("review"))


MIXED_IDS = "CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '.0' WHEN p_partkey % 3 = 1 THEN '  ' || p_partkey || '_x ' ELSE p_partkey || '.5' END"


@query("b2_clean_id", f"SELECT p_partkey, CASE WHEN ({S.number('r')}) = floor({S.number('r')}) THEN CAST(CAST(({S.number('r')}) AS BIGINT) AS VARCHAR) ELSE {S.strip('r')} END AS appid FROM (SELECT p_partkey, {MIXED_IDS} AS r FROM part)")
def b2(t: Tables):
    return t.part.select("p_partkey", F.expr(MIXED_IDS).alias("r")).select("p_partkey", T.clean_id(F.col("r")).alias("appid"))


LABELS = "CASE user_id % 7 WHEN 0 THEN 'True' WHEN 1 THEN ' recommended ' WHEN 2 THEN '-1' WHEN 3 THEN 'nan' WHEN 4 THEN '' WHEN 5 THEN 'maybe' ELSE CAST(round(value, 2) AS VARCHAR(40)) END"


@query("b3_to_recommend", f"SELECT event_id, {S.recommend('r')} AS recommend FROM (SELECT event_id, {LABELS} AS r FROM events)")
def b3(t: Tables):
    return t.events.select("event_id", F.expr(LABELS).alias("r")).select("event_id", T.to_recommend(F.col("r")).alias("recommend"))


@query("b4_filter_length", f"SELECT doc_id, lang FROM documents WHERE length({S.clean('text')}) > 300")
def b4(t: Tables):
    return cleaning.filter_length(t.documents, "text").select("doc_id", "lang")


@query("b6_filter_count", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def b6(t: Tables):
    return cleaning.filter_count(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 12, strict=False)


@query(
    "b7_prepare_reviews",
    f"""WITH p AS (SELECT {S.strip('source')} AS appid, {S.clean('text')} AS review, {S.recommend('CAST(quality AS VARCHAR)')} AS recommend
          FROM documents LEFT JOIN labels USING (doc_id)), f AS (SELECT * FROM p WHERE appid <> '' AND length(review) > 300)
        SELECT appid, md5(review) AS review, recommend FROM f WHERE appid IN (SELECT appid FROM f GROUP BY 1 HAVING count(*) > 5)""",
)
def b7(t: Tables):
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return cleaning.prepare_reviews(rows, "source", "text", "quality", min_count=5).withColumn("review", F.md5("review"))


#: DuckDB has no back references, so each silent element is spelled out.
HTML_PARTS = "(?is)" + "|".join(rf"<{x}\b.*?</{x}>" for x in T.SILENT) + "|<[^>]+>|[^<]+|<"
SAID = rf"CASE WHEN NOT (starts_with(x, '<') AND ends_with(x, '>')) THEN x WHEN lower(regexp_replace(x, '(?s)^<\s*(/?)\s*([A-Za-z][A-Za-z0-9]*)\b.*>$', '\1\2')) IN ({S.words(T.BREAKS)}) THEN '. ' ELSE ' ' END"
HTML_TEXT = f"array_to_string(list_transform(regexp_extract_all(coalesce(html, ''), '{HTML_PARTS}'), lambda x: {SAID}), '')"
HTML_CLEAN = r"regexp_replace(" + S.clean(rf"regexp_replace({HTML_TEXT}, '\[[^\]]+\]', ' ', 'g')") + r", ' ([,.;:!?])', '\1', 'g')"


@query("b8_clean_html", rf"SELECT page_id, md5(trim(regexp_replace({HTML_CLEAN}, '[.!?]{{2,}}([.!?])', '\1', 'g'), ' .')) AS body FROM pages")
def b8(t: Tables):
    return t.pages.select("page_id", F.md5(T.clean_html(F.col("html"), entities=False)).alias("body"))


@query("b8_clean_html_entities")
def b8e(t: Tables):
    return t.pages.select("page_id", F.md5(T.clean_html(F.col("html"))).alias("body"))


@query("b9_norm_title", "SELECT page_id, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS title FROM pages")
def b9(t: Tables):
    return t.pages.select("page_id", T.overlap_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("b9_norm_title_folded")
def b9n(t: Tables):
    return t.pages.select("page_id", T.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(
    "b10_slugs",
    r"""SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug, regexp_replace(regexp_replace(lower(p_name || '_' || p_brand), '[^\p{L}\p{N}_]+', '_', 'g'), '_+', '_', 'g') AS key
        FROM (SELECT *, regexp_replace(regexp_replace(p_type || ' / ' || p_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM part)""",
)
def b10(t: Tables):
    return t.part.select("p_partkey", T.slug(F.concat("p_type", F.lit(" / "), "p_name")).alias("slug"), T.column_key(F.col("p_name"), F.col("p_brand")).alias("key"))


def repaired(c: str) -> str:
    c = f"regexp_replace({c}, '{chr(0xC2)}([{chr(0x80)}-{chr(0xBF)}])', '\\1', 'g')"
    for code in range(0x80, 0xC0):
        c = f"replace({c}, chr(195) || chr({code}), chr({code + 0x40}))"
    return f"replace(replace({c}, '-LRB-', '('), '-RRB-', ')')"


BROKEN = f"replace(replace(text, chr(233), chr(195) || chr(169)), '.', ' -LRB-{chr(0xC2)}' || chr(171) || '-RRB-')"


@query("b11_repair_text", f"SELECT doc_id, md5({repaired(BROKEN)}) AS fixed FROM documents")
def b11(t: Tables):
    return t.documents.select("doc_id", F.md5(T.repair_text(F.expr(BROKEN))).alias("fixed"))


ODD_NUMBERS = "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'inf' WHEN 2 THEN '1e3' WHEN 3 THEN '12d' ELSE ' ' || CAST(user_id AS VARCHAR(20)) || '.75' END"


@query("b12_parse_number", f"SELECT event_id, {S.number('r')} AS number, CAST(trunc({S.number('r')}) AS BIGINT) AS whole FROM (SELECT event_id, {ODD_NUMBERS} AS r FROM events)")
def b12(t: Tables):
    rows = t.events.select("event_id", F.expr(ODD_NUMBERS).alias("r"))
    return rows.select("event_id", T.parse_number(F.col("r")).alias("number"), T.parse_number(F.col("r"), True).alias("whole"))


@query(
    "b13_completeness_report",
    """WITH e AS (SELECT s_suppkey, s_nationkey, trim(s_name) <> '' AND trim(n_name) <> '' AS complete FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey < 3),
       p AS (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem)
       SELECT count(*) AS prepared, count(*) FILTER (complete) AS complete, count(*) FILTER (NOT complete) AS incomplete, count(*) FILTER (complete IS NULL) AS missing
       FROM p LEFT JOIN e USING (s_suppkey)""",
)
def b13(t: Tables):
    enriched = t.supplier.join(t.nation.where("n_regionkey < 3"), F.col("n_nationkey") == F.col("s_nationkey"))
    enriched = cleaning.completeness(enriched, ["s_name"], ["n_name"])
    return cleaning.completeness_report(t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")), enriched, "s_suppkey")


@query("b14_entity_key", "SELECT event_id, string_split(user_id || '_' || event_type, '_')[1] AS appid FROM events")
def b14(t: Tables):
    return t.events.select("event_id", T.entity_key(F.concat_ws("_", F.col("user_id").cast("string"), "event_type")).alias("appid"))


@query("b15_order_key", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE trim(text) <> ''")
def b15(t: Tables):
    from pyspark.sql import Window as W

    rows = t.conversations.where(~cleaning.blank(F.col("text"))).withColumn("name", F.concat(F.lit("sentence_"), "turn"))
    return rows.select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy(T.order_key(F.col("name"), "sentence_"))).alias("nth"))


@query("b16_skip_meta", "SELECT conv_id, turn FROM conversations WHERE turn >= 3")
def b16(t: Tables):
    return cleaning.skip_meta(t.conversations.select("conv_id", "turn"), "turn")


@query("c1_split_sentences", f"SELECT doc_id, i AS sentence_id, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {S.sentences('text')} AS ss FROM documents))")
def c1(t: Tables):
    return splitting.split_sentences(t.documents.select("doc_id", "text"), "text")


QUERY_PARTS = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({S.strip('text')}, '(\r?\n)+', chr(31), 'g'), '([{S.ENDS};{chr(0xFF1B)}])\s*', '\1' || chr(31), 'g'), chr(31)), lambda x: {S.strip('x')}), lambda x: x <> '')"


@query(
    "c2_split_query_text",
    f"""SELECT item_id, i AS sentence_id, ss[i] AS sentence FROM (SELECT item_id, ss, unnest(range(1, least(len(ss), 20) + 1)) AS i
        FROM (SELECT item_id, CASE WHEN len({QUERY_PARTS}) > 0 THEN {QUERY_PARTS} ELSE [{S.strip('text')}] END AS ss FROM benchmark))""",
)
def c2(t: Tables):
    return splitting.split_sentences(t.benchmark.select("item_id", "text"), "text", "query", cap=20)


PROSE = r"list_filter(string_split(regexp_replace(trim(regexp_replace(regexp_replace(text, '\[[^\]]+\]', '', 'g'), 'WS+', ' ', 'g')), '([.!?])\s+([A-Z0-9''" + '"' + r"])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: len(string_split(x, ' ')) BETWEEN 7 AND 60)"


@query("c3_split_prose", f"SELECT doc_id, i AS sentence_id, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {PROSE.replace('WS', S.WS)} AS ss FROM documents))")
def c3(t: Tables):
    return splitting.split_sentences(t.documents.select("doc_id", "text"), "text", "prose")


WIKI = "concat('intro of ', conv_id, chr(10), '== ', role, ' ==', chr(10), replace(text, '. ', chr(10) || '=== Gameplay ===' || chr(10)))"


@query(
    "c4_split_sections",
    rf"""WITH x AS (SELECT conv_id * 1000 + turn AS page, {WIKI} AS body FROM conversations),
    l AS (SELECT page, i, trim(ls[i]) AS line FROM (SELECT page, string_split(body, chr(10)) AS ls, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM x)),
    h AS (SELECT *, nullif(coalesce(nullif(regexp_extract(line, '^==\s*([^=]+?)\s*==$', 1), ''), regexp_extract(line, '^===\s*([^=]+?)\s*===$', 1)), '') AS heading FROM l),
    s AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY page ORDER BY i), 'Lead') AS section FROM h)
    SELECT page, section, string_agg(line, chr(10) ORDER BY i) AS text FROM s WHERE heading IS NULL AND line <> '' GROUP BY 1, 2""",
)
def c4(t: Tables):
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), F.expr(WIKI.replace("chr(10)", "char(10)")).alias("body"))
    return splitting.split_sections(rows, "page", "body")


@query("c5_pick_description")
def c5(t: Tables):
    rows = t.documents.select(F.col("doc_id").alias("page"), F.concat(F.lit("== Gameplay ==\n"), "text").alias("body"))
    return splitting.pick_description(splitting.split_sections(rows, "page", "body"), "page", ["gameplay", "story"])


def prose(c: str) -> str:
    """SQL for the prose sentences of a value."""
    return PROSE.replace("WS", S.WS).replace("regexp_replace(text,", f"regexp_replace({c},")


WAYS = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '== Gameplay ==' WHEN 2 THEN '== Plot ==' ELSE '== Features of gameplay ==' END"
PARTS = ("substring(text, 1, 200)", "substring(text, 201, 400)", "substring(text, 601, 400)")
FIRST = "array_to_string(list_slice({}, 1, {}), ' ')"


@query(
    "c5_describe_pages",
    f"""WITH p AS (SELECT doc_id AS page, doc_id % 4 AS way, {PARTS[0]} AS a, {PARTS[1]} AS b, {PARTS[2]} AS c FROM documents),
       s AS (SELECT page, way, {prose("CASE WHEN way = 0 THEN a || chr(10) || chr(10) || b ELSE a END")} AS lead, CASE WHEN way = 0 THEN [] ELSE {prose("b")} END AS mid, {prose("c")} AS tail,
         {prose("a || chr(10) || " + "CASE way WHEN 0 THEN '' WHEN 1 THEN '== Gameplay ==' WHEN 2 THEN '== Plot ==' ELSE '== Features of gameplay ==' END" + " || chr(10) || b || chr(10) || '== Reception ==' || chr(10) || c")} AS whole FROM p),
       e AS (SELECT *, lead || mid || tail AS every FROM s),
       d AS (SELECT page, way, lead, whole, CASE WHEN way IN (1, 3) THEN mid ELSE [] END AS g, CASE WHEN way = 2 THEN mid ELSE [] END AS t,
         list_filter(every, lambda x: contains(lower(x), ' the ') OR contains(lower(x), ' die ')) AS gw, list_filter(every, lambda x: contains(lower(x), ' que ') OR contains(lower(x), ' und ')) AS tw FROM e)
       SELECT page, CASE WHEN len(lead) > 0 THEN {FIRST.format("lead", 2)} ELSE {FIRST.format("whole", 2)} END AS overview,
         CASE WHEN len(g) > 0 THEN {FIRST.format("g", 3)} WHEN len(gw) > 0 THEN {FIRST.format("gw", 3)} ELSE '{splitting.NO_GAMEPLAY}' END AS gameplay,
         CASE WHEN len(t) > 0 THEN {FIRST.format("t", 3)} WHEN len(tw) > 0 THEN {FIRST.format("tw", 3)} ELSE '{splitting.NO_STORY}' END AS story FROM d""",
)
def c5d(t: Tables):
    body = f"concat_ws(char(10), {PARTS[0]}, {WAYS}, {PARTS[1]}, '== Reception ==', {PARTS[2]})"
    rows = t.documents.select(F.col("doc_id").alias("page"), F.expr(body).alias("body"))
    return splitting.describe_pages(rows, "page", "body", (["gameplay"], [" the ", " die "]), (["plot", "story"], [" que ", " und "]))
