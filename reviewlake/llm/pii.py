"""Personal data, and the terms that give it away.

Addresses and numbers are found by patterns; each value is a protected entity. A term in the line beside an entity
discloses it when seeing the term tells almost as much as seeing the entity: with document counts over the whole
corpus, pointwise mutual information of at least ALPHA times the entity's information content (Sanchez and Batet,
2016). Such a term must stand beside the entity in SUPPORT documents and as many different surroundings, so that
copies of one passage prove nothing. Such a term becomes a span wherever it stands, in documents without the entity
too, except inside an entity; sanitising replaces spans by their kind.

All of this runs in built-in functions. Defined results: null and empty texts have no spans; repeated rows get equal
results, and count as documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.llm.spans import SPANS, blanked, chunks, count_kind, cut, find, named, redacted, spelled, with_matches
from reviewlake.session import materialize

ALPHA = 0.9
SUPPORT = 3
REACH = 64
FEW_TERMS = 100_000
TERM = r"[\p{L}\p{N}]{3,}+"


def octets(value: Column) -> Column:
    return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of 10."""

    def total(d: Column) -> Column:
        n = F.length(d)
        doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))

    d = digits(value)
    return F.when(F.length(d).between(12, 19), total(d) % 10 == 0).otherwise(False)


#: kind -> (pattern, test of a match). Runs are possessive and start where a run starts or the last match ended.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(digits(v)).between(9, 15)),
}
NAMES = [*KINDS, "term"]


def _surroundings(chunked: Column, s: Column, reach: int) -> Column:
    """Terms in the reach characters to each side of a span in its line; words cut off are left out."""
    left = F.regexp_extract(cut(chunked, F.greatest(s["start"] - reach, F.lit(0)), F.least(s["start"], F.lit(reach))), r"[^\n]*+$", 0)
    right = F.regexp_extract(cut(chunked, s["end"], F.lit(reach)), r"^[^\n]*+", 0)
    before = F.filter(find(left, TERM), lambda t: (t["start"] > 0) | (F.length(left) < reach))
    after = F.filter(find(right, TERM), lambda t: (t["end"] < F.length(right)) | (F.length(right) < reach))
    return F.struct(
        s["kind"].alias("kind"),
        F.when(s["kind"].isin(2, 3), digits(s["value"])).otherwise(F.lower(s["value"])).alias("entity"),
        F.xxhash64(left, right).alias("around"),
        F.transform(F.concat(before, after), lambda t: F.lower(t["value"])).alias("terms"),
    )


def find_entities(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """row, doc_id, base spans, the terms around each, and the text with the spans blanked."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = with_matches(rows, "text", KINDS, "base")
    terms = F.when(F.size("base") > 0, named(chunks(F.col("text")), lambda c: F.transform("base", lambda s: _surroundings(c, s, reach))))
    return materialize(found.select("row", "doc_id", "base", terms.alias("mentions"), blanked(F.col("text"), F.col("base")).alias("open")), "pii-found")


def disclosing_terms(docs: DataFrame, found: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(kind, entity, term, disclosure) of the terms that reveal an entity."""
    mentions = found.where("mentions is not null").select("row", F.explode("mentions").alias("m"))
    beside = mentions.select("row", "m.kind", "m.entity", "m.around", F.explode("m.terms").alias("term"))
    key = ["kind", "entity", "term"]
    seen = beside.groupBy(*key, "around").agg(F.min("row").alias("row")).groupBy(*key).agg(F.count("*").alias("places")).where(F.col("places") >= support)
    both = beside.select(*key, "row").distinct().groupBy(*key).agg(F.count("*").alias("n_both"))
    # a term is in as many documents at least as it stands beside any entity: that settles most common words uncounted
    total = found.count()
    n_entity = mentions.select("row", "m.kind", "m.entity").distinct().groupBy("kind", "entity").agg(F.count("*").alias("n_entity"))
    at_least = beside.select("term", "row").distinct().groupBy("term").agg(F.count("*").alias("n_least"))
    shared = lambda n_term: F.log(F.col("n_both") * float(total) / (n_term * F.col("n_entity")))
    content = F.log(F.lit(float(total)) / F.col("n_entity"))
    pairs = both.where(F.col("n_both") >= support).join(seen, key).join(n_entity, ["kind", "entity"]).join(at_least, "term")
    pairs = materialize(pairs.where((content > 0) & (shared(F.col("n_least")) >= alpha * content - 1e-9)).select(*key, "n_both", "n_entity"), "pii-pairs")
    none = pairs.withColumn("disclosure", F.lit(0.0)).select(*key, "disclosure").where("false")
    if pairs.isEmpty():
        return none
    wanted = materialize(pairs.select("term").distinct(), "pii-terms")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    few = is_few(wanted)  # these go to all tasks; more of them meet words that each task has counted, so no word is shuffled row by row
    n_term = (words.join(F.broadcast(wanted), "term", "left_semi") if few else words).groupBy("term").agg(F.count("*").alias("n_term"))
    n_term = n_term if few else n_term.join(wanted, "term", "left_semi")
    scored = pairs.join(n_term, "term").withColumn("disclosure", shared(F.col("n_term")) / content)
    return materialize(scored.where(F.col("disclosure") >= alpha).select(*key, "disclosure"), "pii-disclosing")


def is_few(terms: DataFrame) -> bool:
    """Whether terms may be broadcast: FEW_TERMS rows at most."""
    return terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS


def find_private(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, reach: int = REACH) -> DataFrame:
    """row, doc_id, base (spans of the patterns) and spans (those and disclosing terms)."""
    found = find_entities(docs, reach)
    reveals = disclosing_terms(docs, found, alpha, support).select("term").distinct()
    reveals = F.broadcast(reveals) if is_few(reveals) else reveals
    words = found.select("row", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("open", F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))).alias("term"))
    present = materialize(words.join(reveals, "term", "left_semi").groupBy("row").agg(F.collect_list("term").alias("terms")), "pii-present")
    hits = find(F.col("open"), TERM, lambda w: F.array_contains("terms", F.lower(w)))
    span = lambda t: F.struct(t["start"].alias("start"), F.lit(NAMES.index("term")).alias("kind"), t["end"].alias("end"), F.lower(t["value"]).alias("value"))
    extra = found.select("row", "open").join(present, "row").select("row", F.transform(hits, span).cast(SPANS).alias("extra"))
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPANS))))
    return found.select("row", "doc_id", "base").join(extra, "row", "left").select("row", "doc_id", "base", spans.alias("spans"))


def private_report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, and all spans."""
    found = find_private(docs, **parameters)
    return found.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(spelled(F.col("base"), NAMES), 256).alias("base_sha256"), spelled(F.col("spans"), NAMES).alias("spans"),
    )


def sanitised(docs: DataFrame, **parameters) -> DataFrame:
    """docs with the spans in text replaced; rows of equal doc_id and text share their spans, null ids included."""
    key = [F.col("doc_id"), F.sha2("text", 256)]
    spans = find_private(docs.select(F.struct(*key).alias("doc_id"), "text"), **parameters).where(F.size("spans") > 0)
    spans = spans.groupBy("doc_id").agg(F.first("spans").alias("_spans")).select(F.col("doc_id.*"), "_spans").toDF("_doc_id", "_sha2", "_spans")
    text = redacted(docs["text"], F.coalesce("_spans", F.array().cast(SPANS)), NAMES)
    on = docs["doc_id"].eqNullSafe(spans["_doc_id"]) & (F.sha2(docs["text"], 256) == spans["_sha2"])
    return docs.join(spans, on, "left").select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
