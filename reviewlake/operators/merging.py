"""Joins and merges of entity sources."""

from __future__ import annotations

import difflib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewlake.functions.text import overlap_title, wide_title
from reviewlake.operators.cleaning import blank
from reviewlake.session import materialize


def stacked(sources: list[DataFrame]) -> DataFrame:
    """All sources with their place in the list as `prio`; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("prio", F.lit(k)) for k, s in enumerate(sources)])


def merge_sources(sources: list[DataFrame], key: str) -> DataFrame:
    """First source wins: the row of each key from the earliest source, without a sort of the other columns."""
    rows = stacked(sources)
    rest = [c for c in rows.columns if c not in (key, "prio")]
    first = rows.groupBy(key).agg(F.min(F.struct("prio", *rest)).alias("r"))
    return first.select(key, "r.*").drop("prio")


def source_overlap(sources: list[DataFrame], key: str) -> DataFrame:
    """Per source: ids, new ones, those an earlier source has, and the unique ids so far."""
    ids = stacked([s.select(key).distinct() for s in sources])
    marked = ids.join(ids.groupBy(key).agg(F.min("prio").alias("first")), key)
    by = marked.groupBy("prio").agg(F.count("*").alias("ids"), F.count_if(F.col("prio") == F.col("first")).alias("new"))
    total = F.sum("new").over(W.orderBy("prio"))
    return by.select("prio", "ids", "new", (F.col("ids") - F.col("new")).alias("duplicate"), total.alias("unique_so_far"))


def patch_entities(base: DataFrame, patch: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Existing rows keep what they have; blank columns of `fill` come from the patch, and its other keys are added."""
    both = base.join(patch.select(key, *[F.col(c).alias(f"_{c}") for c in fill]), key, "full_outer")
    cols = [F.when(blank(F.col(c).cast("string")), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in base.columns]
    return both.select(cols)


def complete_entities(entities: DataFrame, allowed: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Allowed entities only, with a minimal record for those that have none."""
    known = entities.join(allowed.select(key).distinct(), key, "left_semi")
    missing = allowed.select(key).distinct().join(entities, key, "left_anti")
    return known.unionByName(missing.select(key, *[c.alias(n) for n, c in defaults.items()]), allowMissingColumns=True)


def enrich(entities: DataFrame, details: DataFrame, key: str, cols: list[str], tags: str | None = None, overwrite: bool = False) -> DataFrame:
    """Fill columns from details with success; blanks only unless overwrite. New tags come in where the entity lacks them."""
    new = details.where("success").select(key, *[F.col(c).alias(f"_{c}") for c in cols], *([F.col(tags).alias("_tags")] if tags else []))
    rows = entities.join(new, key, "left")

    def filled(c: str) -> Column:
        fresh = F.col(f"_{c}")
        take = ~blank(fresh.cast("string")) & (F.lit(overwrite) | blank(F.col(c).cast("string")))
        return F.when(take, fresh).otherwise(F.col(c)).alias(c)

    out = [filled(c) if c in cols else F.col(c) for c in entities.columns if c != tags]
    if tags:
        old = F.coalesce(tags, F.create_map().cast("map<string,double>"))
        extra = F.map_filter(F.coalesce("_tags", F.create_map().cast("map<string,double>")), lambda k, v: ~F.map_contains_key(old, k))
        out.append(F.map_concat(old, extra).alias(tags))
    return rows.select(out)


def entity_metadata(entities: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """positive, negative, rate and label_source: counts of reviews where there are any, else the record's own."""
    rows = entities.join(counts.select(key, F.col("positive").alias("_p"), F.col("negative").alias("_n")), key, "left")
    seen = F.coalesce(F.col("_p") + F.col("_n"), F.lit(0)) > 0
    p, n = F.when(seen, F.col("_p")).otherwise(F.col("positive")), F.when(seen, F.col("_n")).otherwise(F.col("negative"))
    source = F.when(seen, "reviews").when((p + n) > 0, "record").otherwise("none")
    return rows.select(key, p.alias("positive"), n.alias("negative"), F.when(p + n > 0, p / (p + n)).alias("rate"), source.alias("label_source"))


def build_treebank(sentences: DataFrame, phrases: DataFrame, scores: DataFrame, splits: DataFrame) -> DataFrame:
    """(sentence_index, sentence, score, split): text to phrase to score; a repeated phrase counts with its last id; misses have no score."""
    ids = phrases.groupBy("phrase").agg(F.max("phrase_id").alias("phrase_id"))
    names = F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("dev")), F.col("split_code").cast("int"))
    rows = sentences.join(ids, sentences["sentence"] == ids["phrase"], "left").join(scores, "phrase_id", "left").join(splits, "sentence_index")
    return rows.select("sentence_index", "sentence", "score", names.alias("split"))


def match_entities(a: DataFrame, b: DataFrame, key_a: str, name_a: str, key_b: str, name_b: str, aliases: DataFrame | None = None) -> DataFrame:
    """(key_b, key_a): by equal normalised name, else by a vetted alias (alias, name); the first of each wins."""
    left = a.select(key_a, overlap_title(F.col(name_a)).alias("_name")).groupBy("_name").agg(F.min(key_a).alias(key_a))
    right = b.select(key_b, overlap_title(F.col(name_b)).alias("_name"))
    hit = right.join(left, "_name", "left")
    if aliases is not None:
        via = aliases.select(overlap_title(F.col("alias")).alias("_name"), overlap_title(F.col("name")).alias("_real"))
        via = via.join(left.select(F.col("_name").alias("_real"), F.col(key_a).alias("_via")), "_real").groupBy("_name").agg(F.min("_via").alias("_via"))
        hit = hit.join(via, "_name", "left").withColumn(key_a, F.coalesce(key_a, "_via"))
    return hit.where(F.col(key_a).isNotNull()).groupBy(key_a).agg(F.min(key_b).alias(key_b))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each place of b."""
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full = free = (1 << len(b)) - 1
    for c in a:
        hit = free & at.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()


def _ratio(a: str, b: str) -> float:
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def _ratio_bound(a: str, b: str) -> float:
    """The blocks that a ratio counts are one common subsequence, so that the longest one bounds it."""
    return 1.0 if a == b else 2 * _common(a, b) / (len(a) + len(b))


def _page_score(name: pd.Series, title: pd.Series, bare: pd.Series, plus: pd.Series, minus: pd.Series, bracket: pd.Series, least: pd.Series) -> pd.Series:
    """The score where it can reach `least`, else null."""

    def score(n: str, t: str, b: str, p: int, m: int, k: int, enough: float) -> float | None:
        extra = p - m + k - enough + 1e-9
        s = _ratio_bound(n, t)
        if 4 * s + 2 * (s if t == b else _ratio_bound(n, b)) + extra < 0:
            return None
        s = _ratio(n, t)
        return 4 * s + 2 * (s if t == b else _ratio(n, b)) + p - m + k

    return pd.Series([score(*row) for row in zip(name, title, bare, plus, minus, bracket, least)], dtype="float64")


#: Names and titles of a word that meet in one group.
BLOCK = 500


def match_pages(entities: DataFrame, pages: DataFrame, entity: str, name: str, page: str, title: str, positive: list[str], negative: list[str], floor: float = 4.0) -> DataFrame:
    """(entity, page, score): the best page among those that share a title word of four letters and more.

    A name without such a word meets the pages that share any word. Titles are compared in ASCII if both have a word
    of four ASCII letters or digits, else in letters of all scripts.
    score = 4 x title similarity + 2 x similarity without a trailing bracket + 2 for a positive term - 3 for a
    negative one + 1 for a bracket; the smaller page settles ties; below floor there is no match.

    Titles that are compared alike are one row, and so are names. Titles equal to a name, with or without their bracket, are
    scored first; then only titles whose terms and bracket leave room for a better score meet the name by a shared word.
    """
    from pyspark.sql.types import DoubleType

    spark = entities.sparkSession
    scored = F.pandas_udf(_page_score, DoubleType())
    longer = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) >= 4)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    in_ascii = lambda c: F.size(longer(F.col(c))) > 0
    both = lambda c: F.concat(longer(F.col(c[0])), longer(F.col(c[1])))

    named = entities.select(F.col(entity).alias("entity"), wide_title(F.col(name)).alias("wide"), overlap_title(F.col(name)).alias("plain"))
    named = materialize(named.where("wide <> ''"), "pages-entities")
    names = named.select("wide", "plain").distinct().withColumn("ascii", in_ascii("plain"))
    names = names.withColumn("name", F.when(F.col("ascii"), F.col("plain")).otherwise(F.col("wide")))

    bare = F.regexp_replace(F.col(title), r"\s*\([^)]*\)$", "")
    says = lambda terms: F.lit(False) if not terms else F.lower(F.col(title)).rlike("|".join(terms))
    extras = [F.when(says(positive), 2).otherwise(0).alias("plus"), F.when(says(negative), 3).otherwise(0).alias("minus"), F.when(F.col(title) != bare, 1).otherwise(0).alias("bracket")]
    kinds = ["plus", "minus", "bracket"]
    forms = {"t_wide": wide_title(F.col(title)), "t_plain": overlap_title(F.col(title)), "b_wide": wide_title(bare), "b_plain": overlap_title(bare)}
    titles = pages.select(*[c.alias(n) for n, c in forms.items()], *extras, (-F.col(page)).alias("page")).where("t_wide <> ''")
    titles = materialize(titles.groupBy(*forms, *kinds).agg(F.max("page").alias("page")), "pages-titles")

    # equal ones: a name in ASCII only equals titles in ASCII; of titles that differ in other scripts only, the smallest page will do
    as_plain = F.when(in_ascii("t_plain"), F.struct(F.lit(True).alias("ascii"), F.col("t_plain").alias("title"), F.col("b_plain").alias("bare")))
    as_wide = F.struct(F.lit(False).alias("ascii"), F.col("t_wide").alias("title"), F.col("b_wide").alias("bare"))
    alike = titles.select(F.explode(F.array(as_plain, as_wide)).alias("f"), *kinds, "page").where("f is not null").select("f.*", *kinds, "page")
    alike = alike.groupBy("ascii", "title", "bare", *kinds).agg(F.max("page").alias("page")).withColumn("name", F.explode(F.array_distinct(F.array("title", "bare"))))
    equal = alike.join(names.select("ascii", "name").distinct(), ["ascii", "name"]).withColumn("score", scored("name", "title", "bare", *kinds, F.lit(float("-inf"))))
    equal = equal.groupBy("ascii", "name").agg(F.max(F.struct("score", "page")).alias("best"))
    known = materialize(names.join(equal, ["ascii", "name"], "left").select("wide", "plain", "ascii", "best"), "pages-equal")

    # others: their similarities are below 1
    level = F.col("plus") - F.col("minus") + F.col("bracket")
    levels = [r["level"] for r in titles.select(level.alias("level")).distinct().collect()]  # seven at most
    least = F.greatest(F.lit(float(floor)), F.col("best.score"))
    room = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x + 6 > F.col("least"))
    of_name = F.when(F.size(both(("plain", "wide"))) > 0, both(("plain", "wide"))).otherwise(words(F.col("wide")))
    of_title = F.concat(longer(F.col("t_plain")), words(F.col("t_wide")))
    asked = known.withColumn("least", least).withColumn("level", F.explode(room)).withColumn("asks", F.array_distinct(of_name)).withColumn("word", F.explode("asks"))
    posted = titles.withColumn("level", level).withColumn("holds", F.array_distinct(of_title)).withColumn("word", F.explode("holds"))
    blocks = lambda df, n: df.groupBy("word", "level").agg(F.ceil(F.count("*") / BLOCK).alias(n))
    blocks = blocks(asked, "n_of").join(blocks(posted, "t_of"), ["word", "level"])
    at = ["word", "level", "n_block", "t_block"]
    asked = asked.join(blocks, ["word", "level"]).withColumn("n_block", F.pmod(F.xxhash64("wide"), "n_of")).withColumn("t_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_of") - 1))).drop("n_of", "t_of", "best")
    posted = posted.join(blocks, ["word", "level"]).withColumn("t_block", F.pmod(F.xxhash64(*forms, *kinds), "t_of")).withColumn("n_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_of") - 1))).drop("n_of", "t_of")
    met = asked.join(posted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *at), at)
    plain = F.col("ascii") & in_ascii("t_plain")
    pick = lambda a, b: F.when(plain, F.col(a)).otherwise(F.col(b))
    met = met.select("wide", pick("plain", "wide").alias("name"), pick("t_plain", "t_wide").alias("title"), pick("b_plain", "b_wide").alias("bare"), *kinds, "page", "least", "word", "asks", "holds")
    reach = lambda c: 2 * F.least(F.length("name"), F.length(c)) / (F.length("name") + F.length(c))
    met = met.where(4 * reach("title") + 2 * reach("bare") + level + 1e-9 >= F.col("least")).where(F.col("word") == F.array_min(F.array_intersect("asks", "holds")))
    near = met.withColumn("score", scored("name", "title", "bare", *kinds, "least")).where("score is not null").groupBy("wide").agg(F.max(F.struct("score", "page")).alias("best"))

    best = known.where("best is not null").select("wide", "best").unionByName(near).groupBy("wide").agg(F.max("best").alias("best"))
    found = named.join(best, "wide").groupBy("entity").agg(F.max("best").alias("best")).where(F.col("best.score") >= floor)
    return found.select(F.col("entity").alias(entity), (-F.col("best.page")).alias(page), "best.score")


def _pruned_ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio where it can reach `least`, else 0: lengths and then counts of letters bound it from above."""

    def ratio(x: str, y: str, t: float) -> float:
        m = difflib.SequenceMatcher(None, x or "", y or "")
        return m.ratio() if m.real_quick_ratio() >= t and m.quick_ratio() >= t else 0.0

    return pd.Series([ratio(*row) for row in zip(a, b, least)], dtype="float64")


@dataclass(frozen=True)
class PageTerms:
    """Words that tell the wanted pages: in their text, against them in the title, for them in the title, and what titles may add to a name."""

    positive: tuple[str, ...]
    negative: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()

    @staticmethod
    def has(text: Column, terms: tuple[str, ...]) -> Column:
        return reduce(lambda c, t: c | F.contains(text, F.lit(t)), terms, F.lit(False))


def title_key(title: Column) -> Column:
    """Lower case, underscores as spaces, runs of white space as one."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(title, "_", " ")), r"\s+", " "))


def find_pages(entities: DataFrame, pages: DataFrame, entity: str, name: str, page: str, title: str, extract: str, terms: PageTerms, alias: str | None = None, floor: float = 2.2, search_floor: float = 6.0) -> DataFrame:
    """(entity, page, score, how): each entity's best page among the likely ones.

    A page is likely when its title has no negative term and names a kind, or its first 1800 characters have a positive
    term. `direct` pages have the name, or the alias, or one of these and a suffix in brackets, as their title. Entities without one
    are looked for by `search`: among likely pages that share the name's or the alias's word on the fewest titles (of four letters
    and more, where there are such), with search_floor at least. score = 4 x similarity of title and alias (the name where there is none) + 2 x
    similarity of title and name + 2 for a positive term in title and first 1600 characters + 1 for a suffix in brackets; the smaller page settles ties. A best page below floor without a positive term in its first 1400
    characters is none. Null or blank names, titles and extracts match nothing.

    Equal titles are one row with their best page, equal names one row, so neither copies of pages nor of names multiply.
    """
    low = F.lower(F.trim(F.coalesce(extract, F.lit(""))))
    raw = F.lower(F.concat(F.col(title), F.lit("\n"), F.substring(F.coalesce(extract, F.lit("")), 1, 1600)))
    lower = F.lower(F.col(title))
    likely = PageTerms.has(lower, terms.kinds) | PageTerms.has(F.substring(low, 1, 1800), terms.positive)
    brackets = tuple(f"({s})" for s in terms.suffixes)
    rows = pages.where((F.trim(F.coalesce(title, F.lit(""))) != "") & (low != "") & ~PageTerms.has(lower, terms.negative) & likely)
    rows = rows.select(F.col(page).alias("page"), F.col(title).alias("title"), PageTerms.has(raw, terms.positive).alias("says"), PageTerms.has(F.substring(low, 1, 1400), terms.positive).alias("early"))
    best = rows.groupBy("title").agg(F.max(F.struct("says", (-F.col("page")).alias("p"), "early")).alias("b"))
    bonus = F.when(F.col("b.says"), 2).otherwise(0) + F.when(PageTerms.has(F.lower("title"), brackets), 1).otherwise(0)
    best = materialize(best.select("title", title_key(F.col("title")).alias("key"), (-F.col("b.p")).alias("page"), F.col("b.early").alias("early"), bonus.alias("bonus")), "pages-likely")

    known_as = F.coalesce(F.col(alias), F.col(name)) if alias else F.col(name)
    named = entities.select(F.col(entity), F.col(name).alias("name"), known_as.alias("alias")).where(F.trim("name") != "")
    names = materialize(named.select("name", "alias").distinct(), "pages-names")
    forms = F.array_distinct(F.flatten(F.transform(F.array("alias", "name"), lambda n: F.concat(F.array(n), *[F.array(F.concat(n, F.lit(f" {b}"))) for b in brackets]))))
    keys = names.select("name", "alias", F.explode(F.array_distinct(F.transform(forms, title_key))).alias("key"))
    direct = _best_page(keys.join(best, "key"), None, floor).withColumn("how", F.lit("direct"))
    direct = materialize(direct, "pages-direct")

    rest = names.join(direct.select("name", "alias"), ["name", "alias"], "left_anti")
    words = lambda c: F.filter(F.array_distinct(F.split(wide_title(c), " ")), lambda w: w != "")
    longer = lambda c: F.when(F.exists(words(c), lambda w: F.length(w) >= 4), F.filter(words(c), lambda w: F.length(w) >= 4)).otherwise(words(c))
    posted = best.select("title", F.explode(words(F.col("title"))).alias("word"))
    often = posted.groupBy("word").agg(F.count("*").alias("n"))
    asked = rest.select("name", "alias", F.explode(F.array_distinct(F.array("name", "alias"))).alias("form")).select("name", "alias", "form", F.explode(longer(F.col("form"))).alias("word"))
    rarest = asked.join(often, "word").groupBy("name", "alias", "form").agg(F.min(F.struct("n", "word")).alias("w")).select("name", "alias", F.col("w.word").alias("word")).distinct()
    met = rarest.join(posted, "word").select("name", "alias", "title").distinct().join(best, "title")
    found = direct.unionByName(_best_page(met, search_floor, max(floor, search_floor)).withColumn("how", F.lit("search")))
    return named.join(found, ["name", "alias"]).select(entity, F.col("page").alias(page), "score", "how")


def _best_page(pairs: DataFrame, need: float | None, floor: float) -> DataFrame:
    """The best page of each (name, alias). With need, pairs whose score can't reach it are not compared."""
    from pyspark.sql.types import DoubleType

    ratio = F.pandas_udf(_pruned_ratio, DoubleType())
    with_ascii = lambda c: F.exists(F.split(overlap_title(F.col(c)), " "), lambda w: F.length(w) >= 4)
    both = {c: with_ascii(c) & with_ascii("title") for c in ("name", "alias")}
    # 4 x one + 2 x other + bonus >= need, with ratios of 1 at most
    least = {"alias": (F.lit(need) - 2 - F.col("bonus")) / 4, "name": (F.lit(need) - 4 - F.col("bonus")) / 2} if need is not None else dict.fromkeys(both, F.lit(0.0))
    sim = lambda c: ratio(*[F.when(both[c], overlap_title(F.col(x))).otherwise(wide_title(F.col(x))) for x in (c, "title")], least[c].cast("double") - 1e-9)
    scored = pairs.withColumn("score", 4 * sim("alias") + 2 * sim("name") + F.col("bonus"))
    top = scored.groupBy("name", "alias").agg(F.max(F.struct("score", (-F.col("page")).alias("p"), "early")).alias("b"))
    good = (F.col("b.score") >= floor) | (F.col("b.early") & F.lit(need is None))
    return top.where(good).select("name", "alias", (-F.col("b.p")).alias("page"), F.col("b.score").alias("score"))


def genre_catalog(games: DataFrame, bridge: DataFrame, game: str, genre: str) -> DataFrame:
    """Each game with its genres joined by |, in order; blank where it has none."""
    names = bridge.groupBy(game).agg(F.array_join(F.array_sort(F.collect_set(F.col(genre).cast("string"))), "|").alias("genres"))
    return games.join(names, game, "left").withColumn("genres", F.coalesce("genres", F.lit("")))


def fan_out(samples: DataFrame, bridge: DataFrame, game: str) -> DataFrame:
    """Every sample once for each genre of its game, once with null where it has none."""
    return samples.join(bridge, game, "left")


def align(features: DataFrame, *labels: DataFrame, key: str) -> DataFrame:
    """Features of entities that all label tables have."""
    return reduce(lambda df, other: df.join(other.select(key).distinct(), key, "left_semi"), labels, features)


def variant_pairs(df: DataFrame, entity: str, variant: str) -> DataFrame:
    """(entity, a, b): unordered pairs of an entity's variants. Variants of an entity are few."""
    x, y = df.select(entity, F.col(variant).alias("a")).distinct(), df.select(entity, F.col(variant).alias("b")).distinct()
    return x.join(y, entity).where("a < b")


def dedupe_entities(df: DataFrame, name: str, key: str, genre: str) -> DataFrame:
    """Per name the first id and all genres, joined by |."""
    return df.groupBy(name).agg(F.min(key).alias(key), F.array_join(F.array_sort(F.collect_set(genre)), "|").alias("genres"))


def flag_duplicates(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Add seen_before (an earlier row has the key), name_repeats and numeric_name."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    names = df.groupBy(name).agg((F.count("*") > 1).alias("name_repeats"))
    return df.join(first, key).join(names, name).select(
        *df.columns, (F.col(order) > F.col("_first")).alias("seen_before"), "name_repeats", F.col(name).rlike("^[0-9]+$").alias("numeric_name")
    )


def set_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): keys of a that b lacks as `missing`, and the other way round as `extra`."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.subtract(y).withColumn("side", F.lit("missing")).unionByName(y.subtract(x).withColumn("side", F.lit("extra")))


def sync_column(old: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """Fill blank values of one column from a newer source."""
    rows = old.join(new.select(key, F.col(col).alias("_new")), key, "left")
    return rows.select(*[F.when(blank(F.col(c)), F.col("_new")).otherwise(F.col(c)).alias(c) if c == col else c for c in old.columns])
