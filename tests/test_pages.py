"""Pages for names against a plain search over all pages."""

import difflib
import random
import re
import time

from reviewlake.operators import merging as M

TERMS = M.PageTerms(positive=("video game", "puzzle game"), negative=("film", "album"), kinds=("franchise",), suffixes=("video game", "series"))


def words(t, pattern):
    return re.sub(pattern, " ", t.lower()).strip()


def ascii_words(t):
    return words(t, "[^a-z0-9]+")


def all_words(t):
    return " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())


def similarity(a, b):
    plain = all(any(len(w) >= 4 for w in ascii_words(x).split()) for x in (a, b))
    f = ascii_words if plain else all_words
    return difflib.SequenceMatcher(None, f(a), f(b)).ratio()


def key(t):
    return re.sub(r"\s+", " ", t.lower().replace("_", " ")).strip()


def by_hand(entities, pages, floor=2.2, search_floor=6.0):
    likely = []
    for page, title, extract in pages:
        if not (title or "").strip() or not (extract or "").strip() or any(t in title.lower() for t in TERMS.negative):
            continue
        low = extract.strip().lower()
        if any(t in title.lower() for t in TERMS.kinds) or any(t in low[:1800] for t in TERMS.positive):
            says = any(t in (title + "\n" + extract[:1600]).lower() for t in TERMS.positive)
            likely.append((page, title, says, any(t in low[:1400] for t in TERMS.positive)))

    def best(name, alias, some):
        scored = [(4 * similarity(alias, t) + 2 * similarity(name, t) + 2 * says + any(f"({x})" in t.lower() for x in TERMS.suffixes), -p, early) for p, t, says, early in some]
        return max(scored, default=None)

    often = {}
    for title in {t for _, t, _, _ in likely}:
        for w in set(all_words(title).split()):
            often[w] = often.get(w, 0) + 1

    out = {}
    for entity, name, alias in entities:
        if not (name or "").strip():
            continue
        alias = name if alias is None else alias
        keys = {key(n + s) for n in (name, alias) for s in ("", *(f" ({x})" for x in TERMS.suffixes))}
        direct = best(name, alias, [x for x in likely if key(x[1]) in keys])
        if direct and (direct[0] >= floor or direct[2]):
            out[entity] = (-direct[1], direct[0], "direct")
            continue
        rare = set()
        for form in {name, alias}:
            ws = all_words(form).split()
            ws = [w for w in ws if len(w) >= 4] or ws
            rare |= set([min((w for w in ws if w in often), key=lambda w: (often[w], w))] if any(w in often for w in ws) else [])
        found = best(name, alias, [x for x in likely if rare & set(all_words(x[1]).split())])
        if found and found[0] >= search_floor:
            out[entity] = (-found[1], found[0], "search")
    return out


def some(seed, n):
    rng = random.Random(seed)
    vocabulary = ["portal", "half", "life", "the", "of", "война", "игра", "été", "go", "star", "craft", "stars", "crafting", "2", "ii", "x"]
    title = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4)))
    titles = [title() for _ in range(n)]
    entities = [(i, rng.choice(titles) if rng.random() < 0.5 else title(), rng.choice([None, None, title()])) for i in range(n)]
    pages = []
    for i in range(n * 2):
        t = rng.choice(titles) if rng.random() < 0.7 else title()
        t = rng.choice([t, t.title(), t.replace(" ", "_"), f"{t} (video game)", f"{t} (Series)", f"{t} (film)", f"{t} franchise", t + "s"])
        text = rng.choice(["", None, "A Video Game about it.", "x" * 1500 + " video game", "x" * 1700 + " puzzle game", "y" * 1900 + " puzzle game", "A river."])
        pages.append((i, rng.choice([t] * 20 + [None, "  "]), text))
    return entities + [(9_000, None, None), (9_001, " ", "portal"), (0 + 9_002, "Portal", None)], pages


def test_pages_are_those_of_a_plain_search(spark):
    for seed, n, floor in ((1, 120, 6.0), (2, 80, 4.0)):
        entities, pages = some(seed, n)
        a = spark.createDataFrame([(*e, 1, "t") for e in entities], "id long, name string, alias string, page long, title string")
        b = spark.createDataFrame([(*p, "n", 2) for p in pages], "page long, title string, extract string, name string, score long")
        rows = M.find_pages(a, b, "id", "name", "page", "title", "extract", TERMS, "alias", search_floor=floor).collect()
        got = {r["id"]: (r["page"], round(r["score"], 9), r["how"]) for r in rows}
        want = {k: (p, round(s, 9), h) for k, (p, s, h) in by_hand(entities, pages, search_floor=floor).items()}
        assert got == want and len(rows) == len(got)
        assert {h for _, _, h in got.values()} == {"direct", "search"}


def test_copies_do_not_multiply(spark):
    a = spark.createDataFrame([(i, "Portal", None) for i in range(300)], "id long, name string, alias string")
    b = spark.createDataFrame([(i, "portal", "a video game") for i in range(300)], "page long, title string, extract string")
    got = M.find_pages(a, b, "id", "name", "page", "title", "extract", TERMS, "alias").collect()
    assert len(got) == 300 and {(r["page"], r["score"], r["how"]) for r in got} == {(0, 8.0, "direct")}
    assert M.find_pages(a.limit(0), b, "id", "name", "page", "title", "extract", TERMS).count() == 0
    assert M.find_pages(a, b.limit(0), "id", "name", "page", "title", "extract", TERMS).count() == 0


POSITIVE, NEGATIVE = [r"\(video game\)", "remaster"], ["film", "soundtrack"]


def matched_by_hand(entities, pages, floor):
    long_words = lambda t: {w for f in (ascii_words, all_words) for w in f(t).split() if len(w) >= 4}
    out = {}
    for entity, name in entities:
        keys = long_words(name or "") or set(all_words(name or "").split())
        for page, title in pages:
            if not title or not keys & (long_words(title) | set(all_words(title).split())):
                continue
            bare = re.sub(r"\s*\([^)]*\)$", "", title)
            f = ascii_words if all(any(len(w) >= 4 for w in ascii_words(x).split()) for x in (name, title)) else all_words
            ratio = lambda t: difflib.SequenceMatcher(None, f(name), f(t)).ratio()
            says = lambda terms: any(re.search(t, title.lower()) for t in terms)
            score = 4 * ratio(title) + 2 * ratio(bare) + 2 * says(POSITIVE) - 3 * says(NEGATIVE) + (title != bare)
            out[entity] = max(out.get(entity, (score, -page)), (score, -page))
    return {e: (-p, s) for e, (s, p) in out.items() if s >= floor}


def odd_titles(rng, n):
    vocabulary = ["portal", "half", "life", "the", "of", "война", "игра", "été", "go", "stars", "starcraft", "crafting", "2", "ii", "film", "teauchâteau", "x" * 210]
    plain = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5)))
    dressed = lambda t: rng.choice([t] * 4 + [t.title(), t + "!", f"{t} (video game)", f"{t} (1998)", f"{t}(a b)", f"({t})", f"{t} ()", f"{t} remaster", t + "s", t.replace("a", "e")])
    base = [plain() for _ in range(n)]
    return [dressed(rng.choice(base) if rng.random() < 0.7 else plain()) for _ in range(n)] + [None, "", "!!", "(video game)", "go", "x" * 210]


def test_matches_are_those_of_a_plain_search(spark, monkeypatch):
    for seed, n, floor, block in ((1, 90, 4.0, 500), (2, 90, 5.5, 7), (3, 60, 1.0, 3), (4, 60, -3.0, 2)):
        monkeypatch.setattr(M, "BLOCK", block)
        rng = random.Random(seed)
        entities, pages = ([(i if i % 9 else 9, t) for i, t in enumerate(odd_titles(rng, n))] for _ in range(2))
        a = spark.createDataFrame([(*e, 1.0, "x") for e in entities], "page long, name string, score double, wide string")
        b = spark.createDataFrame([(*p, "n", 2) for p in pages], "page long, title string, name string, best long")
        rows = M.match_pages(a.withColumnRenamed("page", "id"), b, "id", "name", "page", "title", POSITIVE, NEGATIVE, floor).collect()
        assert {r["id"]: (r["page"], r["score"]) for r in rows} == matched_by_hand(entities, pages, floor)
        assert len({r["id"] for r in rows}) == len(rows) > 0


def test_matches_of_names_that_share_a_word_with_all(spark):
    rng = random.Random(5)
    names = [f"common {''.join(rng.choice('abcdefgh') for _ in range(40))}" for _ in range(3000)]
    a = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    game = (1, names[5] + " (video game)")
    b = spark.createDataFrame([*((i + 7, t) for i, t in enumerate(names)), game], "page long, title string")
    want = {}
    for i, t in enumerate(names):
        want |= matched_by_hand([(i, t)], [(i + 7, t), game], 4.0)
    start = time.monotonic()
    got = {r["id"]: (r["page"], r["score"]) for r in M.match_pages(a, b, "id", "name", "page", "title", POSITIVE, NEGATIVE).collect()}
    assert got == want and len({p for p, _ in got.values()}) > 2000
    assert time.monotonic() - start < 100  # nine million pairs share the word; compared one by one they take longer
