"""Operators on single texts against plain Python."""

import random
import re
import unicodedata
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlake.llm import bpe, langid, mixing, packing, pii, quality, secrets

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("report, kinds", [(pii.private_report, brute.PII), (secrets.secrets_report, brute.SECRETS)])
def test_spans_are_those_of_the_patterns(docs, texts, empty, odd, report, kinds):
    got = {r["doc_id"]: r for r in report(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        spans = brute.base_spans(t, kinds)
        assert got[i]["base_sha256"] == brute.digest(spans), (i, t)
        for name, _, _ in kinds:
            assert got[i][f"n_{name}"] == sum(s[0] == name for s in spans)
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in spans).split(",")) <= {*got[i]["spans"].split(","), ""}
    assert report(empty).count() == 0 and report(odd).count() == odd.count()


def test_random_strings_are_found_and_words_are_not(docs, texts, spark):
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets_report(docs).collect()}
    keys = [i for i, t in texts if t and t.startswith("k = ")]
    assert all("random" in got[i] for i in keys)
    assert not any("random" in s for i, s in got.items() if i not in keys)


def test_secrets_leave_the_text(docs, texts):
    for r in secrets.without_secrets(docs).collect():
        spans = brute.base_spans(r["text"], brute.SECRETS)
        assert not spans, r["text"]
    clean = {r["doc_id"]: r["text"] for r in secrets.without_secrets(docs).collect()}
    assert clean[3] == "one" and clean[0] is None


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(1)
    noise = lambda: " ".join(f"n{rng.randrange(400)}" for _ in range(12))
    rows = [(i, f"{noise()} zyxquark the boss@corp.example.com wrote {noise()}") for i in range(6)]
    rows += [(100 + i, f"{noise()} the x{i}@mail.example.com {noise()}") for i in range(200)] + [(500 + i, f"the {noise()}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.private_report(df).collect()}
    where = rows[0][1].index("zyxquark")
    assert f"term:{where}:{where + 8}" in got[0].split(",")
    assert not any("term" in s for i, s in got.items() if i >= 100)
    assert "zyxquark" not in pii.sanitised(df).where("doc_id = 0").first()["text"]


def test_terms_are_spans_away_from_their_entity(spark):
    """In another paragraph, beyond any window, glued to the entity, in other case, and in a document without it."""
    rng = random.Random(2)
    noise = lambda: " ".join(f"n{rng.randrange(400)}" for _ in range(12))
    rows = [(i, f"Zyxquark said\n\n{noise()} {noise()} zyxquark the +1 555 010 9999zyxquark the {noise()} {noise()} ZYXQUARK") for i in range(6)]
    rows += [(6, f"{noise()} zyxquark"), (7, f"zyxquarks {noise()} a@b.co")] + [(100 + i, f"the {noise()}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.private_report(df).collect()}
    for i, text in rows[:7]:
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer("zyxquark", text, re.I)}
        assert want == {s for s in got[i].split(",") if s.startswith("term")}, i
    assert not any("term" in s for i, s in got.items() if i >= 7)
    assert not any("zyxquark" in r["text"].lower() for r in pii.sanitised(df).where("doc_id < 7").collect())


def test_quality_measures(docs, texts, empty, odd):
    got = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) for k in range(3) if g[tuple(w[i : i + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    kept = {r["doc_id"] for r in quality.filter_quality(docs).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert quality.filter_quality(docs).columns == docs.columns
    assert quality.quality_report(empty).count() == 0 and quality.quality_report(odd).count() == odd.count()


def test_combining_marks_count_as_letters(spark):
    hindi = "यह किताब बहुत अच्छी है और मैं इसे सभी मित्रों को पढ़ने की सलाह देता हूँ क्योंकि इसकी कहानी सुंदर है".split()
    accented = unicodedata.normalize("NFD", "ầếộữ ằễớự")
    texts = [" ".join(random.Random(4).choices(hindi, k=80)), accented + " कि", "1234 5678 9a"]
    assert [quality.few_letters(quality.Text(t)) for t in texts] == [False, False, True]
    got = quality.filter_quality(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"))
    assert got.count() == 1


def test_order_of_rules_is_by_rejection_per_cost():
    rows = [{"rule": "shouting", "rejected": 1, "seconds": 1.0}, {"rule": "word_length", "rejected": 9, "seconds": 1.0}]
    assert quality.order_rules(rows, [quality.shouting, quality.word_length]) == [quality.word_length, quality.shouting]


def test_token_counts_are_the_librarys(docs, texts, empty, odd):
    tok = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.token_counts(docs).collect()}
    for i, t in texts:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)
    assert bpe.token_counts(empty).count() == 0 and bpe.token_counts(odd).count() == odd.count()


def test_token_counts_of_odd_characters():
    tok, count = Tokenizer.from_file(PATH), bpe.token_counter(PATH)
    ids = packing.id_maker(PATH)
    rng = random.Random(2)
    letters = "aAé Éß'’sStT09²½ \n\t\x1c\x85İıſ中😀!.,-_́" + "ﬁ"
    for k in range(2000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + ("<|endoftext|>" if k % 7 == 0 else "")
        want = tok.encode(s, add_special_tokens=False).ids
        assert count(s) == len(want), s
        assert ids(s) == np.array(want, "<u4").tobytes(), s


def test_packing_keeps_every_token(docs, texts, empty, odd):
    tok = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            r, part = pieces.pop((i, k // 4096)), ids[k : k + 4096]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not pieces
    check_places(rows, 4096)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 4096) + 2
    assert packing.pack_documents(empty).count() == 0
    check_places(packing.pack_documents(odd).collect(), 4096)


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity


def test_large_items_are_matched_best():
    rng = random.Random(4)
    for _ in range(200):
        counts = dict(Counter(rng.randint(34, 100) for _ in range(rng.randint(1, 60))))
        bins = 1 + max(b + -(-n // each) - 1 for _, _, n, b, each, _ in packing.pack_lengths(counts, 100))
        items, best = sorted(Counter(counts).elements()), 0
        while items:  # the greedy pairing of two pointers is optimal when at most two fit
            a = items.pop()
            fit = [k for k, x in enumerate(items) if a + x <= 100]
            if fit:
                items.pop(fit[-1])
            best += 1
        assert bins == best


def test_mix(docs, texts, empty, odd):
    rows = mixing.mix_report(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts}
    by = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    assert abs(sum(x[0]["target"] for x in by.values()) - 1.5 * sum(sizes.values())) < 1e-6
    weights = dict(zip(["a", "b", "c", None], (3, 1, 2, 3)))
    levels = {x[0]["target"] / weights[s] for s, x in by.items() if x[0]["target"] < 2 * sizes[s] - 1e-9}
    assert max(levels) - min(levels) < 1e-6
    for s, x in by.items():
        assert x[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows if r["size"]} | {}) + Counter(
        {r["doc_id"]: n for r in mixing.mix_sources(docs).where("size = 0").collect() if (n := r["copies"])}
    )
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_report(odd).count() == odd.count()


def test_languages(spark, empty, odd):
    rng = random.Random(5)
    words = {"en": "the and of is with that river stone".split(), "fr": "les des une avec être rivière pierre où".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "123 456", "fr"), (902, "", None), (903, "the river and the stone", None)]
    got = {r["doc_id"]: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, lang in rows[:120]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["lang_pred"] == lang and 0.5 <= got[i]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert langid.identify_languages(empty).count() == 0 and langid.identify_languages(odd).count() == odd.count()


def test_forward_sum_is_over_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    p = np.array([[0.1], [0.2], [0.15], [0.25], [0.2], [0.1]])
    model = langid.PieceModel(pieces, p)
    at = dict(zip(pieces, p[:, 0]))

    def ways(s):
        return 1.0 if not s else sum(at[s[:k]] * ways(s[k:]) for k in range(1, len(s) + 1) if s[:k] in at)

    assert abs(np.exp(model.log_probabilities(["abab", "ba"])[0, 0]) - ways("▁abab")) < 1e-15
    uses = model.expected_uses(["abab"], np.array([2.0]), 0)
    assert abs(sum(len(k) * n for k, n in zip(pieces, uses)) - 10) < 1e-9


def test_battery_is_the_measures():
    """Scores of the simulated nulls: text is not discovered, random strings are, whatever the encoding and length."""
    for name, alphabet in secrets.ENCODINGS.items():
        rng = np.random.default_rng(3)
        codes, kinds = secrets.drawn(rng, alphabet, 33, "capitals")
        x = codes[0]
        c = Counter(x.tolist())
        mean = x.mean()
        want = [
            sum(v * v - v for v in c.values()) / (33 * 32), sum(a != b for a, b in zip(kinds[0], kinds[0][1:])) / 32,
            sum((x[i] - mean) * (x[(i + 1) % 33] - mean) for i in range(33)) / sum((x - mean) ** 2),
        ]
        assert np.allclose(secrets.measures(codes, kinds, len(alphabet))[0], want)


def test_battery_in_spark(spark):
    rng = random.Random(8)
    alphabets = secrets.ENCODINGS
    values = ["".join(rng.choice(a) for _ in range(n)) + pad for a in alphabets.values() for n in (21, 40, 300) for pad in ("", "=")]
    values += ["AbCd" * 9, "0" * 30, "zz_zz-11" * 4]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", secrets.battery(F.col("v")).alias("b")).collect()
    for r in rows:
        v, name = values[r["i"]], r["b"]["encoding"]
        plain = v.lower() if name == "hex" else v.rstrip("=").replace("-", "+").replace("_", "/")
        codes = np.array([[alphabets[name].index(c) for c in plain]])
        kinds = np.array([[next(k for k, x in enumerate(secrets.CLASSES) if c in x) for c in plain]])
        assert r["b"]["n"] == len(plain) and np.allclose(r["b"]["m"], secrets.measures(codes, kinds, len(alphabets[name]))[0])


def test_discoveries_are_controlled(spark):
    """Ordinary names, counters and dates are left alone beside planted keys of all encodings."""
    rng = random.Random(9)
    words = "the quick brown fox jumps over lazy dog and many other words of english prose are here".split()
    plain = ["_".join(rng.choice(words) for _ in range(6)) + str(rng.randrange(100)) for _ in range(400)] + [f"2024-01-{i:02d}T00-00-00Z-abcdef" for i in range(1, 29)]
    plain += [f"aaaaaaaaaaaaaaaaaaaaaaaa{i}" for i in range(20)] + ["".join(rng.choice(words).title() for _ in range(7)) + str(i) for i in range(200)]
    keys = ["".join(rng.choice(a) for _ in range(n)) + "7" for a, n in zip(secrets.ENCODINGS.values(), (28, 36, 44)) for _ in range(40)]
    df = spark.createDataFrame([(i, f"say {t} now") for i, t in enumerate(plain + keys)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.secrets_report(df).collect() if "random" in r["spans"]}
    assert len([i for i in found if i < len(plain)]) <= 2
    assert len([i for i in found if i >= len(plain)]) >= 100


def test_many_matches_in_one_text(spark):
    """Tens of thousands of matches, each at its place."""
    text = " ".join(f"AKIA{i:016d} é x{i}@y.com" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.secrets_report(df).first()["base_sha256"] == brute.digest(brute.base_spans(text, brute.SECRETS))
    assert pii.private_report(df).first()["base_sha256"] == brute.digest(brute.base_spans(text, brute.PII))
    assert secrets.without_secrets(df).first()["text"] == re.sub(r"AKIA[0-9]+", "[access]", text)


def test_spans_that_overlap_are_replaced_once(spark):
    from reviewlake.llm import spans

    text = "0123456789" * 60
    given = [(3, 0, 9, ""), (5, 1, 7, ""), (8, 1, 300, ""), (301, 0, 302, ""), (302, 1, 303, ""), (599, 0, 600, "")]
    df = spark.createDataFrame([(text, given), ("none", [])], f"text string, s {spans.SPANS}")
    got = df.select(spans.blanked(F.col("text"), F.col("s")), spans.redacted(F.col("text"), F.col("s"), ["a", "b"])).collect()
    blank = "".join(" " if any(a <= i < b for a, _, b, _ in given) else c for i, c in enumerate(text))
    assert tuple(got[0]) == (blank, text[:3] + "[a]" + text[300:301] + "[a][b]" + text[303:599] + "[a]") and tuple(got[1]) == ("none", "none")


def test_sanitised_by_row(spark):
    """Null and repeated ids: every row loses its own personal data and stays one row."""
    rows = [(None, "write a@b.co", 1), (None, "call +1 555 010 9999", 1), (5, "write c@d.co", 2), (5, "nothing", 2), (5, "nothing", 2), (6, None, 3)]
    got = [tuple(r) for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()]
    want = [(None, "write [email]", 1), (None, "call [phone]", 1), (5, "write [email]", 2), (5, "nothing", 2), (5, "nothing", 2), (6, None, 3)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_numbers_are_no_letters():
    assert langid.letter_runs("² ½ Ⅷ 12 _") == [] and langid.letter_runs("x²y É") == ["x", "y", "é"]


def test_long_words_are_scored_whole():
    """As far as doubles reach, rescaling changes nothing; beyond, the log goes on in proportion."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    model = langid.PieceModel(pieces, np.array([[0.1, 0.3], [0.2, 0.1], [0.15, 0.2], [0.25, 0.1], [0.2, 0.1], [0.1, 0.2]]))
    alpha = [np.ones(2)] + [np.zeros(2)] * 121
    word = "▁" + "abba" * 30
    for j in range(1, 122):
        alpha[j] = sum((alpha[i] * model.table[model.at[word[i:j]]] for i in range(max(0, j - 2), j) if word[i:j] in model.at), np.zeros(2))
    got = model.log_probabilities(["abba" * 30, "abba" * 3000, "q" * 5000])
    assert np.allclose(got[0], np.log(alpha[121])) and np.isfinite(got).all()
    assert np.allclose(got[1] / 3000, (model.log_probabilities(["abba" * 6000])[0] - got[1]) / 3000, rtol=1e-3)


def test_training_rows_of_a_large_language(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("en").alias("lang"))
    assert 0 < langid.sample_labelled(df, 40).count() < 120


def test_words_too_long_to_keep():
    counts, ids = bpe.WordCounts({}, "", lambda w: w), packing.WordIds(bpe.vocabulary(PATH)[0])
    assert counts["x" * 1000] == 1000 and len(counts) == 0 and counts["xy"] == 2 and len(counts) == 1
    assert ids["x" * 1000] and len(ids) == 0


def test_rules_are_measured_on_a_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    rows = quality.measure_rules(df, quality.RULES, 500).collect()
    assert {r["rule"] for r in rows} == {f.__name__ for f in quality.RULES} and all(300 < r["rows"] < 700 for r in rows)


def ordinary_names(rng, n):
    """Identifiers of the kind programs have, from other words and by other means than the module's own nulls."""
    words = "get set user account name list index value cache table query row column file path image render button click event server client request response token count total first last date time zone order item price group member session handler factory manager service builder parser writer reader".split()
    out = []
    while len(out) < n:
        w, kind = [rng.choice(words) for _ in range(rng.randint(3, 7))], rng.randrange(4)
        w.insert(rng.randint(1, len(w)), str(rng.randrange(10 ** rng.randint(1, 3))))
        name = [w[0] + "".join(x.title() for x in w[1:]), "_".join(w), "-".join(w), "".join(w)][kind]
        if rng.random() < 0.05:
            name = name.upper()
        if 20 <= len(name) <= 60:
            out.append(name)
    return out


@pytest.mark.parametrize("length, least", [(32, 20), (40, 28)])
def test_secrets_are_found_in_a_mixture(spark, length, least):
    """One random string in a hundred names."""
    rng = random.Random(length)
    names = ordinary_names(rng, 4000)
    keys = []
    while len(keys) < 40:
        k = "".join(rng.choice(secrets.ENCODINGS["base64"]) for _ in range(length))
        if re.search("[0-9]", k) and re.search("[A-Za-z]", k):
            keys.append(k)
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(names + keys)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.secrets_report(df).collect() if "random" in r["spans"]}
    assert len([i for i in found if i >= 4000]) >= least and len([i for i in found if i < 4000]) <= 4


def test_tails_hold_far_out(monkeypatch):
    """The lines against many more draws than they were read from, also at lengths beyond the simulated ones."""
    from statistics import NormalDist

    import json

    rows = {(r["encoding"], r["size"]): r for r in json.loads(secrets.nulls())}
    monkeypatch.setattr(secrets, "TRIALS", 100_000)
    for size, at in ((31, 31), (40, 40), (400, 247)):
        monkeypatch.setattr(secrets, "TRIALS", 100_000 if size < 100 else 10_000)
        for style in secrets.STYLES:
            row = rows["base64", max(s for s in secrets.SIZES if s <= at)]
            m = secrets.measures(*secrets.drawn(np.random.default_rng(11), secrets.ENCODINGS["base64"], size, style), 64)
            z = (m - row[f"{style}_mean"]) / (np.array(row[f"{style}_std"]) * (row["size"] / size) ** 0.5)
            start, slope = row[f"{style}_line"]
            score = (z @ np.array(row[f"{style}_weights"]) - start) / slope
            for p in (1e-2, 1e-3, 1e-4):
                if p * len(score) >= 10:
                    share = (score > NormalDist().inv_cdf(1 - p)).mean()
                    assert share <= 3 * p, (size, style, p, share)


def test_long_words_are_learned_whole():
    """Uses of a word by scaled sums are those of plain sums, and stay finite and complete at any length."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "abba"]
    model = langid.PieceModel(pieces, np.array([[0.1], [0.2], [0.15], [0.25], [0.2], [0.1], [0.05]]))

    def plain(word):
        w, n = "▁" + word, len(word) + 1
        arcs = [(i, j, model.at[w[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + 4) + 1) if w[i:j] in model.at]
        alpha, beta, out = np.zeros(n + 1), np.zeros(n + 1), np.zeros(len(pieces))
        alpha[0] = beta[n] = 1
        for i, j, r in arcs:
            alpha[j] += alpha[i] * model.table[r, 0]
        for i, j, r in sorted(arcs, reverse=True):
            beta[i] += beta[j] * model.table[r, 0]
        for i, j, r in arcs:
            out[r] += alpha[i] * model.table[r, 0] * beta[j] / alpha[n]
        return out

    for n in (1, 3, 4, 5, 9, 20, 60):
        word = ("abba" * n)[: 4 * n - n % 3]
        assert np.allclose(model.expected_uses([word], np.array([1.0]), 0), plain(word)), n
    long = model.expected_uses(["abba" * 3000, "ab"], np.array([2.0, 1.0]), 0)
    assert abs(sum(len(k) * x for k, x in zip(pieces, long)) - (2 * 12001 + 3)) < 1e-4


def test_languages_of_held_out_documents(spark):
    """Nearly all documents of the fold that nothing is learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify_languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    said = [r["lang"] == r["lang_pred"] for r in rows if r["text"] and any(map(str.isalpha, r["text"]))]
    assert len(said) > 100 and sum(said) >= 0.99 * len(said)


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("alpha, support, reach", [(0.9, 3, 64), (0.6, 2, 20)])
def test_disclosing_terms_are_those_of_plain_counts(spark, monkeypatch, few, alpha, support, reach):
    """Fifty documents: every term beside every address, by counts over whole documents."""
    import math

    monkeypatch.setattr(pii, "FEW_TERMS", few)
    rng = random.Random(12)
    people = [("ann lee", "ann@corp.com"), ("bob ray", "bob@mail.org"), ("cy dunn", "cy@x.net")]
    rows = []
    for i in range(50):
        words = [rng.choice(["river", "stone", "blue", "walks", "over", "and", "team", "lead"]) for _ in range(rng.randint(5, 30))]
        if i % 2:
            name, mail = rng.choice(people)
            at = rng.randrange(len(words))
            words[at:at] = [name.upper() if i % 5 == 0 else name, rng.choice(["at", "via", "wrote from"]), mail, rng.choice(["today", "the team", "\n"])]
        elif i % 7 == 0:
            words.insert(2, rng.choice(people)[0].split()[0])
        rows.append((i, " ".join(words)))
    rows += [(60 + k, t) for k, (_, t) in enumerate(rows[1:3])]
    term = re.compile(r"[^\W_]{3,}")
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    beside, holds, around = {}, {}, {}
    n_term = Counter(w for _, t in rows for w in set(term.findall(t.lower())))
    for i, t in rows:
        for m in mail.finditer(t):
            holds.setdefault(m[0].lower(), set()).add(i)
            left = t[max(0, m.start() - reach) : m.start()].rsplit("\n", 1)[-1]
            right = t[m.end() : m.end() + reach].split("\n", 1)[0]
            found = [x[0].lower() for x in term.finditer(left) if x.start() > 0 or len(left) < reach] + [x[0].lower() for x in term.finditer(right) if x.end() < len(right) or len(right) < reach]
            for w in found:
                beside.setdefault((m[0].lower(), w), set()).add(i)
                around.setdefault((m[0].lower(), w), set()).add((left, right))
    want = set()
    for (entity, w), docs_ in beside.items():
        if len(docs_) >= support and len(around[entity, w]) >= support:
            content = math.log(len(rows) / len(holds[entity]))
            if content > 0 and math.log(len(docs_) * len(rows) / (n_term[w] * len(holds[entity]))) >= alpha * content:
                want.add(w)
    got = {r["doc_id"]: r["spans"] for r in pii.private_report(spark.createDataFrame(rows, "doc_id long, text string"), alpha=alpha, support=support, reach=reach).collect()}
    for i, t in rows:
        open_ = mail.sub(lambda m: " " * len(m[0]), t)
        spans = {f"term:{m.start()}:{m.end()}" for m in term.finditer(open_) if m[0].lower() in want}
        assert {x for x in got[i].split(",") if x.startswith("term")} == spans
    assert want
