"""Secrets by patterns, and by tests of randomness.

Beside keyed values, access keys and long hexadecimal runs, every run of 20 or more characters of an encoding's
alphabet outside those, with a letter and a digit, is a candidate. Its inferred encoding (hex, base32, base64) gives the
alphabet. A battery of three tests measures it: chi-squared uniformity of the symbols, runs of character classes, and serial
correlation of the codes.

Each test has a null distribution by encoding and length, simulated once on the driver. Two nulls are used. Under ordinary
names (words of letters as frequent as in English and numbers, joined, separated or capitalised) the three scores are
added with weights, and the p-value of a discovery is the largest of the three styles'. The weights are those of two
candidates that let more random strings pass: equal ones, or those that set the means apart best against both spreads.
The weighted sum's tail is that of a normal distribution through its simulated quantiles, which simulations of hundreds
of thousands of names bear out down to 1e-6; spreads shrink with the square root of the length, at any length.
Benjamini-Hochberg control at level Q within each encoding and class of lengths decides, its cut read from a histogram of
p-values. Under uniform random symbols, the sum of squared scores must not be rejected at level RANDOM, so that orderly
strings unlike text, such as counters, are no discoveries.

All of this runs in built-in functions. Defined results: null and empty texts have no spans; repeated rows get equal
results and count in the control as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from reviewlake.llm.spans import SPANS, blanked, count_kind, find, named, redacted, spelled, with_matches
from reviewlake.session import materialize

Q = 0.001
RANDOM = 1e-3
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base64": UPPER + LOWER + DIGITS + "+/"}
CLASSES = (UPPER, LOWER, DIGITS, "+/")
#: Letters a to z per thousand of English text.
FREQUENCY = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Of ordinary names: share of upper-case, lower-case and number words, the words' lengths, and how words are set apart.
SHARES, LENGTHS, STYLES = (0.2, 0.6, 0.2), (2, 8), ("joined", "separated", "capitals")
SIZES = sorted({round(20 * 1.15**k) for k in range(19)})
TRIALS = 4000
TAIL = (0.5, 0.1, 0.01)
#: Upper shares at which a style's simulated tail is read; the steeper of the two lines between them is kept. What share of random strings passes FAR decides on the weights.
SHARES_READ, FAR = (0.1, 0.01, 0.002), 1e-5
EQUAL = (-1.0, 1.0, -1.0)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+={0,2}+"
VALUE = r"""[:=]\x20*+["']?+"""

#: kind -> (pattern, test of a match)
KINDS = {
    "assign": (
        r"""(?:(?i)password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
        lambda v: F.length(F.regexp_extract(v, r"^[A-Za-z_]+" + r"""["']?+\x20*+""" + VALUE + "(.*)$", 1)) >= 8,
    ),
    "access": (r"AKIA[A-Z0-9]++", lambda v: F.length(v) >= 16),
    "hex": (r"[0-9a-f]++", lambda v: F.length(v) >= 32),
}
#: hex runs are looked for from 32 characters on, which finds the same as testing every run's length after.
SEARCH = KINDS | {"hex": (r"(?<![0-9a-f])[0-9a-f]{32,}+", None)}
NAMES = [*KINDS, "random"]


def measures(codes: np.ndarray, classes: np.ndarray, a: int) -> np.ndarray:
    """trials x 3: repeat rate (chi-squared up to scale), share of class changes, circular serial correlation."""
    trials, n = codes.shape
    counts = np.bincount((codes + a * np.arange(trials)[:, None]).ravel(), minlength=a * trials).reshape(trials, a).astype(float)
    x = codes.astype(float)
    total = x.sum(axis=1)
    spread = n * (x * x).sum(axis=1) - total**2
    around = n * (x * np.roll(x, -1, axis=1)).sum(axis=1) - total**2
    serial = np.where(spread > 0, around / np.where(spread > 0, spread, 1), 1.0)
    return np.column_stack([((counts**2).sum(axis=1) - n) / (n * (n - 1)), (classes[:, 1:] != classes[:, :-1]).mean(axis=1), serial])


def drawn(rng: np.random.Generator, alphabet: str, n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """TRIALS strings of n codes and their classes, random or like names of a style."""
    class_of = np.array([next(k for k, x in enumerate(CLASSES) if c in x) for c in alphabet])
    if kind == "random":
        codes = rng.integers(0, len(alphabet), (TRIALS, n))
        return codes, class_of[codes]
    share = np.array(SHARES) * np.isin(range(3), class_of)
    ends = rng.integers(LENGTHS[0], LENGTHS[1] + 1, (TRIALS, n)).cumsum(axis=1)
    start = np.zeros((TRIALS, n + 1), bool)
    np.put_along_axis(start, np.minimum(ends, n), True, axis=1)
    word = start[:, :n].cumsum(axis=1)
    classes = np.take_along_axis(rng.choice(3, size=(TRIALS, n), p=share / share.sum()), word, axis=1)
    if 3 in class_of and kind == "separated":
        classes = np.where(start[:, :n], 3, classes)
    if {0, 1} <= set(class_of) and kind == "capitals":
        classes = np.where(start[:, :n] & (classes == 1), 0, classes)
    codes = np.zeros((TRIALS, n), int)
    for k in np.unique(class_of):
        at = np.flatnonzero(class_of == k)
        often = np.array([FREQUENCY[LOWER.index(alphabet[i].lower())] if alphabet[i].isalpha() else 1 for i in at], float)
        size = (TRIALS, 1) if k == 3 else (TRIALS, n)  # a name keeps to one separator
        codes = np.where(classes == k, rng.choice(at, size=size, p=often / often.sum()), codes)
    return codes, classes


@lru_cache(maxsize=1)
def nulls() -> str:
    """JSON rows (encoding, size; for random: means, deviations, tail of the squares' sum; for each style: means, deviations, weights and the tail's line)."""
    rng, rows = np.random.default_rng(7), []
    for name, alphabet in ENCODINGS.items():
        for size in SIZES:
            chance = measures(*drawn(rng, alphabet, size, "random"), len(alphabet))
            mean, std = chance.mean(axis=0), chance.std(axis=0) + 1e-9
            score = (((chance - mean) / std) ** 2).sum(axis=1)
            row = {"encoding": name, "size": size, "random_mean": mean.tolist(), "random_std": std.tolist(), "random_tail": np.quantile(score, [1 - p for p in TAIL]).tolist()}
            for style in STYLES:
                m = measures(*drawn(rng, alphabet, size, style), len(alphabet))
                mean, std = m.mean(axis=0), m.std(axis=0) + 1e-9
                weights, line = weighed((m - mean) / std, (chance - mean) / std)
                row |= {f"{style}_mean": mean.tolist(), f"{style}_std": std.tolist(), f"{style}_weights": weights, f"{style}_line": line}
            rows.append(row)
    return json.dumps(rows)


def weighed(names: np.ndarray, chance: np.ndarray) -> tuple[list[float], list[float]]:
    """(weights, (start, slope)): of the candidates those under which more of the random scores lie in the names' far tail."""
    apart = np.linalg.solve(np.cov(names.T) + np.cov(chance.T) + 1e-9 * np.eye(3), chance.mean(axis=0))
    best = None
    for w in (np.array(EQUAL), apart):
        q, z = np.quantile(names @ w, [1 - p for p in SHARES_READ]), [NormalDist().inv_cdf(1 - p) for p in SHARES_READ]
        slope = max((q[1] - q[0]) / (z[1] - z[0]), (q[2] - q[1]) / (z[2] - z[1]))
        start = q[1] - slope * z[1]
        passed = (chance @ w > start + slope * NormalDist().inv_cdf(1 - FAR)).mean()
        if best is None or passed > best[0]:
            best = passed, w.tolist(), [float(start), float(slope)]
    return best[1], best[2]


def null_table(spark: SparkSession) -> DataFrame:
    """The nulls as a table of one row for each encoding and size, some 60 in all."""
    kinds = ", ".join(f"{k}_{x}: array<double>" for k in ("random", *STYLES) for x in ("mean", "std", *(("tail",) if k == "random" else ("weights", "line"))))
    rows = F.from_json(F.lit(nulls()), f"array<struct<encoding: string, size: int, {kinds}>>")
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def battery(value: Column) -> Column:
    """Encoding of a candidate, its length without padding, and the three measures, as `measures` has them."""
    hexadecimal, base32 = value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), value.rlike("^[A-Z2-7]+=*$")
    encoding = F.when(hexadecimal, "hex").when(base32, "base32").otherwise("base64")
    alphabet = F.when(hexadecimal, ENCODINGS["hex"]).when(base32, ENCODINGS["base32"]).otherwise(ENCODINGS["base64"])
    plain = F.when(hexadecimal, F.lower(value)).otherwise(F.translate(F.regexp_replace(value, "=+$", ""), "-_", "+/"))

    def of(x: Column) -> Column:
        text, letters = x["text"], x["alphabet"]
        n = F.length(text).cast("double")
        squares = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda s, c: s + F.pow((F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"), F.lit(2.0)))
        changes = (F.regexp_count(text, F.lit("[a-z]++|[A-Z]++|[0-9]++|[+/]++")) - 1).cast("double")
        codes = F.transform(F.split(text, ""), lambda c: (F.instr(letters, c) - 1).cast("double"))

        def serial(v: Column) -> Column:
            total = lambda w: F.aggregate(w, F.lit(0.0), lambda s, y: s + y)
            shifted = F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1))
            around = n * total(F.zip_with(v, shifted, lambda p, q: p * q)) - F.pow(total(v), F.lit(2.0))
            spread = n * total(F.transform(v, lambda p: p * p)) - F.pow(total(v), F.lit(2.0))
            return F.when(spread > 0, around / spread).otherwise(1.0)

        found = F.array((squares - n) / (n * (n - 1)), changes / (n - 1), named(codes, serial))
        return F.struct(x["encoding"].alias("encoding"), n.cast("int").alias("n"), found.alias("m"))

    return named(F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), plain.alias("text")), of)


def neg_log_p(score: Column, tail: Column) -> Column:
    """-log10 of the upper tail, linear between the simulated points and beyond them."""
    points = [-float(np.log10(p)) for p in TAIL]
    line = lambda i: points[i] + (score - tail[i]) * (points[i + 1] - points[i]) / (tail[i + 1] - tail[i])
    return F.greatest(F.when(score < tail[1], line(0)).otherwise(line(1)), F.lit(0.0))


def neg_log_normal(z: Column) -> Column:
    """-log10 of a standard normal's upper tail for z >= 0 (Borjesson and Sundberg 1979: within 0.3 % of the tail at any z); that of 0 below."""
    x = F.greatest(z, F.lit(0.0))
    mills = (1 - 1 / math.pi) * x + F.sqrt(x * x + 2 * math.pi) / math.pi
    return x * x / (2 * math.log(10)) + F.log10(math.sqrt(2 * math.pi) * mills)


def verdict(b: Column, null) -> tuple[Column, Column]:
    """(not rejected as random, -log10 p under the ordinary style that explains it best) from the measures and the nulls' columns."""
    wide = F.sqrt(null["size"] / F.greatest(b["n"], null["size"]))  # spreads of the null's size, at the candidate's

    def scores(kind: str) -> list[Column]:
        return [(b["m"][i] - null[f"{kind}_mean"][i]) / (null[f"{kind}_std"][i] * wide) for i in range(3)]

    def ordinary(style: str) -> Column:
        total = sum(z * null[f"{style}_weights"][i] for i, z in enumerate(scores(style)))
        return neg_log_normal((total - null[f"{style}_line"][0]) / null[f"{style}_line"][1])

    odd = neg_log_p(sum(z * z for z in scores("random")), null["random_tail"])
    return odd <= -float(np.log10(RANDOM)), F.least(*map(ordinary, STYLES))


def find_candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, base spans, and the candidates outside them."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = with_matches(rows, "text", SEARCH, "base")
    runs = find(blanked(F.col("text"), F.col("base")), CANDIDATE, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    return materialize(found.select("row", "doc_id", "base", runs.alias("runs")), "secrets-found")


def scored(found: DataFrame) -> DataFrame:
    """row, start, end, value, encoding, size (class of lengths), random and bucket (of -log10 p, tenths) of all candidates."""
    runs = found.where(F.size("runs") > 0).select("row", F.explode("runs").alias("r")).withColumn("b", battery(F.col("r.value")))
    null = null_table(found.sparkSession)
    at = F.array_max(F.filter(F.array(*map(F.lit, SIZES)), lambda g: g <= F.greatest("b.n", F.lit(SIZES[0]))))
    both = runs.join(F.broadcast(null), (F.col("b.encoding") == F.col("encoding")) & (at == F.col("size")))
    random, p = verdict(F.col("b"), null)
    return both.select(
        "row", "r.start", "r.end", "r.value", "b.encoding", F.floor(F.log2(F.col("b.n"))).cast("int").alias("size"), random.alias("random"), F.floor(10 * p).cast("int").alias("bucket")
    )


def discoveries(found: DataFrame, q: float = Q) -> DataFrame:
    """(row, extra): spans of the candidates that the tests and the control let through."""
    rows = materialize(scored(found), "secrets-scored")
    group = ["encoding", "size"]
    counts = rows.groupBy(*group, "bucket").count()
    upto = F.sum("count").over(W.partitionBy(*group).orderBy(F.col("bucket").desc()))
    edge = F.pow(F.lit(10.0), -F.col("bucket") / 10.0)
    cuts = counts.withColumn("upto", upto).withColumn("all", F.sum("count").over(W.partitionBy(*group)))
    cuts = cuts.where(edge <= q * F.col("upto") / F.col("all")).groupBy(*group).agg(F.min("bucket").alias("cut"))
    kept = rows.where("random").join(cuts, group).where("bucket >= cut")
    span = F.struct("start", F.lit(NAMES.index("random")).alias("kind"), "end", "value")
    return kept.groupBy("row").agg(F.collect_list(span).cast(SPANS).alias("extra"))


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """row, doc_id, base (spans of the patterns) and spans (those and random runs)."""
    found = find_candidates(docs)
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPANS))))
    return found.join(discoveries(found, q), "row", "left").select("row", "doc_id", "base", spans.alias("spans"))


def secrets_report(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, and all spans."""
    return find_secrets(docs, q).select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(spelled(F.col("base"), NAMES), 256).alias("base_sha256"), spelled(F.col("spans"), NAMES).alias("spans"),
    )


def without_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """docs with the secrets in text replaced by their kind; other columns stay. Repeated doc_ids share a text's spans
    only if their texts are equal too."""
    key = [F.col("doc_id"), F.sha2("text", 256)]
    spans = find_secrets(docs.select(F.struct(*key).alias("doc_id"), "text"), q).where(F.size("spans") > 0)
    spans = spans.groupBy("doc_id").agg(F.first("spans").alias("_spans")).select(F.col("doc_id.*"), "_spans").toDF("_doc_id", "_sha2", "_spans")
    text = redacted(docs["text"], F.coalesce("_spans", F.array().cast(SPANS)), NAMES)
    on = docs["doc_id"].eqNullSafe(spans["_doc_id"]) & (F.sha2(docs["text"], 256) == spans["_sha2"])
    return docs.join(spans, on, "left").select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
