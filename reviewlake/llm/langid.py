"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is
the sum over all its segmentations into pieces, by a forward pass; a text's is the product over its words. The
probabilities are learned by expectation maximisation on word counts of labelled documents: forward and backward
passes give the expected number of uses of each piece.

The model is fitted on about `train_docs` documents of each language at most, those with the smallest hashes of their ids.
Every word is learned whole, and every text and word predicted whole.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything when there is no
labelled text; a null doc_id counts as not held out and is not learned from; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.llm.batches import map_rows
from reviewlake.session import materialize, ship

VOCABULARY = "piece_bpe_32k.model"
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
TRAIN_DOCS = 1500
ROUNDS = 2
SMOOTHING = 200.0
UNKNOWN = 1e-8
CACHE_WORDS = 300_000
GROUP_LETTERS = 100_000
RESCALE = 16
KEPT_LETTERS = 64
HELD_WORDS = 50_000
FOLDS = 5


def letter_runs(text: str) -> list[str]:
    """Runs of letters in lower case. The pattern also takes numbers that are no decimal digits, which str.isalpha does not."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the mark of a word's start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.removeprefix(START).isalpha() or p == START)


class PieceModel:
    """Piece probabilities, one column for each language. Words of equal length go through the passes together."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.at = {p: i for i, p in enumerate(pieces)}
        self.n, self.languages = probabilities.shape
        # two more rows: what is no piece, and a single character that is none
        self.table = np.vstack([probabilities, np.zeros(self.languages), np.full(self.languages, UNKNOWN)])
        self.longest = max(map(len, pieces), default=1)

    def arcs_from(self, words: list[str], i: int):
        """(end, rows of the table) for all pieces that start at i in words of equal length."""
        for j in range(i + 1, min(len(words[0]), i + self.longest) + 1):
            none = self.n + (j == i + 1)
            rows = np.fromiter((self.at.get(w[i:j], none) for w in words), np.int64, len(words))
            if j == i + 1 or (rows != self.n).any():
                yield j, rows

    def arcs(self, words: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, rows of the table) for all places of a piece in words of equal length, by start."""
        return [(i, j, rows) for i in range(len(words[0])) for j, rows in self.arcs_from(words, i)]

    def groups(self, words: list[str]):
        """Places of words of equal length, some GROUP_LETTERS letters at once, and the words with their start mark."""
        by: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by[len(w)].append(k)
        for length, places in by.items():
            size = max(1, GROUP_LETTERS // length)
            for at in range(0, len(places), size):
                some = places[at : at + size]
                yield some, [START + words[k] for k in some]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Log of the sum over all segmentations, for each word and language.

        Only the places that a piece can still reach are held, and every RESCALE places they are brought back to a largest value
        of one, so words may be of any length.
        """
        out = np.zeros((len(words), self.languages))
        for places, group in self.groups(words):
            n, ring = len(group[0]), self.longest + 1
            alpha = np.zeros((ring, len(group), self.languages))
            alpha[0], scale = 1, 0.0
            for i in range(n):
                if i % RESCALE == RESCALE - 1:
                    top = alpha.max(axis=0)
                    alpha /= top
                    scale = scale + np.log(top)
                now = alpha[i % ring].copy()
                alpha[i % ring] = 0
                for j, rows in self.arcs_from(group, i):
                    alpha[j % ring] += now * self.table[rows]
            out[places] = np.log(np.maximum(alpha[n % ring], 1e-300)) + scale
        return out

    def expected_uses(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected uses of each piece in words of any length of a language, each as often as it counts.

        Forward and backward sums are held against factors `c`, by which the forward ones are divided every RESCALE places.
        """
        out = np.zeros(self.n + 2)
        p = self.table[:, language]
        for places, group in self.groups(words):
            n = len(group[0])
            kept = self.arcs(group) if n <= KEPT_LETTERS else None  # of longer words, arcs are found twice and not held
            alpha, beta, c = np.zeros((n + 1, len(group))), np.zeros((n + 1, len(group))), {}
            alpha[0], beta[n] = 1, 1
            for i, arcs in self._by_start(group, kept, range(n)):
                if i % RESCALE == RESCALE - 1:
                    c[i] = alpha[i : i + self.longest + 1].max(axis=0)
                    alpha[i : i + self.longest + 1] /= c[i]
                for j, rows in arcs:
                    alpha[j] += alpha[i] * p[rows]
            share = counts[places] / np.maximum(alpha[n], 1e-300)
            used: list[tuple[np.ndarray, np.ndarray]] = []
            for i, arcs in self._by_start(group, kept, range(n - 1, -1, -1)):
                for j, rows in arcs:
                    later = p[rows] * beta[j]
                    for t in range(i + RESCALE - i % RESCALE - 1 if i % RESCALE < RESCALE - 1 else i + RESCALE, j + 1, RESCALE):
                        if t in c:
                            later = later / c[t]
                    beta[i] += later
                    used.append((rows, alpha[i] * later * share))
                if used and (not i or len(used) * len(group) > GROUP_LETTERS):
                    out += np.bincount(*map(np.concatenate, zip(*used)), self.n + 2)
                    used.clear()
        return out[: self.n]

    def _by_start(self, group: list[str], kept, order):
        if kept is None:
            yield from ((i, list(self.arcs_from(group, i))) for i in order)
            return
        by = [[] for _ in group[0]]
        for i, j, rows in kept:
            by[i].append((j, rows))
        yield from ((i, by[i]) for i in order)


def sample_labelled(docs: DataFrame, train_docs: int) -> DataFrame:
    """(lang, text) of labelled documents outside the held-out fold, about train_docs of each language by hash of the id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    upto = F.lit(0).cast("long")
    for lang, n in sizes.items():
        upto = F.when(F.col("lang") == lang, F.lit((1 << 60) * min(train_docs, n) // n)).otherwise(upto)
    return labelled.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 4) < upto).select("lang", "text")


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], PieceModel | None]:
    """Languages in order and the piece model of each."""

    def count_words():
        def one(lang, text):
            for word, n in Counter(letter_runs(text)).items():
                yield lang, word, n

        return one

    words = map_rows(sample_labelled(docs, train_docs), count_words, "lang string, word string, n long")
    words = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return [], None
    pieces = vocabulary(path or public_tokenizers.path(VOCABULARY))
    column = {lang: k for k, lang in enumerate(languages)}
    probabilities = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        model = words.sparkSession.sparkContext.broadcast(PieceModel(pieces, probabilities))

        def uses(batches, model=model):
            total: dict[str, np.ndarray] = {}
            held: dict[str, tuple[list[str], list[int]]] = {}

            def add(lang):
                words, n = held.pop(lang)
                total[lang] = total.get(lang, 0) + model.value.expected_uses(words, np.array(n, float), column[lang])

            for batch in batches:
                for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    own = held.setdefault(lang, ([], []))
                    own[0].append(word)
                    own[1].append(n)
                    if len(own[0]) >= HELD_WORDS:
                        add(lang)
            for lang in list(held):
                add(lang)
            for lang, x in total.items():
                at = np.flatnonzero(x > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([column[lang]] * len(at)), pa.array(at), pa.array(x[at])], ["lang", "piece", "x"])

        counts = np.zeros_like(probabilities)
        summed = words.mapInArrow(uses, "lang long, piece long, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x"))
        for r in summed.collect():  # at most pieces x languages rows
            counts[r["piece"], r["lang"]] = round(r["x"], 6)
        pooled = counts.sum(axis=1) + 0.01
        counts += SMOOTHING * (pooled / pooled.sum())[:, None]
        probabilities = counts / counts.sum(axis=0)
    return languages, PieceModel(pieces, probabilities)


class Scorer:
    """texts -> (language, its posterior probability), with a bounded table of words' log probabilities."""

    def __init__(self, languages: list[str], model: PieceModel):
        self.languages, self.model = languages, model
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [letter_runs(t or "") for t in texts]
        if len(self.row) > CACHE_WORDS:
            self.row, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in self.row]
        long = [w for w in new if len(w) > KEPT_LETTERS]
        if new:
            new = [w for w in new if len(w) <= KEPT_LETTERS] + long
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.table = np.concatenate([self.table, self.model.log_probabilities(new)])
        out = [self.best(words) for words in found]
        for w in long:
            del self.row[w]
        self.table = self.table[: len(self.row)]
        return out

    def best(self, words: list[str]) -> tuple[str, float]:
        if not words:
            return "und", 0.0
        total = self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
        k = int(total.argmax())
        return self.languages[k], float(1.0 / np.exp(total - total[k]).sum())


def identify(docs: DataFrame, languages: list[str], model: PieceModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; only the text is an input."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((languages, model))

    def run(batches):
        score = Scorer(*shared.value) if shared.value[1] else lambda texts: [("und", 0.0)] * len(texts)
        for batch in batches:
            out = score(batch.column(2).to_pylist())
            cols = [batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    """Fit on the labelled documents outside the held-out fold, then predict all."""
    return identify(docs, *fit(docs, train_docs, rounds, path))
