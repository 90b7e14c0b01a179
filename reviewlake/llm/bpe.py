"""Token counts by byte-pair merging with a heap and a linked list, without making identifiers.

A word's symbols are linked in order; a heap holds the ranks of adjacent pairs. The pair of lowest rank, leftmost
first, is merged until none is left: tokens = first symbols - merges. Only the count is kept, once for each word
in a bounded table. Texts are divided into words as the vocabulary file says: plain texts by one pattern, any
others by the file's own normaliser and splitter, special strings first.

Defined results: null text is empty and has no tokens; special strings in a text count as one token each, as the
library does by default; repeated rows get equal counts; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from reviewlake.llm.batches import map_rows

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS, KEPT_LETTERS = 500_000, 64
#: Characters for which lower-casing and splitting by PLAIN_WORD equal the file's own rules.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols, left = list(symbols), n
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two was merged meanwhile
        symbols[i], symbols[j] = a + b, None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], a + b))
    return left


class WordCounts(dict):
    """word -> tokens, filled when asked with words of up to KEPT_LETTERS; emptied at CACHE_WORDS."""

    def __init__(self, ranks, suffix: str, spell):
        self.ranks, self.suffix, self.spell = ranks, suffix, spell

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        symbols = list(self.spell(word))
        symbols[-1] += self.suffix
        n = count_merged(symbols, self.ranks)
        if len(word) <= KEPT_LETTERS:
            self[word] = n
        return n


@lru_cache(maxsize=1)
def vocabulary(path: str):
    """The file's tokenizer, its merge ranks and word suffix, and the pattern of its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
    special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]))
    tok = Tokenizer.from_file(path)
    return tok, {p: i for i, p in enumerate(pairs)}, spec["model"]["end_of_word_suffix"] or "", special


def spell(tok: Tokenizer, word: str) -> str:
    """The characters that stand for a plain word's bytes; those of ASCII words stand for themselves."""
    return word if word.isascii() else "".join(x for x, _ in tok.pre_tokenizer.pre_tokenize_str(word))


@lru_cache(maxsize=1)
def token_counter(path: str):
    """text -> number of tokens. The tables of words stay for the next tasks of the same Python worker."""
    tok, ranks, suffix, special = vocabulary(path)
    spelled = WordCounts(ranks, suffix, lambda word: word)
    plain = WordCounts(ranks, suffix, lambda word: spell(tok, word))

    def count(text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text and not NOT_PLAIN.search(text):
            return sum(map(plain.__getitem__, PLAIN_WORD.findall(text.lower())))
        n, parts = len(special.findall(text)), special.split(text)
        for part in parts:
            n += sum(spelled[x] for x, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part)))
        return n

    return count


def token_counts(docs: DataFrame, max_tokens: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every document."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        count = token_counter(path)

        def one(doc_id, text):
            n = count(text)
            yield doc_id, len((text or "").encode()), n, n > max_tokens

        return one

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
