"""Best-fit packing of token sequences by matching of large items.

Bins hold `capacity` tokens. Pieces above a third of it fit at most twice in a bin: from the longest down, each is
matched with the longest partner that still fits, which is the most pairs possible. Smaller pieces then go, from
the longest down, each into the tightest gap that holds it, and into new bins when none does.

Only lengths matter for this, so the plan is made on the histogram of lengths (at most `capacity` rows, at any size of
input): equal bins are kept as one row with a count, and the plan says which ranks among the pieces of a length go
to which run of bins. Spark ranks the pieces of each length, in salted groups whose number grows with the length's
count, and looks every piece up in the plan.

Defined results: null and empty texts are a single end token; repeated rows are packed each on its own; an empty
table gives an empty table; only texts longer than a bin are cut.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window as W, functions as F

from reviewlake.llm.batches import map_rows
from reviewlake.llm.bpe import CACHE_WORDS, KEPT_LETTERS, NOT_PLAIN, PLAIN_WORD, VOCABULARY, spell, vocabulary
from reviewlake.session import materialize, ship

CAPACITY = 4096
END_ID = 1
SALT_ROWS = 1000


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tok):
        self.tok = tok

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array([t.id for t in self.tok.model.tokenize(spell(self.tok, word))], "<u4").tobytes()
        if len(word) <= KEPT_LETTERS:
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def id_maker(path: str):
    """text -> its ids by the library, as little-endian unsigned 32-bit numbers."""
    tok = vocabulary(path)[0]
    words = WordIds(tok)

    def ids(text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and not NOT_PLAIN.search(text):
            return b"".join(map(words.__getitem__, PLAIN_WORD.findall(text.lower())))
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return ids


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's ids and end_id, cut only where above capacity."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        ids, end = id_maker(path), end_id.to_bytes(4, "little")

        def one(doc_id, text):
            data = memoryview(ids(text) + end)
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)

        return one

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Histogram length -> pieces, to rows (length, first rank, pieces, first bin, pieces a bin, offset in the bin).

    The pieces of a row fill bins from the first on, so many in each. State: gap -> runs of bins with that gap.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def put(length: int, n_bins: int, each: int, first: int, gap: int) -> None:
        plan.append((length, used[length], n_bins * each, first, each, capacity - gap))
        used[length] += n_bins * each
        left[length] -= n_bins * each

    def leave(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        b = large[k] if k >= 0 else None
        if b is None:
            n = left[a]
            put(a, n, 1, bins, capacity)
            leave(capacity - a, bins, n)
        elif b == a and left[a] < 2:
            n = 1
            lower = next((large[i] for i in range(k - 1, -1, -1) if left[large[i]]), None)
            put(a, 1, 1, bins, capacity)
            if lower is None:
                leave(capacity - a, bins, 1)
            else:
                put(lower, 1, 1, bins, capacity - a)
                leave(capacity - a - lower, bins, 1)
        elif b == a:
            n = left[a] // 2
            put(a, n, 2, bins, capacity)
            leave(capacity - 2 * a, bins, n)
        else:
            n = min(left[a], left[b])
            put(a, n, 1, bins, capacity)
            put(b, n, 1, bins, capacity - a)
            leave(capacity - a - b, bins, n)
        bins += n
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            k = bisect_left(order, length)
            if k == len(order):
                each = min(capacity // length, left[length])
                n = left[length] // each
                put(length, n, each, bins, capacity)
                leave(capacity - each * length, bins, n)
                bins += n
                continue
            gap = order[k]
            first, n = gaps[gap].pop()
            each = min(gap // length, left[length])
            take = min(n, left[length] // each)
            put(length, take, each, first, gap)
            if take < n:
                gaps[gap].append((first + take, n - take))
            if not gaps[gap]:
                del gaps[gap], order[k]
            leave(gap - each * length, first, take)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of pieces with sequence_id and offset. pieces needs doc_id, piece, length and ids_crc32."""
    spark = pieces.sparkSession
    ship(spark)
    rows = materialize(pieces, "pack-pieces")
    hist = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = np.array(pack_lengths(hist, capacity) or np.zeros((0, 6)), dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)

    # a row a length, so at most `capacity` of them
    salts = F.broadcast(spark.createDataFrame([(n, -(-c // SALT_ROWS)) for n, c in hist.items()], "length long, salts long"))
    salted = rows.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    sizes = salted.groupBy("length", "salt").count()
    ahead = F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    ahead = sizes.select("length", "salt", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    nth = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("nth", nth).join(ahead, ["length", "salt"]).select(*rows.columns, (F.col("ahead") + F.col("nth")).alias("rank"))

    import pyarrow as pa
    from pyspark.sql.types import LongType, StructType

    def place(batches):
        plan = shared.value
        starts = plan[:, 0] << 48 | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            p = plan[np.searchsorted(starts, length << 48 | rank, "right") - 1]
            nth_bin, slot = np.divmod(rank - p[:, 1], p[:, 4])
            cols = batch.columns[:-1] + [pa.array(p[:, 3] + nth_bin), pa.array(p[:, 5] + slot * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = StructType(rows.schema.fields[:]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(token_pieces(docs, capacity, end_id, path), capacity)
