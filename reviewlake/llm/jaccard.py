"""Exact Jaccard join of documents on word n-grams.

Two sets with Jaccard similarity t or more share an element of their prefixes, the first n - ceil(t n) + 1 elements in
any common order (Chaudhuri et al., 2006). The order here is rare first: documents with each n-gram are counted in a sketch of
fixed size, which is broadcast, and n-grams stand by that count and then by hash; an n-gram shared by very many
documents comes last in all of them and seldom joins. Pairs that meet on a prefix n-gram pass a length and a
positional filter there, and a suffix filter: both sets are cut at the same 256 places of the hash order, and the parts' sizes
bound what they can share (the partition bound of Xiao et al., 2008). Every pair left is verified once on the whole sets.

Texts stay where they are, but for those of pairs to verify: they travel compressed, a third of their sets' hashes or so,
and are cut into n-grams again where they meet. Postings travel packed by hash range. Texts with equal sets are one node, by 64-bit
signature; of a billion different sets, two share one with a probability of 3 %. Up to GROUP documents on an n-gram are paired all. Larger groups are linked along chains first, in several orders,
and at last all their pairs whose members are in different components still are verified, so a large group of near
copies costs a few passes and no pair of different components is left out. N-grams whose counts
stand out get their postings dealt over salts.

Defined results: null texts and texts without words have an empty set and link with nothing; fewer words than n are
one n-gram; rows that repeat a doc_id are documents of their own with the same id; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from reviewlake.llm.batches import map_rows
from reviewlake.llm.graph import connected_components
from reviewlake.session import materialize, ship

WORDS = 5
PERCENT = 75
GROUP = 4
ORDERS = 4
AHEAD = 4
CHAIN_ROWS = 1000
SLOT_BITS = 22
BLOCK_BITS = 16
BLOOM_BITS = 26
HOT = 20_000
BUCKET_ROWS = 400_000
RANGE_BITS = 8
CACHE_WORDS, KEPT_BYTES = 200_000, 64
HELD_GRAMS = 1 << 20
FEW_ROWS = 1_000_000
FLUSH_ROWS = 500_000
POSTING = np.dtype([("key", "<u8"), ("sig", "<i8"), ("n", "<u4"), ("pos", "<u4")])
SHARE = 1000
#: Fixed odd multipliers of the rolling hash.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept in a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[0]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total + w[i : len(w) - k + 1 + i] * ODD[i % 5])
    return np.unique(mixed(total))


def signature(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def least_overlap(na, nb, percent: int = PERCENT):
    """Smallest intersection for which two sets of these sizes link."""
    return -(-(na + nb) * percent // (100 + percent))


def range_counts(grams: np.ndarray) -> bytes:
    """N-grams in each range of the hash, one byte each; 255 stands for any larger number too."""
    return np.minimum(np.bincount((grams >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS), 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes, n: int) -> int:
    """Most elements that two sets can share by their range counts; n where a count is cut off."""
    low = np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
    return n if low.max() == 255 else int(low.sum())


class SlotCounts:
    """Counts in 2**bits slots; emitted and added up in blocks of 2**BLOCK_BITS."""

    def __init__(self, bits: int):
        self.counts = np.zeros(1 << bits, np.uint32)
        self.held, self.n = [], 0

    def add(self, slots: np.ndarray) -> None:
        self.held.append(slots)
        self.n += len(slots)
        if self.n > FLUSH_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            at, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.counts[at.astype(np.int64)] += n.astype(np.uint32)
            self.held, self.n = [], 0

    def blocks(self):
        """(block, counts in the smallest type that holds them, compressed)."""
        self.flush()
        for k, block in enumerate(self.counts.reshape(-1, 1 << BLOCK_BITS)):
            if top := int(block.max()):
                kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4"
                yield k, kind[2].encode() + zlib.compress(block.astype(kind).tobytes(), 1)


def add_up(parts: DataFrame, bits: int) -> np.ndarray:
    """Sum (block, data) rows of many tasks; the result has 2**bits slots whatever the input."""
    size = 1 << BLOCK_BITS

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(block, np.zeros(size, np.int64))[:] += np.frombuffer(zlib.decompress(data[1:]), f"<u{data[:1].decode()}")
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], ["block", "data"])

    n = (1 << bits) // size
    out = np.zeros((n, size), np.uint32)
    for row in parts.repartition(n, "block").mapInArrow(run, "block long, data binary").collect():
        out[row["block"]] = np.frombuffer(row["data"], "<u4")
    return out.reshape(-1)


def scan(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, sig, ranges, text_hash) of every document, and the sketch of n-gram counts, in one pass over the texts."""
    ship(docs.sparkSession)
    names = ["doc_id", "n", "sig", "ranges", "text_hash", "block", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    batch_of = lambda *cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches):
        hashes, slots = WordHashes(), SlotCounts(SLOT_BITS)
        for batch in batches:
            n, sig, ranges = [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingle_set(text, hashes)
                slots.add((grams >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
                n.append(len(grams))
                sig.append(signature(grams))
                ranges.append(range_counts(grams))
            none = [None] * len(n)
            yield batch_of(batch.column(0), n, sig, ranges, batch.column(2), none, none)
        for block, data in slots.blocks():
            yield batch_of([None], [None], [None], [None], [None], [block], [data])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, n long, sig long, ranges binary, text_hash long, block long, data binary")
    rows = materialize(rows, "jaccard-scan")
    return rows.where("block is null").select("doc_id", "n", "sig", "ranges", "text_hash"), add_up(rows.where("block is not null").select("block", "data"), SLOT_BITS)


def ranks_of(sketch: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """Per slot: a rank that grows with its count above the mean, and the salts of slots whose count stands out from the mean."""
    mean = sketch.mean()
    ranks = np.minimum(255, 8 * np.log2(np.maximum(sketch.astype(np.float64) - mean, 0) + 1)).astype(np.uint8)
    hot = np.flatnonzero(sketch > HOT + mean + 6 * np.sqrt(mean))
    return ranks, {int(s): -(-int(sketch[s]) // (HOT // 2)) for s in hot}


def postings(docs: DataFrame, sketch: np.ndarray, buckets: int, percent: int = PERCENT) -> DataFrame:
    """(bucket, salt, salts, data): packed postings of every prefix; a task emits each distinct set once.

    Within a bucket, whose rows are bounded, 32 bits tell n-grams apart: two that share them are one pair or so more to verify.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks_of(sketch))

    def run(batches):
        hashes, seen, held, size = WordHashes(), set(), [], 0
        ranks, hot = shared.value
        hot_slots = np.array(sorted(hot), np.uint64)
        hot_salts = np.array([hot[int(s)] for s in hot_slots], np.int64)

        def flush():
            rows = np.concatenate(held)
            slot = (rows["key"] << np.uint64(8)) >> np.uint64(64 - SLOT_BITS)
            salt, salts = np.full(len(rows), -1, np.int64), np.ones(len(rows), np.int64)
            if len(hot_slots):
                at = np.minimum(np.searchsorted(hot_slots, slot), len(hot_slots) - 1)
                is_hot = hot_slots[at] == slot
                salts[is_hot] = hot_salts[at[is_hot]]
                salt[is_hot] = rows["sig"][is_hot] % salts[is_hot]
            spot = mixed(rows["key"])
            bucket = (spot % np.uint64(buckets)).astype(np.int64)
            rows["key"] = spot >> np.uint64(32)
            order = np.lexsort((rows["key"], salt, bucket))
            rows, bucket, salt, salts = rows[order], bucket[order], salt[order], salts[order]
            cuts = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(salt) != 0)) + 1), len(rows)]
            first = cuts[:-1]
            data = pa.array([pack(rows[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(salt[first]), pa.array(np.maximum.reduceat(salts, first)), data], ["bucket", "salt", "salts", "data"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                grams = shingle_set(text, hashes)
                if not (n := len(grams)) or (sig := signature(grams)) in seen:
                    continue
                if len(seen) < FLUSH_ROWS:
                    seen.add(sig)
                key = np.sort((ranks[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8)))
                out = np.zeros(n - -(-n * percent // 100) + 1, POSTING)
                out["key"], out["sig"], out["n"], out["pos"] = key[: len(out)], sig, n, np.arange(len(out))
                held.append(out)
                size += len(out)
                if size > FLUSH_ROWS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "bucket long, salt long, salts long, data binary")


def pack(rows: np.ndarray) -> bytes:
    """Postings of one bucket, sorted by key: signatures as they are, all else as compressed bytes, with differences of keys."""
    columns = np.stack([np.diff(rows["key"].astype(np.int64), prepend=0), rows["n"], rows["pos"]]).astype("<u4")
    planes = columns.view(np.uint8).reshape(3, len(rows), 4).transpose(0, 2, 1)
    return len(rows).to_bytes(4, "little") + rows["sig"].tobytes() + zlib.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    """The postings of pack()."""
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(zlib.decompress(data[4 + 8 * n :]), np.uint8).reshape(3, 4, n)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(3, n)
    rows = np.zeros(n, POSTING)
    rows["key"], rows["n"], rows["pos"] = np.cumsum(columns[0], dtype=np.uint64), columns[1], columns[2]
    rows["sig"] = np.frombuffer(data, "<i8", n, 4)
    return rows


def may_link(p: np.ndarray, q: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Length and positional filters for pairs of postings of one n-gram.

    At the first n-gram of the order that two sets share, all they share lies from there on. A pair that links passes
    there, so a pair may be left out wherever the rests are too short.
    """
    na, nb, i, j = (x.astype(np.int64) for x in (p["n"], q["n"], p["pos"], q["pos"]))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - i, nb - j) >= least_overlap(na, nb, percent))


def meet(packed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Postings -> pairs (b not null) and members of large groups (key not null), with the parts of CHAIN_ROWS that the group makes."""

    def run(table: pa.Table) -> pa.Table:
        hot, salts = table.column("salt")[0].as_py() >= 0, max(table.column("salts").to_pylist())
        rows = np.concatenate([unpack(x.as_py()) for x in table.column("data")])
        rows["key"] |= np.uint64(table.column("bucket")[0].as_py() << 32)
        rows = rows[np.lexsort((rows["sig"], rows["key"]))]
        same_key = rows["key"][1:] == rows["key"][:-1]
        rows = rows[np.concatenate([[True], ~(same_key & (rows["sig"][1:] == rows["sig"][:-1]))])]
        starts = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        sizes = np.diff([*starts, len(rows)])
        size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        at = np.arange(len(rows))
        left, right = [], []
        for d in range(1, GROUP):
            i = np.flatnonzero((size <= GROUP) & (at + d < start + size))
            left.append(i)
            right.append(i + d)
        # a chain through each large group, in one of ORDERS orders, so that a document meets several others
        i = np.flatnonzero(size > GROUP)
        i = i[np.lexsort((mixed(rows["sig"][i].view(np.uint64) + rows["key"][i] % np.uint64(ORDERS)), rows["key"][i]))]
        ends = rows["key"][i[1:]] == rows["key"][i[:-1]]
        left, right = np.concatenate([*left, i[:-1][ends]]), np.concatenate([*right, i[1:][ends]])
        ok = may_link(rows[left], rows[right], percent)
        pairs = np.unique(np.sort(np.stack([rows["sig"][left[ok]], rows["sig"][right[ok]]], axis=1), axis=1), axis=0)
        is_big = (size > GROUP) | hot
        big, parts = rows[is_big], -(-size[is_big] * salts // CHAIN_ROWS)
        none = lambda n, kind: pa.nulls(n, kind)
        cols = {
            "a": [pa.array(pairs[:, 0]), pa.array(big["sig"])],
            "b": [pa.array(pairs[:, 1]), none(len(big), pa.int64())],
            "key": [none(len(pairs), pa.int64()), pa.array(big["key"].view(np.int64))],
            "n": [none(len(pairs), pa.int64()), pa.array(big["n"].astype(np.int64))],
            "pos": [none(len(pairs), pa.int64()), pa.array(big["pos"].astype(np.int64))],
            "parts": [none(len(pairs), pa.int64()), pa.array(parts.astype(np.int64))],
        }
        return pa.table({k: pa.concat_arrays(v) for k, v in cols.items()})

    return packed.groupBy("bucket", "salt").applyInArrow(run, "a long, b long, key long, n long, pos long, parts long")


def texts_of(docs: DataFrame, nodes: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, text) of the nodes, compressed, and the table they are read from. A Bloom filter of fixed size on doc_id, broadcast, spares the other texts most of the work."""
    spark = docs.sparkSession
    wanted = materialize(sigs.join(nodes, "sig", "left_semi").select("doc_id").where("doc_id is not null"), "jaccard-wanted")

    def mark(batches):
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            bits[places(batch.column(0).to_numpy(zero_copy_only=False))] = True
        for k, block in enumerate(bits.reshape(-1, 1 << BLOCK_BITS)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(block).tobytes()], pa.binary())], ["block", "data"])

    def unite(batches):
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits[block] = bits.get(block, 0) | np.frombuffer(data, np.uint8)
        for block, x in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([x.tobytes()], pa.binary())], ["block", "data"])

    def places(ids: np.ndarray) -> np.ndarray:
        h = mixed(mixed(ids.astype(np.int64).view(np.uint64)))
        return np.concatenate([(h >> np.uint64(s)).astype(np.uint32) & np.uint32((1 << BLOOM_BITS) - 1) for s in (0, 19, 38)])

    parts = "block long, data binary"
    bloom = np.zeros((1 << (BLOOM_BITS - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in wanted.mapInArrow(mark, parts).repartition("block").mapInArrow(unite, parts).collect():  # 8 MB in all
        bloom[row["block"]] = np.frombuffer(row["data"], np.uint8)
    shared = spark.sparkContext.broadcast(bloom.reshape(-1))

    def texts(batches):
        hashes, bits = WordHashes(), shared.value
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = places(ids)
            keep = (bits[at >> 3] >> (7 - (at & 7)) & 1).reshape(3, -1).all(axis=0) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for text in batch.column(1).filter(pa.array(keep)).to_pylist():
                if len(grams := shingle_set(text, hashes)):
                    yield pa.RecordBatch.from_arrays([pa.array([signature(grams)]), pa.array([zlib.compress(text.encode(), 1)], pa.binary())], ["sig", "data"])

    found = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(texts, "sig long, data binary"), "jaccard-sets")
    # written before the shuffle, so that both sides of a join read one exchange; a set that several documents have is put together first
    return found.join(nodes, "sig", "left_semi").dropDuplicates(["sig"]), found


def suffix_filter(pairs: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the pairs whose sizes and range counts allow a link."""
    nodes = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    by_sig = materialize(sigs.join(nodes, "sig", "left_semi").select("sig", "n", "ranges"), "jaccard-by-sig")
    side = lambda c: by_sig.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("ranges").alias(f"r_{c}"))

    def make():
        def one(a, b, n_a, n_b, r_a, r_b):
            if 100 * min(n_a, n_b) >= percent * max(n_a, n_b) and most_shared(r_a, r_b, min(n_a, n_b)) >= least_overlap(n_a, n_b, percent):
                yield a, b

        return one

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return materialize(map_rows(both, make, "a long, b long"), "jaccard-pairs")


def verify(docs: DataFrame, pairs: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the pairs that link: suffix filter, then the whole sets. The table of texts goes when they are found."""
    left = suffix_filter(pairs, sigs, percent)
    nodes = materialize(left.select(F.col("a").alias("sig")).union(left.select("b")).distinct(), "jaccard-nodes")
    texts, table = texts_of(docs, nodes, sigs)
    side = lambda c: texts.select(F.col("sig").alias(c), F.col("data").alias(f"data_{c}"))
    both = left.join(side("a"), "a").join(side("b"), "b")

    def make():
        hashes, held, size = WordHashes(), {}, 0

        def grams(sig, data):
            nonlocal size
            if sig not in held:
                if size > HELD_GRAMS:
                    held.clear()
                    size = 0
                held[sig] = shingle_set(zlib.decompress(data).decode(), hashes)
                size += 100 + len(held[sig])
            return held[sig]

        def one(a, b, data_a, data_b):
            x, y = grams(a, data_a), grams(b, data_b)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                yield a, b

        return one

    return materialize(map_rows(both.select("a", "b", "data_a", "data_b"), make, "a long, b long"), "jaccard-links", replaces=table)


def components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("sig"), "component")


def stars(part: DataFrame) -> DataFrame:
    return part.where("sig <> component").select(F.col("component").alias("a"), F.col("sig").alias("b"))


def joined(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(info, part): doc_id, n and sig of every document; the component of every signature that has a link."""
    info, sketch = scan(docs)
    # copies are put together once, before the shuffle, so that no join by signature meets a group of them
    copies = info.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    sigs = materialize(copies, "jaccard-signatures")
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(64, total * (100 - percent) // 100 // BUCKET_ROWS)
    met = materialize(meet(postings(docs, sketch, buckets, percent), percent), "jaccard-met")
    pairs = materialize(met.where("b is not null").select("a", "b").distinct(), "jaccard-pairs")
    # a member's part differs from key to key, so that parts of one group meet in others
    part_of = F.pmod(F.xxhash64(F.pmod("key", F.lit(8 * ORDERS)), "sig"), F.col("parts"))
    large = met.where("key is not null").select("key", F.col("a").alias("sig"), "n", "pos", "parts").withColumn("deal", part_of)
    found = verify(docs, pairs, sigs, percent)

    def labelled() -> DataFrame:
        rows = large.join(part, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        split = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("parts").alias("parts")).where("lo < hi")
        split = split.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("deal"))
        return materialize(rows.join(split, ["key", "deal"], "left_semi"), "jaccard-large")

    part = components(found)
    rows = labelled()
    if not rows.isEmpty():
        # once more chains, in more orders and AHEAD members on, where those are in different components
        chain = W.partitionBy("key", "deal").orderBy(F.xxhash64(F.lit(1), F.pmod("key", F.lit(8 * ORDERS)), "sig"))
        next_ones = F.array(*[F.struct(F.lead("sig", k).over(chain).alias("y"), F.lead("component", k).over(chain).alias("other")) for k in range(1, AHEAD + 1)])
        near = rows.select(F.col("sig").alias("x"), "component", next_ones.alias("next"))
        near = near.select("x", F.explode(F.filter("next", lambda m: m["other"] != F.col("component"))).alias("m")).select("x", "m.y")
        near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        part = components(stars(part).unionByName(verify(docs, near, sigs, percent)))
        # all pairs of members that are in different components still
        rows = labelled()
    if not rows.isEmpty():
        x, y = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("sig", "n", "pos", "component")]) for s in "ab")
        small, big = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
        on = (x["key"] == y["key"]) & (F.col("sig_a") < F.col("sig_b")) & (F.col("component_a") != F.col("component_b"))
        rest = x.join(y, on & (100 * small >= percent * big) & (most >= need)).select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"))
        rest = rest.distinct().join(pairs, ["a", "b"], "left_anti")
        part = components(stars(part).unionByName(verify(docs, rest, sigs, percent)))
    return info, part


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows left-joined with table, which has one row a key.

    Keys of more than a part in SHARE of the rows, SHARE at most, are broadcast, so that no task of the shuffled join gets a large
    group; rows without a key join nothing and stay where they are.
    """
    n = rows.count()
    common = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * SHARE > n).select(key), "jaccard-common")
    table = materialize(table, "jaccard-table")
    hot = F.broadcast(table.join(F.broadcast(common), key, "left_semi"))
    there = rows.where(F.col(key).isNotNull())
    near = there.join(F.broadcast(common), key, "left_semi").join(hot, key, "left")
    far = there.join(F.broadcast(common), key, "left_anti").join(table, key, "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key]
    return near.unionByName(far).unionByName(rows.where(F.col(key).isNull()).select("*", *none))


def classed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n and class of every row; rows without words have no class."""
    info, part = joined(docs, percent)
    class_ = F.when(F.col("n") > 0, F.coalesce("component", "sig"))
    return materialize(look_up(info.select("doc_id", "n", "sig", "text_hash"), part, "sig").select("doc_id", "text_hash", "n", class_.alias("class")), "jaccard-classes")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = classed(docs, percent)
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return look_up(rows, least, "class").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of docs of each class, the first by doc_id (nulls last), hash of the text and hash of the row; rows without words all stay."""
    rows = classed(docs, percent).where("class is not null").groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    rows = materialize(rows, "jaccard-times")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    rows = look_up(rows, first, "class").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), stays.alias("stays"), "times")
    gone = materialize(rows.where("not stays").select("_id", "_hash"), "jaccard-gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    # 16 bytes a row: up to FEW_ROWS are broadcast, so the texts stay where they are; more are left to Spark's choice
    left = docs.join(F.broadcast(gone) if gone.limit(FEW_ROWS + 1).count() <= FEW_ROWS else gone, same, "left_anti")
    # a row that stays and is there more than once
    repeated = materialize(rows.where("stays and times > 1").select("_id", "_hash"), "jaccard-repeated")
    if repeated.isEmpty():
        return left
    whole = F.struct(*docs.columns)
    one = left.join(repeated, same).groupBy("_id", "_hash").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return left.join(repeated, same, "left_anti").unionByName(one.select("row.*"))


#: The result of jaccard_classes for tables in DuckDB: n-grams that two documents share, counted pair by pair.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT id, min(seen) AS component FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""
