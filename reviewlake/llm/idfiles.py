"""Token ids in files of patched frame-of-reference blocks.

A block is 128 ids less their minimum, packed at a width under which a chosen percentile of them fits; the others are
exceptions, whose places and whole values stand in lists. The percentile is that of PERCENTILES which makes the block
smallest. A chunk is a run of blocks with an index of where each block's words and exceptions begin, so that a few
ids are read without unpacking the rest, and a table of the documents in it. A file is the chunks of one range of
document ids; a folder holds its files as a Parquet table (file, chunk, first, n, cut, data), which any store can hold. A chunk ends
where the next document would not fit; a document longer than a chunk goes over several, which `cut` marks.

Documents are dealt by ranges of doc_id, encoded, packed and written in one task per range, a chunk at a time, and
read back chunk by chunk without a shuffle: a document that goes over chunks is pieced together by its place, its
checksum from those of its pieces. Where a file begins among all ids is a running sum over one row a file.

Defined results: null text is empty, so a single end id; a null doc_id comes first; rows that repeat a doc_id are
documents of their own, in the order of a hash of their text; an empty table gives an empty table; texts are never
cut, and memory holds one text's ids and one chunk.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from reviewlake.llm.batches import map_rows
from reviewlake.llm.bpe import KEPT_LETTERS, NOT_PLAIN
from reviewlake.session import shared_dir

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK, CHUNK_IDS, KEPT_PARTS = 128, 1 << 18, 400_000
LITTLE = sys.byteorder == "little"
#: Candidates for the share of a block's ids that fit its width.
PERCENTILES = np.array([100, 98, 95, 90, 80])
BIT_LENGTH = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)
EXCEPTION_BYTES = 5
HEAD = struct.Struct("<4sIIIII")
MAGIC = b"PFR1"
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: The vocabulary's own division of texts, for texts of plain characters only (see NOT_PLAIN).
PLAIN_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")


# ids of texts


class PartIds(dict):
    """part of a text -> its ids as little-endian unsigned 32-bit numbers.

    At KEPT_PARTS the parts become the older generation, from which those still in use come back, and an older one goes.
    """

    def __init__(self, tok: Tokenizer):
        self.tok, self.older = tok, {}
        chars = "".join(map(chr, [*range(128), *range(0xC0, 0x100)]))
        spelled = {c: "".join(x for x, _ in tok.pre_tokenizer.pre_tokenize_str(c)) for c in chars}
        self.spelling = str.maketrans(spelled)

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.tok.model.tokenize(part.translate(self.spelling))])
            ids = (ids if LITTLE else ids.byteswap() or ids).tobytes()
        if len(part) <= KEPT_LETTERS:
            if len(self) >= KEPT_PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


@lru_cache(maxsize=1)
def id_maker(path: str):
    """text -> the library's ids as little-endian unsigned 32-bit numbers."""
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    parts = PartIds(tok)

    def ids(text: str | None) -> bytes:
        if not text:
            return b""
        if NOT_PLAIN.search(text) or any(s in text for s in special):
            return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(parts.__getitem__, PLAIN_PART.findall(text)))

    return ids


# blocks


def _places(width: int) -> list[tuple[int, int, int]]:
    """(id, word, shift) of a block's ids at a width."""
    return [(i, i * width >> 6, i * width & 63) for i in range(BLOCK)]


def pack(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """minima, widths, word starts, exception starts, words, exception places and values of ids in blocks."""
    n_blocks = -(-len(ids) // BLOCK)
    whole = np.empty(n_blocks * BLOCK, "<u4")
    whole[: len(ids)], whole[len(ids) :] = ids, ids[-1:].sum()
    whole = whole.reshape(n_blocks, BLOCK)
    lowest = whole.min(1) if n_blocks else np.zeros(0, "<u4")
    rest = whole - lowest[:, None]
    upper = rest >> np.uint32(16)
    bits = np.where(upper > 0, 16 + BIT_LENGTH[upper], BIT_LENGTH[rest & np.uint32(0xFFFF)]).astype(np.int64)
    fit = np.bincount((bits + 33 * np.arange(n_blocks)[:, None]).ravel(), minlength=33 * n_blocks).reshape(n_blocks, 33).cumsum(1)
    tried = np.stack([(fit >= -(-p * BLOCK // 100)).argmax(1) for p in PERCENTILES], 1)
    size = tried * (BLOCK // 8) + EXCEPTION_BYTES * (BLOCK - np.take_along_axis(fit, tried, 1))
    width = np.take_along_axis(tried, size.argmin(1)[:, None], 1)[:, 0] if n_blocks else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 64))])
    words = np.zeros(starts[-1], "<u8")
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        low = np.ascontiguousarray((rest[rows] & np.uint32((1 << int(w)) - 1)).T).astype(np.uint64)
        out = np.zeros((int(w) * BLOCK // 64, len(rows)), np.uint64)
        for i, word, shift in _places(int(w)):
            out[word] |= low[i] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= low[i] >> np.uint64(64 - shift)
        words[starts[rows][:, None] + np.arange(len(out))] = out.T
    row, place = np.nonzero(bits > width[:, None])
    counts = np.bincount(row, minlength=n_blocks)
    except_starts = np.concatenate([[0], np.cumsum(counts)])
    return lowest, width.astype("u1"), starts.astype("<u4"), except_starts.astype("<u4"), words, place.astype("u1"), rest[row, place].astype("<u4")


def unpack(lowest, width, starts, except_starts, words, places, values, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of blocks first to stop, whole blocks."""
    stop = len(width) if stop is None else stop
    mine = np.arange(first, stop)
    out = np.zeros((len(mine), BLOCK), np.uint64)
    for w in np.unique(width[mine]):
        w = int(w)
        if not w:
            continue
        rows = np.flatnonzero(width[mine] == w)
        packed = np.ascontiguousarray(words[starts[mine[rows]].astype(np.int64)[:, None] + np.arange(w * BLOCK // 64)].T)
        low, mask = np.empty((BLOCK, len(rows)), np.uint64), np.uint64((1 << w) - 1)
        for i, word, shift in _places(w):
            x = packed[word] >> np.uint64(shift)
            if shift + w > 64:
                x = x | packed[word + 1] << np.uint64(64 - shift)
            low[i] = x & mask
        out[rows] = low.T
    a, b = int(except_starts[first]), int(except_starts[stop])
    row = np.repeat(np.arange(len(mine)), np.diff(except_starts[first : stop + 1].astype(np.int64)))
    out[row, places[a:b]] = values[a:b]
    return (out + lowest[mine][:, None]).astype("<u4").ravel()


# chunks


def write_chunk(ids: np.ndarray, docs: list[tuple[int | None, int, int, bool]]) -> bytes:
    """ids and their documents (doc_id, ids of it in chunks before, ids of it here, whether it ends here) as bytes."""
    lowest, width, starts, except_starts, words, places, values = pack(ids)
    table = np.array([(d or 0, b, n, last, d is None) for d, b, n, last in docs], DOC)
    head = HEAD.pack(MAGIC, len(ids), len(width), len(words), len(values), len(table))
    return b"".join([head, *(x.tobytes() for x in (table, words, lowest, starts, except_starts, values, width, places))])


DOC = np.dtype([("doc_id", "<i8"), ("before", "<u8"), ("n", "<u4"), ("last", "u1"), ("no_id", "u1")])


class Chunk:
    """A chunk's arrays, read in place; ids are unpacked when asked for."""

    def __init__(self, data: bytes):
        magic, self.n, n_blocks, n_words, n_values, n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a chunk of token ids")
        at, out = HEAD.size, []
        for kind, n in ((DOC, n_docs), ("<u8", n_words), ("<u4", n_blocks), ("<u4", n_blocks + 1), ("<u4", n_blocks + 1), ("<u4", n_values), ("u1", n_blocks), ("u1", n_values)):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        self.docs, words, lowest, starts, except_starts, values, width, places = out
        self.parts = lowest, width, starts, except_starts, words, places, values

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids [start, stop) of the chunk, from the blocks that hold them only."""
        stop = self.n if stop is None else min(stop, self.n)
        first = start // BLOCK
        return unpack(*self.parts, first, max(first, -(-stop // BLOCK)))[start - first * BLOCK : stop - first * BLOCK]


# folders


def write_ids(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every text, end it with end_id, and write files of ids in ascending doc_id order to a new folder."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        ids_of, end = id_maker(path), np.array([end_id], "<u4").tobytes()
        held, docs, at = bytearray(), [], {"file": 0, "chunk": 0, "first": 0}

        def flush():
            ids = np.frombuffer(bytes(held), "<u4")
            row = at["file"], at["chunk"], at["first"], len(ids), not (docs[0][1] == 0 and docs[-1][3]), write_chunk(ids, docs)
            at["chunk"] += 1
            at["first"] += len(ids)
            held.clear()
            docs.clear()
            return row

        def one(file, doc_id, text):
            at["file"] = file
            data = memoryview(ids_of(text) + end)
            for done in range(0, len(data), 4 * chunk_ids):
                part = data[done : done + 4 * chunk_ids]
                if docs and len(held) + len(part) > 4 * chunk_ids:
                    yield flush()
                held.extend(part)
                docs.append((doc_id, done // 4, len(part) // 4, done + len(part) == len(data)))

        one.end = lambda: [flush()] if docs else []
        return one

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    files = map_rows(rows.select(F.spark_partition_id().alias("file"), "doc_id", "text"), make, "file int, chunk long, first long, n long, cut boolean, data binary")
    files.write.option("compression", "none").parquet(folder)


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, before, last, ids): runs of a document's ids with their place among all ids; before is its ids in earlier runs."""

    def make():
        def one(ahead, data):
            chunk, at = Chunk(data), 0
            ids = chunk.ids()
            for d in chunk.docs:
                n = int(d["n"])
                yield None if d["no_id"] else int(d["doc_id"]), ahead + at, int(d["before"]), bool(d["last"]), ids[at : at + n].tolist()
                at += n

        return one

    return map_rows(_chunks(spark, folder), make, "doc_id long, start long, before long, last boolean, ids array<long>")


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def make():
        def one(ahead, data):
            chunk, at = Chunk(data), 0
            ids = chunk.ids()
            for d in chunk.docs:
                n = int(d["n"])
                yield None if d["no_id"] else int(d["doc_id"]), ahead + at - int(d["before"]), int(d["before"]), n, zlib.crc32(ids[at : at + n]), bool(d["last"])
                at += n

        return one

    def piece():
        def one(doc_id, start, pieces):
            n, crc = 0, 0
            for p in pieces:
                crc, n = joined_crc(crc, p["crc"], 4 * p["n"]), n + p["n"]
            yield doc_id, start, n, crc

        return one

    part = "doc_id long, start long, before long, n long, crc long, last boolean"
    parts = map_rows(_chunks(spark, folder, "not cut"), make, part).select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = map_rows(_chunks(spark, folder, "cut"), make, part).groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("pieces"))
    return parts.unionByName(map_rows(cut, piece, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def joined_crc(a: int, b: int, n: int) -> int:
    """crc32 of two runs of bytes from those of both and the second's length: over bytes of a length the sum is affine."""
    zeros = bytes(n)
    return zlib.crc32(zeros, a) ^ zlib.crc32(zeros) ^ b


def _chunks(spark: SparkSession, folder: str, which: str = "true") -> DataFrame:
    """(ids before the chunk among all files, data)."""
    rows = spark.read.parquet(folder)
    sizes = rows.groupBy("file").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select("file", ahead.alias("ahead"))  # a row a file
    return rows.where(which).join(F.broadcast(ahead), "file").select((F.col("ahead") + F.col("first")).alias("ahead"), "data")


def token_report(docs: DataFrame, end_id: int = END_ID, path: str | None = None, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """read_report of files written to a new folder beside spark.checkpoint.dir's other tables."""
    import uuid

    folder = f"{shared_dir(docs.sparkSession)}/reviewlake/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, end_id, path, chunk_ids)
    return read_report(docs.sparkSession, folder)
