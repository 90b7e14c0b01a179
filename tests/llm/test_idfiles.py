"""Files of token ids: exact round trips against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from reviewlake.llm import idfiles as I

PATH = public_tokenizers.path(I.VOCABULARY)


def by_hand(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df, **options):
    rows = I.token_report(df, **options).collect()
    return sorted(map(tuple, rows), key=lambda r: r[1])


ODD = ["<|endoftext|> a<|endoftext|>", "don't we'll 's 'S", "x y   z", "  two  spaces \n\n new\r\n", "日本語 текст ελ", "é è ÿ × ÷ ß", "a\tb\x0bc\x00d", "12 345é67", "tail   "]


@pytest.mark.parametrize("chunk_ids", [I.CHUNK_IDS, 1000])
def test_documents_come_back(spark, texts, docs, chunk_ids):
    rows = [(i, t) for i, t in texts] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = docs.select("doc_id", "text", "n", "h").unionByName(spark.createDataFrame([(i, t, 1, 2) for i, t in rows[len(texts) :]], "doc_id long, text string, n long, h long"))
    assert got(df.repartition(5), chunk_ids=chunk_ids) == by_hand(rows)


def test_null_and_repeated_ids(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == by_hand(rows) and got(empty) == []


def test_texts_of_a_third_of_all_ids(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30_000))
    rows = [(5, long)] + [(i * 10, long[: rng.randint(0, 3000)]) for i in range(40)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), chunk_ids=4096) == by_hand(rows)


def test_pieces_hold_the_ids(spark, docs, texts, tmp_path):
    folder = f"file://{tmp_path}/ids"
    I.write_ids(docs, folder, chunk_ids=512)
    found = {}
    for r in I.read_pieces(spark, folder).orderBy("start").collect():
        found.setdefault(r["doc_id"], []).extend(r["ids"])
    tok = Tokenizer.from_file(PATH)
    assert found == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}


def arrays():
    small, wide = st.integers(0, 300), st.integers(0, 2**32 - 1)
    return st.lists(st.one_of(small, small, small, wide), min_size=1, max_size=700)


@settings(max_examples=60, deadline=None)
@given(arrays(), st.integers(0, 700), st.integers(0, 700))
def test_any_ids_come_back_from_any_place(ids, a, b):
    data = I.write_chunk(np.array(ids, "<u4"), [(None, 0, len(ids), True)])
    chunk = I.Chunk(data)
    assert chunk.ids().tolist() == ids
    a, b = min(a, b, len(ids)), min(max(a, b), len(ids))
    assert chunk.ids(a, b).tolist() == ids[a:b]


def test_outliers_are_exceptions_and_blocks_are_small():
    rng = np.random.default_rng(1)
    ids = rng.integers(1000, 1064, 12_800).astype("<u4")
    ids[::64] = 50_000
    lowest, width, starts, except_starts, words, places, values = I.pack(ids)
    assert set(width) == {6} and len(values) == len(ids) // 64
    assert len(I.write_chunk(ids, [])) < len(ids) * 6 / 8 + 5 * len(values) + 13 * len(width) + 64


def test_checksums_of_pieces_join():
    rng = random.Random(4)
    for _ in range(30):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 50))
        assert I.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
