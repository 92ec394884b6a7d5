import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfmark.llm import packing
from shelfmark.llm.bpe import Encoder

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "  a  b", "a \n b", "a\n \nb", "x<|endoftext|>y", "it's  'tis\t q", "a\xa0 b　c", "\n\n a b\n ", "a \x1c b", "é‍ x", "a b ", "漢字 かな"]


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, length):
    """Pieces and places of every document, against the tokenizer."""
    want = []
    for doc_id, text in docs:
        ids = ids_of(text)
        first = len(ids) % length or min(length, len(ids))
        bounds = [0, *range(first, len(ids) + 1, length)]
        for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want.append((doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return held


def test_ids_equal_the_tokenizers():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab A1'é.\n\t  \xa0") for _ in range(40)) for _ in range(2000)]
    for text in texts:
        assert encoder.ids(text) == np.array(ids_of(text)[:-1], "<u4").tobytes(), repr(text)


def test_query_packs_every_document(spark):
    rows = packing.op1_best_fit(spark, SF).collect()
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    held = check(rows, docs, 2048)
    assert len(held) <= 1.03 * sum(len(ids_of(t)) for _, t in docs) / 2048 + 1


def test_edge_cases(spark, documents):
    docs = [(1, None), (2, ""), (3, "a b c " * 40), (3, "a b c " * 40), (4, "one"), (None, "x y"), (5, "word " * 500)]
    rows = packing.pack(packing.pieces(documents(docs), 32), 32, group_pieces=5).collect()
    check(rows, docs, 32)
    assert packing.pack(packing.pieces(documents([]), 32), 32).count() == 0


def test_sequences_hold_the_ids(spark, documents):
    docs = [(i, "tea and milk " * i) for i in range(9)]
    df = documents(docs)
    placed = packing.pack(packing.pieces(df, 16), 16)
    rows = placed.collect()
    got = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packing.sequences(df, placed, 16).collect()}
    for r in rows:
        assert got[r.sequence_id][r.offset:r.offset + r.length] == ids_of(dict(docs)[r.doc_id])[r.start:r.start + r.length]


def test_the_fullest_closes_first():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # 1 had the least room when 2 was opened
    assert bins.place(4) == (0, 6) and bins.place(3) == (3, 0) and bins.place(2) == (2, 8)
