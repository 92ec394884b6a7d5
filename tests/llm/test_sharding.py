import zlib

import duckdb
import numpy as np

from shelfmark.llm import sharding

SF = "/root/testdata/sf0.001"


def jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        ahead = int((at + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return at


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 2 ** 64, 500, np.uint64)
    for n in (1, 2, 7, 40, 1000):
        assert sharding.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(b[a != b]) <= {40}


def gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    return all(sorted(v) == list(range(len(v))) for v in by.values())


def test_query(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows = sharding.op8_jump_hash(spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert gapless(rows) and {r.law for r in rows} == {"key"} and all(0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) for r in rows)


def test_edge_cases(spark, documents):
    docs = [(1, None), (1, None), (2, ""), (None, "é"), (None, "é")] + [(7, "same")] * 300 + [(8, f"t{i}") for i in range(100)]
    rows = sharding.number(sharding.digests(documents(docs)), 3, group_rows=10).collect()
    assert len(rows) == len(docs) and gapless(rows) and len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert sharding.number(sharding.digests(documents([])), 3).count() == 0


def test_written_shards(spark, documents, tmp_path):
    sharding.write(documents([(i, f"text {i}") for i in range(50)]), str(tmp_path / "s"), shards=4, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in sharding.assign(documents([(i, f"text {i}") for i in range(50)]), shards=4).collect()}
