"""Question tables, parsed-once maps, snapshots, digests of large files, batch actions."""

import hashlib
import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ingest import SERVICES, put

from shelfmark import cli
from shelfmark.models import Embedder
from shelfmark.operators import bookmaps as B, fusion, ocr, staging as G
from shelfmark.plans.ingest import Ingest
from shelfmark.plans.library import Library
from shelfmark.plans.state_log import StateLog
from shelfmark.sources import files
from shelfmark.sources.config import Config, Kindle


def test_every_question_gets_its_own_nearest(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    vectors = [*base, *base[:20], *rng.normal(size=(300, 8)).astype(np.float32)]  # ties among copies
    rows = [(f"c{i:04d}", f"p{i // 2}", "b", "Ann" if i % 3 else "Bo", v.tolist()) for i, v in enumerate(vectors)]
    rows += [("none", "p", "b", "Ann", None), ("short", "p", "b", "Ann", [1.0]), ("nan", "p", "b", "Ann", [float("nan")] * 8), ("gap", "p", "b", "Ann", [None] * 8)]
    children = spark.createDataFrame(rows, "id string, parent_id string, book_id string, author string, vector array<float>").repartition(5)
    asked = [(i, v.tolist()) for i, v in enumerate(base[:12].astype(float))] + [(50, [0.0] * 8), (60, None), (61, [float("nan")] * 8), (62, [1.0, 2.0]), (63, [1.0])]
    questions = spark.createDataFrame(asked, "qid int, vector array<double>")
    for block, rows_at_once in ((1024, 2048), (5, 7)):
        monkeypatch.setattr(fusion, "QUESTIONS", block)
        monkeypatch.setattr("shelfmark.functions.similarity.ROWS_AT_ONCE", rows_at_once)
        got = {}
        for r in fusion.nearest_many(children, questions, 6, author="ann").orderBy("qid", "rn").collect():
            got.setdefault(r.qid, []).append((r.id, r.parent_id, r._distance))
        for qid, vector in asked:
            want = [] if vector is None else [tuple(r) for r in fusion.nearest(children, vector, 6, author="ann").collect()]
            assert got.get(qid, []) == want, qid
    assert fusion.nearest_many(children, questions.limit(0), 3).count() == 0


def test_map_warnings_of_any_json(spark):
    cases = ['{"author": null, "title": 5, "summary": {}, "key_themes": 1, "chapters": [{"title": "a", "key_arguments": ["k"]}]}', "{broken", "[1]", None, "5", "",
             '{"author":"a","title":"t","summary":"s","key_themes":[],"chapters":[1, {"title": null, "key_arguments": "no list"}]}']
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, j string")
    got = [r.w for r in rows.select("i", B.json_warnings(F.col("j")).alias("w")).orderBy("i").collect()]
    bad = ["not a JSON object"]
    assert got == [[], bad, bad, bad, bad, bad, [f"chapter {n} missing {x}" for n in (1, 2) for x in ("title", "key_arguments")]]


def test_snapshots_and_later_entries_equal_the_whole_log(spark, tmp_path):
    rng = np.random.default_rng(7)
    log = StateLog(spark, str(tmp_path / "state"))
    every = None
    assert log.current().count() == 0
    for batch in range(6):
        rows = [(f"f{rng.integers(6)}", f"k{rng.integers(3)}", None if rng.integers(5) == 0 else str(rng.integers(99)), int(rng.integers(4))) for _ in range(12)]
        changes = spark.createDataFrame(rows, "folder_id string, field string, value string, t int").dropDuplicates(["folder_id", "field", "t"]).select(
            "folder_id", "field", "value", F.timestamp_seconds("t").alias("at"))
        changes = spark.createDataFrame(changes.collect(), changes.schema)
        log.append(changes, batch)
        log.append(changes, batch)  # a repeated batch replaces itself
        new = changes.withColumn("seq", F.lit(batch).cast("bigint"))
        every = new if every is None else every.unionByName(new)
        if batch in (1, 2, 4):
            log.snapshot(batch)
            log.snapshot(batch)
        want = G.fold_log(every).select("folder_id", "field", "value", "created_at", "updated_at")
        assert sorted(map(str, log.current().select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert log.entries(4).select("seq").distinct().collect() == [(5,)]
    assert "batch=000000000005" in str(log.entries(4).inputFiles()) or "PartitionFilters" in log.entries(4)._jdf.queryExecution().executedPlan().toString()


def test_digest_of_a_file_beyond_one_cell(spark, tmp_path):
    put(tmp_path, "small file é.bin", b"abc" * 1000, 1)
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate(3 << 30)
    listing = spark.createDataFrame([(f"file:{tmp_path}/{n}", i) for i, n in enumerate(("small file é.bin", "big.bin", "absent"))], "path string, n int")
    got = {r.n: r for r in files.digests(listing).collect()}
    zeros, want = bytes(1 << 24), hashlib.sha256()
    for _ in range(3 << 6):
        want.update(zeros)
    assert got[0].sha256 == hashlib.sha256(b"abc" * 1000).hexdigest() and got[1].sha256 == want.hexdigest()
    assert got[2].sha256 is None and got[2].error


def test_one_document_at_once(spark):
    rows = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"")], "folder_id string, content binary")

    def recognise(content):
        if content == b"2":
            raise RuntimeError("no answer")
        return ["first", "", "third"] if content else []

    got = {r.folder_id: (r.raw_text, r.error) for r in ocr.convert_now(rows, recognise).collect()}
    assert got == {"a": ("first\n\n---\n\nthird", None), "b": (None, "no answer"), "c": (None, "no text was recognised")}


def services(cfg):
    return {"services": SERVICES, "sender": lambda *a: None, "builder": lambda text, about: text.encode(), "confirm": lambda key: True}


def test_batch_actions_and_services(spark, tmp_path, monkeypatch):
    from test_ocr_batches import FakeOcr
    box = tmp_path / "inbox"
    box.mkdir()
    put(box, "Scan.pdf", b"tiny", 1)
    put(box, "Book.epub", b"words", 2)
    cfg = SimpleNamespace(**{f: getattr(Config(), f) for f in ("cleanup", "conversion")}, kindle=Kindle(True, "k", "s", "r"),
                          paths=SimpleNamespace(staging=str(tmp_path / "work"), done=str(tmp_path / "done")))
    monkeypatch.setattr(cli, "load", lambda spec: {"s": services, "c": FakeOcr(tmp_path)}[spec])
    work = cli.ingest_of(spark, cfg, Library(spark, str(tmp_path / "index"), Embedder("tiny", 8), 2), "s")
    assert isinstance(work, Ingest) and work.kindle.configured and work.kindle.confirm("x")
    work.run_once(files.inbox(spark, str(box)))
    assert work.done().count() == 1 and len(list((tmp_path / "done").rglob("Book.epub"))) == 1
    run = lambda *a: cli.run_batch(cli.parser().parse_args(["batch", *a]), work, str(tmp_path / "ocr"))
    assert [r.original_name for r in run("pending").collect()] == ["Scan.pdf"]
    with pytest.raises(SystemExit):
        run("submit")
    assert run("submit", "--client", "c") == "batch-1" and run("submit", "--client", "c") == "nothing to submit"
    assert [r.status for r in run("status", "--client", "c").collect()] == ["RUNNING"] and [r.status for r in run("list").collect()] == ["QUEUED"]
    assert run("poll", "--client", "c") == "0 batches closed"
    (tmp_path / "ready").touch()
    assert run("poll", "--client", "c") == "1 batches closed"
    work.run_once()
    assert work.done().count() == 2 and run("pending").count() == 0
    with pytest.raises(SystemExit):
        run("cancel", "--client", "c")
    assert run("cancel", "batch-1", "--client", "c") == "CANCELLED" and json.dumps([r.status for r in run("list").collect()]) == '["cancelled"]'
