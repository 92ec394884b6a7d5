import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.models import Embedder
from shelfmark.operators import conversion, delivery as D, ocr, staging as G, triage as T
from shelfmark.plans.ingest import Ingest, Readers
from shelfmark.plans.library import Library
from shelfmark.sources import files, readers
from shelfmark.sources.config import Kindle
from shelfmark.streaming.inbox import watch


def fake_probe(data):
    text = data.decode("utf-8", "replace")
    return {"avg_chars_per_page": float(len(text)), "sampled_pages": 1, "total_pages": 1,
            "classification": "native" if len(text) >= 100 else "scanned"}


def fake_epub(data):
    if data == b"broken":
        raise RuntimeError("bad archive")
    return "# " + data.decode()


SERVICES = Readers(probe=fake_probe, native_pdf=lambda d: (d.decode(), 1), epub=fake_epub)


def put(folder, name, data, at):
    path = folder / name
    path.write_bytes(data)
    os.utime(path, (at, at))


@pytest.fixture
def ingest(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "index"), Embedder(name="tiny", dims=8), buckets=2)
    return Ingest(spark, str(tmp_path / "work"), lib, SERVICES)


@pytest.fixture
def drop(tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    put(box, "Zed - Later.epub", b"same bytes", 2000)
    put(box, "Abe - First Book (2001).epub", b"same bytes", 1000)
    put(box, "Thick.PDF", ("T he thick text. " * 40).encode(), 1500)
    put(box, "Medium.pdf", ("thin page " * 20).encode(), 1600)
    put(box, "Scan.pdf", b"tiny", 1700)
    put(box, "notes.txt", b"plain", 1800)
    put(box, "Bad.epub", b"broken", 1900)
    put(box, ".hidden.epub", b"h", 100)
    put(box, "half.epub.part", b"p", 100)
    return box


def test_conversion_resumes_by_page_range(spark, tmp_path):
    """Ranges that were stored are not converted again after one of them failed."""
    seen, down = tmp_path / "seen", tmp_path / "down"
    seen.mkdir()
    down.touch()
    pages = lambda d: {"avg_chars_per_page": 900.0, "sampled_pages": 1, "total_pages": 120, "classification": "native"}

    def convert(data, first, stop):
        (seen / f"{first}-{len(list(seen.iterdir()))}").touch()
        if first == 50 and down.exists():
            raise RuntimeError("no memory")
        return f"pages {first} to {stop} " + "word " * 30_000

    box = tmp_path / "inbox"
    box.mkdir()
    put(box, "Long.pdf", b"%PDF", 1000)
    job = Ingest(spark, str(tmp_path / "work"), Library(spark, str(tmp_path / "index"), Embedder("tiny", 8), 2), Readers(probe=pages, page_range=convert))
    job.stage(files.inbox(spark, str(box)))
    job.convert()
    assert [(r.outcome, r.error) for r in job.table("raw", "folder_id string, outcome string, error string").collect()] == [("failed", "no memory")]
    down.unlink()
    job.convert(retry=True)
    assert sorted(int(p.name.split("-")[0]) for p in seen.iterdir()) == [0, 50, 50, 100]
    text = job.table("raw", "folder_id string, raw_text string, outcome string").where("outcome = 'ok'").first().raw_text
    assert [text.index(f"pages {n} to") for n in (0, 50, 100)] == sorted(text.index(f"pages {n} to") for n in (0, 50, 100))


def test_files_of_one_name_are_two_books(spark, ingest, tmp_path):
    for folder, body, at in (("a", b"first mill", 1000), ("b", b"second mill", 2000)):
        (tmp_path / folder).mkdir()
        put(tmp_path / folder, "Mill Book.epub", body, at)
    for folder in ("a", "b"):
        ingest.run_once(files.inbox(spark, str(tmp_path / folder)))
    both = ingest.library.indexed_books().collect()
    assert len(both) == 2 and "mill-book" in {r.book_id for r in both}
    assert ingest.library.search("first", 5, "keyword").count() == ingest.library.search("second", 5, "keyword").count() == 1


def test_inbox_order_and_filters(spark, drop):
    names = [r.name for r in files.oldest_first(files.inbox(spark, str(drop))).collect()]
    assert names[0] == "half.epub.part" and names[1].startswith("Abe") and ".hidden.epub" not in names
    assert "Exchange" not in files.inbox(spark, str(drop))._jdf.queryExecution().executedPlan().toString()  # no contents are moved
    assert sorted(r.name for r in files.epub_files(spark, str(drop)).collect()) == [
        "Abe - First Book (2001).epub", "Bad.epub", "Zed - Later.epub"]


def test_stream_runs_every_stage(spark, ingest, drop, tmp_path):
    query = watch(ingest, str(drop), str(tmp_path / "cp"), per_trigger=3)
    query.awaitTermination()
    assert query.exception() is None
    staged = {r.original_name: r for r in ingest.staged().collect()}
    assert set(staged) <= {"Abe - First Book (2001).epub", "Zed - Later.epub", "Thick.PDF", "Medium.pdf", "Scan.pdf", "Bad.epub"}
    assert len([n for n in staged if n[:3] in ("Abe", "Zed")]) == 1  # one of the two copies
    assert {staged[n].staging_category for n in ("Thick.PDF", "Medium.pdf")} == {"local"}
    assert staged["Scan.pdf"].staging_category == "cloud"
    assert sorted(r.original_name for r in ingest.quarantined().collect()) == ["Bad.epub", "notes.txt"]
    raw = {r.folder_id: r for r in ingest.table("raw", "folder_id string, outcome string, error string").collect()}
    assert raw[staged["Bad.epub"].folder_id].error == "bad archive"
    assert raw[staged["Medium.pdf"].folder_id].outcome == "reclassify"
    assert staged["Scan.pdf"].folder_id not in raw
    indexed = {r.book_id for r in ingest.library.indexed_books().collect()}
    assert "thick" in indexed and len(indexed) == 2
    assert [r.book_id for r in ingest.library.search("thick", 3, "keyword").collect()] == ["thick"]
    assert ingest.done().count() == 2


def test_rerun_changes_nothing(spark, ingest, drop):
    arrivals = files.inbox(spark, str(drop)).where(T.finished(F.col("name")))
    ingest.run_once(arrivals)
    first = {n: ingest.table(n, "folder_id string").count() for n in ("staged", "quarantined", "raw", "clean", "indexed", "sent")}
    ingest.run_once(arrivals)
    assert first == {n: ingest.table(n, "folder_id string").count() for n in first}
    assert ingest.table("done", "folder_id string").count() == first["sent"] == 2
    kept = {r.original_name for r in ingest.staged().collect()}
    assert "Abe - First Book (2001).epub" in kept and "Zed - Later.epub" not in kept  # the older copy


def test_failed_index_is_retried(spark, ingest, drop):
    ingest.stage(files.inbox(spark, str(drop)).where(T.finished(F.col("name"))))
    ingest.convert()
    ingest.clean()
    ingest.name()
    add, ingest.library.add_books = ingest.library.add_books, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("down"))
    with pytest.raises(RuntimeError):
        ingest.index()
    assert ingest.done().count() == 0
    ingest.library.add_books = add
    ingest.index()
    ingest.deliver()
    ingest.archive()
    assert ingest.done().count() == 2
    assert {r.is_done for r in ingest.state().where("has_clean").collect()} == {True}


def test_scanned_books_come_back_from_ocr(spark, ingest, drop):
    ingest.run_once(files.inbox(spark, str(drop)).where(T.finished(F.col("name"))))
    waiting = {r.original_name: r for r in ingest.state().where("staging_category = 'cloud'").collect()}
    assert set(waiting) == {"Scan.pdf", "Medium.pdf"} and waiting["Medium.pdf"].reclassified_from == "local"
    results = spark.createDataFrame([(r.folder_id, f"recognised {n}") for n, r in waiting.items()], "custom_id string, raw_text string")
    ingest.accept_ocr(results)
    ingest.accept_ocr(results)  # a repeated poll adds nothing
    ingest.run_once()
    assert {r.book_id for r in ingest.library.search("recognised", 5, "keyword").collect()} == {"scan", "medium"}
    assert ingest.done().count() == 4


def test_cloud_engine_takes_native_pdfs(spark, tmp_path, drop):
    services = Readers(probe=fake_probe, native_pdf=SERVICES.native_pdf, epub=fake_epub, cloud_pdf=lambda d: ("cloud text", 2))
    for engine, methods in (("cloud", {"cloud", "epub"}), ("local", {"native", "epub"})):
        lib = Library(spark, str(tmp_path / engine / "index"), Embedder(name="tiny", dims=8), buckets=2)
        job = Ingest(spark, str(tmp_path / engine), lib, services, pdf_engine=engine)
        job.stage(files.inbox(spark, str(drop)).where(T.finished(F.col("name"))))
        job.convert()
        assert {r.method for r in job.table("raw", "method string").collect()} == methods


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "a-b.md").write_text("# A\n\nx\n", encoding="utf-8")
    (tmp_path / "c.md").write_text("y", encoding="utf-8")
    (tmp_path / "d.txt").write_text("z", encoding="utf-8")
    assert {r.book_id: r.text for r in files.markdown_books(spark, str(tmp_path)).collect()} == {"a-b": "# A\n\nx\n", "c": "y"}
    assert files.markdown_books(spark, str(tmp_path), "c").first().text == "y"


def test_epub_reader():
    import io
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="urn:o"><manifest><item id="b" href="2.xhtml"/><item id="a" href="1.xhtml"/></manifest>'
                              '<spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/1.xhtml", "<html><head><title>t</title></head><body><h1>One</h1><p>first\n line</p></body></html>")
        z.writestr("O/2.xhtml", "<html><body><h2>Two</h2><p>second<br/>row</p></body></html>")
    assert readers.epub_markdown(data.getvalue()) == "# One\n\nfirst line\n\n## Two\n\nsecond\nrow\n"


def test_sample_positions(spark):
    rows = spark.createDataFrame([(0,), (1,), (5,), (6,), (103,)], "n int")
    got = [r.p for r in rows.select(T.sample_positions(F.col("n")).alias("p")).collect()]
    assert got == [[], [0], [0, 1, 2, 3, 4], [0, 1, 2, 3, 4], [0, 20, 41, 61, 82]]


def test_page_ranges_and_resume(spark):
    docs = spark.createDataFrame([("f", 120), ("g", 0)], "file string, total_pages int")
    items = conversion.work_items(docs)
    assert [(r.part, r.first, r.stop) for r in items.orderBy("part").collect()] == [(0, 0, 50), (1, 50, 100), (2, 100, 120)]
    have = spark.createDataFrame([("f", 1)], "file string, part int")
    assert sorted(r.part for r in conversion.remaining(items, have).collect()) == [0, 2]


def test_parallel_conversion_and_failure(spark):
    docs = spark.createDataFrame([("ok", 230), ("bad", 120)], "file string, total_pages int")

    def converter(file, first, stop):
        if file == "bad" and first == 100:
            raise ValueError("page fault")
        return f"{file}:{first}-{stop}"

    done = {r.file: r for r in conversion.whole_documents(conversion.convert(conversion.work_items(docs, 2), converter)).collect()}
    assert done["ok"].raw_text == "\n\n".join(f"ok:{i}-{i + 2}" for i in range(0, 230, 2)) and done["ok"].error is None
    assert done["bad"].raw_text is None and done["bad"].error == "page fault"


def test_lifecycle_flags(spark):
    schema = "folder_id string, created_at string, is_locked boolean, has_meta boolean, has_clean boolean, is_done boolean"
    s = spark.createDataFrame([("a", "2", False, True, False, False), ("b", None, False, True, False, False), ("c", "1", True, True, False, False),
                               ("d", "1", False, True, True, False), (".x", "0", False, True, False, False)], schema)
    assert [r.folder_id for r in G.pending(s).collect()] == ["b", "a"]
    assert [r.folder_id for r in G.ready_for_fanout(s).collect()] == ["d"]
    locked = G.set_flag(s, "is_locked", spark.createDataFrame([("a",)], "folder_id string"))
    assert [r.folder_id for r in G.pending(locked).collect()] == ["b"]
    done = G.set_flag(s, "is_done", spark.createDataFrame([("d",)], "folder_id string"))
    assert G.ready_for_fanout(done).count() == 0


def test_meta_merge_keeps_creation_time(spark):
    old = spark.createDataFrame([("a", "x", None, 1, 1)], "folder_id string, k1 string, k2 string, created_at int, updated_at int")
    new = spark.createDataFrame([("a", None, "z", 5), ("b", "y", None, 5)], "folder_id string, k1 string, k2 string, updated_at int")
    got = {r.folder_id: (r.k1, r.k2, r.created_at, r.updated_at) for r in G.merge_meta(old, new).collect()}
    assert got == {"a": ("x", "z", 1, 5), "b": ("y", None, 5, 5)}


def test_ocr_batch(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join([
        json.dumps({"custom_id": "a", "response": {"body": {"pages": [{"index": 0, "markdown": "p1"}, {"index": 1, "markdown": ""}, {"index": 2, "markdown": "p3"}]}}}),
        "", json.dumps({"custom_id": "b", "response": {"body": {"pages": []}}}), json.dumps({"custom_id": "zz"})]))
    got = {r.custom_id: (r.raw_text, r.batch_status, r.raw_chars) for r in ocr.result_texts(files.ocr_results(spark, str(tmp_path / "r.jsonl"))).collect()}
    assert got == {"a": ("p1\n\np3", "complete", 6), "b": (None, "failed", None), "zz": (None, "failed", None)}
    batches = spark.createDataFrame([("b1", {"a": "x"}, "queued"), ("b2", {}, "complete")], "batch_id string, folders map<string,string>, status string")
    assert [r.batch_id for r in ocr.open_batches(batches).collect()] == ["b1"]
    assert ocr.with_status(batches, "b1", "cancelled").where("status = 'cancelled'").count() == 1
    line = json.loads(spark.range(1).select(ocr.request_line(F.lit("c"), F.lit("f"), "m").alias("l")).first().l)
    assert line == {"custom_id": "c", "method": "POST", "url": "/v1/ocr", "body": {"model": "m", "document": {"type": "file_id", "file_id": "f"}}}


def test_delivery(spark):
    rows = spark.createDataFrame(
        [("a", "epub", "T: 1", "Au", "d", ["s"], "", b"E"), ("b", "pdf", "T2", "", "d", ["s"], "text", b"P"), ("c", "pdf", "fail", "", "d", [], "x", b"")],
        "folder_id string, file_type string, title string, author string, description string, subjects array<string>, clean_text string, content binary")
    off = D.deliver(rows, D.Delivery(Kindle())).collect()
    assert all(r.sent for r in off)
    unset = D.deliver(rows, D.Delivery(Kindle(enabled=True))).collect()
    assert not any(r.sent for r in unset)

    def send(subject, name, content):
        if (subject, name, content) not in {("T: 1 — Au", "source.epub", b"E"), ("T2", "T2.epub", b"BUILT text T2")}:
            raise RuntimeError(subject)

    def build(text, about):
        return f"BUILT {text} {about['title']}".encode()

    on = Kindle(enabled=True, kindle_email="k", sender_email="s", resend_api_key="r")
    got = {r.folder_id: (r.sent, r.outbox_name) for r in D.deliver(rows, D.Delivery(on, send, build)).collect()}
    assert got == {"a": (True, None), "b": (True, None), "c": (False, "fail.epub")}
