"""Calls that are made once, branches that do not stop each other, copies known from stream state."""

import os

import pytest
from pyspark.sql import functions as F
from test_ingest import SERVICES, fake_epub, put

from shelfmark.models import Embedder
from shelfmark.operators import delivery as D
from shelfmark.plans.ingest import ARCHIVED_DDL, BRANCHES_DDL, SENT_DDL, Ingest, Readers
from shelfmark.plans.library import Library
from shelfmark.sources import files
from shelfmark.sources.config import Kindle
from shelfmark.sources.ledger import Ledger, Unconfirmed, key_of
from shelfmark.streaming.inbox import watch

ON = Kindle(enabled=True, kindle_email="reader", sender_email="s", resend_api_key="r")


class Counter:
    """Counts calls over processes: a file per call."""

    def __init__(self, folder):
        self.folder = str(folder)
        os.makedirs(self.folder, exist_ok=True)

    def add(self, name):
        with open(os.path.join(self.folder, f"{name}-{len(os.listdir(self.folder))}"), "w"):
            pass

    def names(self):
        return sorted(n.rsplit("-", 1)[0] for n in os.listdir(self.folder))


def job(spark, root, services=SERVICES, **more):
    return Ingest(spark, str(root / "work"), Library(spark, str(root / "index"), Embedder("tiny", 8), 2), services, **more)


@pytest.fixture
def box(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    put(folder, "Ann - One.epub", b"first mill", 1000)
    put(folder, "Bob - Two.epub", b"second loom", 2000)
    return folder


def test_ledger_keeps_results_and_intents(tmp_path):
    ledger, calls = Ledger(f"file:{tmp_path}/l"), []
    key = key_of("a", 1)
    assert ledger.value(key) is None and ledger.kept(key, lambda: calls.append(1) or {"x": "é"}) == {"x": "é"}
    assert Ledger(f"file://{tmp_path}/l").kept(key, lambda: calls.append(2)) == {"x": "é"} and calls == [1]
    with pytest.raises(ValueError):
        ledger.kept(key_of("b"), lambda: int("x"))
    assert ledger.kept(key_of("b"), lambda: 5) == 5  # a call that raised is made again

    def dies():
        calls.append("sent")
        raise SystemExit

    with pytest.raises(SystemExit):
        ledger.once(key_of("c"), dies)
    with pytest.raises(Unconfirmed):
        ledger.once(key_of("c"), dies)
    ledger.once(key_of("c"), dies, confirm=lambda k: k == key_of("c"))
    ledger.once(key_of("c"), dies)
    assert calls == [1, "sent"]
    with pytest.raises(ValueError):
        ledger.once(key_of("d"), lambda: int("x"))
    ledger.once(key_of("d"), lambda: calls.append("d"))
    assert calls[-1] == "d"


def test_a_task_that_dies_after_sending_does_not_send_twice(spark, tmp_path):
    rows = spark.createDataFrame(
        [(n, "epub", n, "", "d", ["s"], "", b"E") for n in ("a", "b")],
        "folder_id string, file_type string, title string, author string, description string, subjects array<string>, clean_text string, content binary").coalesce(1)
    sent, down = Counter(tmp_path / "sent"), tmp_path / "down"
    down.touch()

    def send(subject, name, content):
        sent.add(subject)
        if subject == "b" and down.exists():
            raise SystemExit  # the worker is gone; the mail is out

    ledger = str(tmp_path / "ledger")
    with pytest.raises(Exception):
        D.deliver(rows, D.Delivery(ON, send), ledger)
    down.unlink()
    again = {r.folder_id: r.sent for r in D.deliver(rows, D.Delivery(ON, send), ledger).collect()}
    assert sent.names() == ["a", "b"] and again == {"a": True, "b": False}  # nobody knows about b
    asked = {r.folder_id: r.sent for r in D.deliver(rows, D.Delivery(ON, send, confirm=lambda key: True), ledger).collect()}
    assert sent.names() == ["a", "b"] and asked == {"a": True, "b": True}
    D.deliver(rows, D.Delivery(Kindle(True, "another", "s", "r"), send), ledger)
    assert sent.names() == ["a", "a", "b", "b"]  # another address is another delivery


def test_a_failing_branch_leaves_the_others_and_is_repeated_alone(spark, box, tmp_path):
    sent = Counter(tmp_path / "sent")
    work = job(spark, tmp_path, kindle=D.Delivery(ON, lambda subject, name, content: sent.add("mail")), done_folder=str(tmp_path / "done"))
    add, work.library.add_books = work.library.add_books, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("index is down"))
    work.run_once(files.inbox(spark, str(box)))
    rows = {(r.branch, r.ok, r.error) for r in work.table("branches", BRANCHES_DDL).collect()}
    assert rows == {("index", False, "index is down"), ("deliver", True, None), ("archive", True, None)}
    assert sent.names() == ["mail"] * 2 and work.done().count() == 0
    copies = work.table("archived", ARCHIVED_DDL).collect()
    assert sorted(open(r.copied_to, "rb").read() for r in copies) == [b"first mill", b"second loom"]
    work.library.add_books = add
    assert work.run_once() is None and work.done().count() == 2
    later = work.table("branches", BRANCHES_DDL).groupBy("branch").count().collect()
    assert {r.branch: r["count"] for r in later} == {"index": 4, "deliver": 2, "archive": 2}
    assert sent.names() == ["mail"] * 2 and work.table("sent", SENT_DDL).count() == 2


def test_maps_are_made_once_and_never_stop_the_index(spark, box, tmp_path):
    asked, down = Counter(tmp_path / "asked"), tmp_path / "down"
    down.touch()

    def model(kind, prompt):
        asked.add("one" if "ann-one" in prompt else "two")
        if "ann-one" in prompt and down.exists():
            raise RuntimeError("quota")
        return {"author": "The Author", "title": "The Title", "summary": "s", "key_themes": [], "chapters": []}, {"prompt_tokens": 3}

    work = job(spark, tmp_path, map_model=model)
    work.run_once(files.inbox(spark, str(box)))
    assert work.library.indexed_books().count() == 2 and {r.id for r in work.maps().collect()} == {"bob-two"}
    by = {r.book_id: r.author for r in work.library.parents().select("book_id", "author").distinct().collect()}
    assert by["bob-two"] == "The Author" and by["ann-one"] != "The Author"  # indexed without its map
    down.unlink()
    work.run_once()
    work.run_once()
    assert {r.id for r in work.maps().collect()} == {"ann-one", "bob-two"} and asked.names() == ["one", "one", "two"]
    # maps lost, the ledger is not: nothing is paid again
    lost = job(spark, tmp_path, map_model=model)
    lost.maps = lambda: spark.createDataFrame([], work.maps().schema)
    lost.make_maps()
    assert asked.names() == ["one", "one", "two"]


@pytest.mark.parametrize("cloud", [True, False])
def test_a_run_that_dies_converts_only_the_other_ranges(spark, tmp_path, cloud):
    seen, down = Counter(tmp_path / "seen"), tmp_path / "down"
    down.touch()
    pages = lambda d: {"avg_chars_per_page": 900.0, "sampled_pages": 1, "total_pages": 250, "classification": "native"}

    def convert(data, first, stop):
        seen.add(f"{data.decode()}:{first}")
        if first == 100 and down.exists():
            if data == b"dies":
                raise SystemExit
            raise RuntimeError("bad page")
        return f"{data.decode()} {first}-{stop} " + "word " * 20_000

    box = tmp_path / "inbox"
    box.mkdir()
    put(box, "Dies.pdf", b"dies", 1000)
    services = Readers(probe=pages, **({"cloud_range": convert} if cloud else {"page_range": convert}))
    work = job(spark, tmp_path, services)
    work.stage(files.inbox(spark, str(box)))
    with pytest.raises(Exception):
        work.convert()
    before = seen.names()
    starts = [f"dies:{n}" for n in range(0, 250, 100 if cloud else 50)]
    assert "dies:0" in before and "dies:200" not in before
    down.unlink()
    work.convert()
    assert seen.names() == sorted(starts + ["dies:100"])  # the range that died, and no other, was asked for twice
    rows = work.table("raw", "folder_id string, raw_text string, outcome string, method string").collect()
    assert [(r.outcome, r.method) for r in rows] == [("ok", "cloud" if cloud else "native")] and rows[0].raw_text.index("dies 0-") < rows[0].raw_text.index("dies 200-")


def test_one_failing_range_fails_its_book_only(spark, tmp_path):
    pages = lambda d: {"avg_chars_per_page": 900.0, "sampled_pages": 1, "total_pages": 150, "classification": "native"}

    def convert(data, first, stop):
        if data == b"bad" and first == 100:
            raise RuntimeError("bad page")
        return "word " * 30_000

    box = tmp_path / "inbox"
    box.mkdir()
    put(box, "Good.pdf", b"good", 1000)
    put(box, "Bad.pdf", b"bad", 1000)
    work = job(spark, tmp_path, Readers(probe=pages, cloud_range=convert))
    work.stage(files.inbox(spark, str(box)))
    work.convert()
    got = work.table("raw", "folder_id string, outcome string, error string").join(work.staged().select("folder_id", "original_name"), "folder_id").collect()
    assert {(r.original_name, r.outcome, r.error) for r in got} == {("Good.pdf", "ok", None), ("Bad.pdf", "failed", "bad page")}


def test_copies_are_known_from_stream_state(spark, box, tmp_path):
    """Across batches, restarts and files staged before the stream began; a replayed batch stages nothing twice."""
    work = job(spark, tmp_path, Readers(probe=SERVICES.probe, native_pdf=SERVICES.native_pdf, epub=fake_epub))
    old = tmp_path / "old"
    old.mkdir()
    put(old, "Old.epub", b"before the stream", 500)
    work.stage(files.inbox(spark, str(old)))
    put(box, "Copy of old.epub", b"before the stream", 3000)
    put(box, "Z copy of one.epub", b"first mill", 4000)
    run = lambda: watch(work, str(box), str(tmp_path / "cp")).awaitTermination()
    work.run_once = lambda *a, **k: None
    run()
    staged = lambda: sorted(r.original_name for r in work.staged().collect())
    assert staged() == ["Ann - One.epub", "Bob - Two.epub", "Old.epub"]
    put(box, "Late copy.epub", b"second loom", 5000)
    put(box, "New.epub", b"third gear", 6000)
    work.run_once = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("down after staging"))
    with pytest.raises(Exception):
        run()
    assert staged() == ["Ann - One.epub", "Bob - Two.epub", "New.epub", "Old.epub"]
    work.run_once = lambda *a, **k: None
    run()  # the batch again
    assert staged() == ["Ann - One.epub", "Bob - Two.epub", "New.epub", "Old.epub"]


def test_stream_does_not_read_the_stored_digests(spark, box, tmp_path):
    work = job(spark, tmp_path)
    work.run_once = lambda *a, **k: None
    watch(work, str(box), str(tmp_path / "cp")).awaitTermination()
    put(box, "More.epub", b"more", 7000)
    plans = []
    fresh = work.stage_fresh
    work.stage_fresh = lambda batch, name: (plans.append(batch._jdf.queryExecution().executedPlan().toString()), fresh(batch, name))
    work.staged().write.mode("append").parquet(str(tmp_path / "work" / "staged"))
    query = watch(work, str(box), str(tmp_path / "cp"))
    query.awaitTermination()
    assert work.staged().where(F.col("original_name") == "More.epub").count() == 1
    assert query.lastProgress is None or query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] >= 2
