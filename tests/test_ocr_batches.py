import json
import os

from shelfmark.models import RateLimited, patient
from shelfmark.operators.bookmaps import parse_answer
from shelfmark.plans.ocr_batches import OcrBatches
from shelfmark.sources import files

import pytest


class FakeOcr:
    """Keeps its state in files because uploads happen in the tasks."""

    def __init__(self, folder):
        self.folder = str(folder)

    def upload(self, name, content):
        return f"id-{name}-{len(content)}"

    def submit(self, request_path):
        lines = [json.loads(l) for f in os.listdir(request_path) if f.startswith("part") for l in open(f"{request_path}/{f}")]
        json.dump(lines, open(f"{self.folder}/sent.json", "w"))
        return "batch-1", "req-1", "QUEUED"

    def status(self, batch_id):
        return "SUCCESS" if os.path.exists(f"{self.folder}/ready") else "RUNNING"

    def download(self, batch_id, target):
        os.makedirs(target)
        with open(f"{target}/r.jsonl", "w") as out:
            for line in json.load(open(f"{self.folder}/sent.json")):
                out.write(json.dumps({"custom_id": line["custom_id"], "response": {"body": {"pages": [{"index": 0, "markdown": line["body"]["document"]["file_id"]}]}}}) + "\n")
            out.write(json.dumps({"custom_id": "stranger"}) + "\n")

    def cancel(self, batch_id):
        return "CANCELLED"


def staging(spark):
    return spark.createDataFrame([("a", "cloud", 1500, b"xx"), ("b", "cloud", 500, b"y"), ("c", "local", 9, b"z")],
                                 "folder_id string, staging_category string, page_count int, content binary")


def test_submit_poll_cycle(spark, tmp_path):
    jobs = OcrBatches(spark, str(tmp_path / "ocr"), FakeOcr(tmp_path))
    rows = staging(spark)
    assert jobs.preview(rows).first() == (2, 2000, 2.0)
    assert jobs.submit(rows) == "batch-1"
    assert jobs.submit(rows) is None  # nothing is sent twice
    assert [tuple(r) for r in jobs.status().collect()] == [("batch-1", "RUNNING", 2, 2000, 2.0)]
    assert jobs.poll(rows) == []
    (tmp_path / "ready").touch()
    assert jobs.poll(rows) == ["batch-1"] and jobs.poll(rows) == []
    assert {r.custom_id: r.raw_text for r in jobs.results().collect()} == {"a": "id-a.pdf-2", "b": "id-b.pdf-1"}
    assert jobs.pending(rows).count() == 0


def test_cancelled_batch_is_closed(spark, tmp_path):
    jobs = OcrBatches(spark, str(tmp_path / "ocr"), FakeOcr(tmp_path))
    jobs.submit(staging(spark))
    assert jobs.cancel("batch-1") == "CANCELLED"
    assert jobs.status().count() == 0 and jobs.batches().first().status == "cancelled"


def test_a_failed_batch_frees_its_folders_and_stops_no_other(spark, tmp_path):
    class Several(FakeOcr):
        n, states = 0, {}

        def submit(self, request_path):
            super().submit(request_path)
            self.n += 1
            return f"batch-{self.n}", "req", "QUEUED"

        def status(self, batch_id):
            if self.states[batch_id] == "down":
                raise OSError("no answer")
            return self.states[batch_id]

        def download(self, batch_id, target):
            if batch_id == "batch-3":
                raise OSError("gone")
            super().download(batch_id, target)

    client = Several(tmp_path)
    jobs = OcrBatches(spark, str(tmp_path / "ocr"), client)
    rows = staging(spark)
    for n, folder in enumerate("ab", 1):
        assert jobs.submit(rows.where(f"folder_id = '{folder}'")) == f"batch-{n}"
    client.states = {"batch-1": "FAILED", "batch-2": "down"}
    assert jobs.poll(rows) == []
    assert {r.batch_id: r.status for r in jobs.batches().collect()} == {"batch-1": "failed", "batch-2": "QUEUED"}
    assert [r.folder_id for r in jobs.pending(rows).collect()] == ["a"]
    assert jobs.submit(rows) == "batch-3"
    client.states = {"batch-2": "SUCCESS", "batch-3": "SUCCESS"}
    assert jobs.poll(rows) == ["batch-2"]  # the other stays open
    assert jobs.results().count() == 0  # the answers were those of another batch's folder


def test_patient_requests():
    waits, seen = [], []

    def request(x):
        seen.append(x)
        if len(seen) == 1:
            raise RateLimited("429")
        if len(seen) == 2:
            raise OSError("reset")
        return "ok"

    assert patient(request, sleep=waits.append)("p") == "ok" and waits == [10, 5.0]
    with pytest.raises(RateLimited):
        patient(lambda: (_ for _ in ()).throw(RateLimited("429")), sleep=waits.append)()


def test_answers_must_be_objects():
    assert parse_answer('{"a": 1}') == {"a": 1} and parse_answer({}) == {}
    for bad in ("", None, "[1]", [1]):
        with pytest.raises(ValueError):
            parse_answer(bad)


def test_existing_meta_files(spark, tmp_path):
    for area, folder, meta in (("epub", "abc", {"sha256": "s", "created_at": "2024-01-02T03:04:05+00:00"}), ("local", "def", {"file_type": "pdf"})):
        (tmp_path / area / folder).mkdir(parents=True)
        (tmp_path / area / folder / "meta.json").write_text(json.dumps(meta, indent=2))
    got = {r.folder_id: (r.area, r.sha256, r.file_type) for r in files.staging_meta(spark, str(tmp_path)).collect()}
    assert got == {"abc": ("epub", "s", None), "def": ("local", None, "pdf")}
    assert files.map_text({"t": "é"}) == '{\n  "t": "é"\n}\n'
