import json
from dataclasses import fields
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark import models as M
from shelfmark.cli import make_maps, note_uri, parser, search
from shelfmark.operators import bookmaps as B
from shelfmark.sources import files
from shelfmark.sources.config import Config, ensure_config, ensure_directories, load_config


def test_config_defaults(tmp_path):
    cfg = load_config(tmp_path / "none.toml")
    assert (cfg.cleanup.fuzzy_threshold, cfg.cleanup.strip_images, cfg.workers.local_workers, cfg.kindle.enabled,
            cfg.conversion.pdf_engine, cfg.batch.poll_interval_minutes) == (0.7, True, 3, False, "cloud", 60)


def test_config_file_and_environment(tmp_path, monkeypatch):
    monkeypatch.setenv("GEMINI_API_KEY", "env")
    monkeypatch.setenv("MISTRAL_API_KEY", "env")
    path = tmp_path / "c.toml"
    path.write_text('[cleanup]\nfuzzy_threshold = 0.5\nstrip_images = false\nunknown = 1\n[workers]\nlocal_workers = 8\n'
                    f'[conversion]\npdf_engine = "local"\n[api_keys]\nmistral = "file"\n[paths]\nstaging = "{tmp_path}/st"\n')
    cfg = load_config(path)
    assert (cfg.cleanup.fuzzy_threshold, cfg.cleanup.strip_images, cfg.workers.local_workers, cfg.conversion.pdf_engine) == (0.5, False, 8, "local")
    assert (cfg.api_keys.gemini, cfg.api_keys.mistral) == ("env", "file")
    assert cfg.paths.staging_cloud == f"{tmp_path}/st/cloud" and cfg.paths.inbox.startswith(str(Path.home()))


def test_config_is_created_once(tmp_path):
    path = tmp_path / "x" / "c.toml"
    assert ensure_config(path) == load_config(path) and path.exists()
    assert all(f"[{f.name}]" in path.read_text() for f in fields(Config))


def test_directories(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[paths]\n" + "".join(f'{n} = "{tmp_path}/{n}"\n' for n in ("inbox", "done", "quarantine", "staging", "repo_root")))
    cfg = load_config(path)
    ensure_directories(cfg)
    assert all(Path(p).is_dir() for p in (cfg.paths.inbox, cfg.paths.batches, cfg.paths.maps, cfg.paths.staging_epub))


class Failure(Exception):
    def __init__(self, status):
        self.status_code = status


def test_retry_predicate():
    assert M.is_retryable(Failure(429)) and M.is_retryable(Failure(500)) and not M.is_retryable(Failure(400))
    assert M.is_retryable(Exception("rate limit 429")) and M.is_retryable(Exception("RESOURCE_EXHAUSTED"))
    assert M.is_retryable(Exception("1500 tokens")) and not M.is_retryable(Exception("bad request"))


def test_retry_policy():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise Failure(503)
        return x

    assert M.Retry(5, 2, 4, 60, waits.append).call(flaky, 7) == 7 and waits == [4, 4]
    with pytest.raises(Failure):
        M.Retry(2, 1, 0, 1, waits.append).call(lambda: (_ for _ in ()).throw(Failure(503)))
    with pytest.raises(Failure):
        M.Retry(5, 1, 0, 1, waits.append).call(lambda: (_ for _ in ()).throw(Failure(400)))


def test_api_keys(monkeypatch):
    with pytest.raises(ValueError, match="Unknown provider"):
        M.api_key("nobody")
    for provider, name in M.PROVIDER_KEYS.items():
        for value in ("", "...", "sk-or-..."):
            monkeypatch.setenv(name, value)
            with pytest.raises(ValueError, match=name):
                M.api_key(provider)
        monkeypatch.setenv(name, "real")
        assert M.api_key(provider) == "real"


def test_embedding_batches(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) <= 10
        seen.add(1)
        return [[float(len(t))] for t in texts]

    kids = spark.range(25).select(F.concat(F.lit("t"), "id").alias("context_text")).coalesce(1)
    got = M.embed_children(kids, M.Embedder("len", 1, embed), batch=10).collect()
    assert seen.value == 3 and all(r.vector == [float(len(r.context_text))] for r in got)


def test_embedding_size_is_checked():
    with pytest.raises(ValueError):
        M.Embedder("bad", 3, lambda t: [[1.0]]).embed_documents(["x"])


MAP = {"id": "x", "author": "A", "title": "T", "year": 1790, "summary": "s", "key_themes": ["k"],
       "chapters": [{"number": 1, "title": "c", "summary": "s", "key_arguments": ["a"], "themes": ["t"]}]}


def test_map_files(spark, tmp_path):
    (tmp_path / "book-one.json").write_text(json.dumps(MAP, indent=2))
    row = files.book_maps(spark, str(tmp_path)).first()
    assert (row.id, row.year, row.chapters[0].title, row.source_md) == ("book-one", 1790, "c", None)


def test_map_warnings(spark):
    cases = [MAP, {"chapters": "x"}, {**MAP, "chapters": []}, {**MAP, "chapters": [{"title": ""}, {"title": "b", "key_arguments": []}]}]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string")
    got = [r.w for r in rows.select("i", B.json_warnings(F.col("j")).alias("w")).orderBy("i").collect()]
    assert got == [[], ["missing 'author'", "missing 'title'", "missing 'summary'", "missing 'key_themes'", "'chapters' is not a list"],
                   ["'chapters' is empty"], ["chapter 1 missing title", "chapter 1 missing key_arguments", "chapter 2 missing key_arguments"]]


def test_map_generation(spark, tmp_path):
    long = "# Front\n" + "".join(f"# Chapter {i}\n" + f"body {i} " * 9000 + "\n" for i in range(3))
    books = spark.createDataFrame([("long", long), ("short", "tiny"), ("flat", "z" * 100_001)], "book_id string, text string")

    calls = spark.sparkContext.accumulator(0)

    def model(kind, prompt):
        calls.add(1)
        if kind == "chapter" and "titled: Chapter 1\n" in prompt:
            raise RuntimeError("quota")
        if kind == "chapter":
            return {"title": "t", "summary": prompt.split("\n")[0]}, {"prompt_tokens": 10, "completion_tokens": 1}
        return {"author": "Me"} if kind == "overview" else {"title": kind, "chapters": []}, {"prompt_tokens": 5}

    folder = str(tmp_path / "maps")
    cost = make_maps(spark, books, folder, model).first()
    assert calls.value == B.prompts(books).count() == 9  # each prompt is paid once; by default no chapter is left out
    assert B.prompts(books, min_body=200).count() == 8  # the empty chapter is
    assert (cost.prompt_tokens, cost.completion_tokens) == (15 + 60 - 10, 5)
    got = {r.id: r for r in files.generated_maps(spark, folder).collect()}
    assert [c.number for c in got["long"].chapters] == [1, 2, 3, 4]
    assert got["long"].chapters[2].summary == "[Error: quota]" and got["long"].chapters[2].title == "Chapter 1"
    assert (got["long"].author, got["long"].title, got["long"].source_md) == ("Me", "long", "markdown/long.md")
    assert got["short"].title == "book" and got["short"].author is None
    assert [c.number for c in got["flat"].chapters] == [1, 2] and got["flat"].author == "Me"
    sent = {(r.book_id, r.kind, r.number): r.prompt for r in B.prompts(books).collect()}
    assert sum(sent[("flat", "chapter", n)].count("z") for n in (1, 2)) == 100_001
    assert "  3. Chapter 1" in sent[("long", "overview", 0)] and sent[("long", "overview", 0)].endswith(long)
    assert len(B.prompts(books, opening=10).where("kind = 'overview' and book_id = 'long'").first().prompt) < 300
    again = make_maps(spark, books, folder, model).first()
    assert again.prompt_tokens is None  # nothing left to do


def test_command_line(spark, tmp_path):
    from datetime import datetime
    from shelfmark.plans.library import Library
    lib = Library(spark, str(tmp_path / "lib"), M.Embedder("tiny", 8), 2)
    lib.add_books(spark.createDataFrame([("au-book", "# H\n\nsome words")], "book_id string, text string"))
    run = lambda *a: search(lib, parser().parse_args(["query", *a]), str(tmp_path / "my vault"), datetime(2024, 1, 2))
    assert "→ markdown/au-book.md" in run("words")
    assert json.loads(run("words", "--format", "json"))[0]["parent_id"] == "au-book::ch1::parent0"
    assert run("absent", "--mode", "keyword") == "No results found."
    assert "words-20240102.md" in run("words", "--format", "obsidian")
    assert note_uri("/x/my vault", "a-b") == "obsidian://open?vault=my%20vault&file=Queries/a-b"


def test_rounding_matches_python(spark):
    import random
    from shelfmark.functions.numbers import round_exact
    rng = random.Random(1)
    values = [6.55, 6.45, 0.125, 0.375, 2.5, -6.55, 0.4475, 1e-9, 0.0, 123456.05] + [rng.randint(0, 10 ** 6) / 10 ** rng.randint(0, 5) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for digits in (1, 3, 4):
        got = [r.r for r in rows.select("i", round_exact(F.col("x"), digits).alias("r")).orderBy("i").collect()]
        assert got == [round(v, digits) for v in values]
