import zlib

import duckdb
import numpy as np
import pytest

from shelfmark.llm import language

SF = "/root/testdata/sf0.001"


def brute_profile(text, bundler):
    """Trigram vectors bound and added one by one."""
    total = np.zeros(bundler.dimensions, np.int64)
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    letters = " " + " ".join(letters.split()) + " "
    if letters.strip():
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            total += np.roll(bundler.letter(ord(a)), 2) * np.roll(bundler.letter(ord(b)), 1) * bundler.letter(ord(c))
    return total


def cosine(a, b):
    size = np.sqrt((a.astype(float) ** 2).sum() * (b.astype(float) ** 2).sum())
    return (a.astype(float) @ b) / size if size else 0.0


def test_profiles_against_brute_force(monkeypatch):
    texts = ["The quick brown fox!", "a", "", None, "12 34", "Ünïcödé  ñandú", "日本語のテキスト", "x" * 70, "İstanbul", "é a1b"] + [
        "".join(map(chr, np.random.default_rng(3).integers(0x4E00, 0x9FFF, 400)))]
    for block in (1 << 20, 16):  # in one block, and with texts cut into pieces
        monkeypatch.setattr(language, "BLOCK", block)
        b = language.Bundler(256)
        got = b.profiles([b.letters(t) for t in texts], list(range(len(texts))), len(texts))
        assert (got == [brute_profile(t, b) for t in texts]).all()
    monkeypatch.setattr(language, "KEPT", 3)
    few = language.Bundler(256)
    assert (few.profiles([few.letters(t) for t in texts], [0] * len(texts), 1)[0] == got.sum(0)).all()


def test_letter_vectors_do_not_depend_on_order():
    a, b = language.Bundler(512), language.Bundler(512)
    first = [a.letter(c).copy() for c in (97, 98)]
    assert (b.letter(98) == first[1]).all() and (b.letter(97) == first[0]).all() and abs(int(first[0].astype(int) @ first[1])) < 150


def test_query_against_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()
    b = language.Bundler()
    made = {i: brute_profile(t, b) for i, t, _ in docs}
    prototypes = {}
    for i, _, lang in docs:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            prototypes[lang] = prototypes.get(lang, 0) + made[i]
    rows = {r.doc_id: r for r in language.op11_profiles(spark, SF).collect()}
    assert len(rows) == len(docs)
    right = held = 0
    for i, _, lang in docs:
        near = {name: round(cosine(made[i], p), 9) for name, p in prototypes.items()}
        best = min(near, key=lambda x: (-near[x], x))
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (r.lang_pred, r.score) == (best, pytest.approx(max(near[best], 0), abs=2e-9)), i
        held += r.held_out
        right += r.held_out and r.lang_pred == lang
    assert right >= 0.97 * held > 0


def test_held_out_accuracy(spark):
    docs = duckdb.sql("select doc_id, lang, length(text) from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rows = {r.doc_id: r for r in language.op11_profiles(spark, "/root/testdata/sf0.01").collect()}
    long = [rows[i].lang_pred == lang for i, lang, n in docs if rows[i].held_out and n >= 50]
    assert sum(long) >= 0.99 * len(long)


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumn("held_out", language.held_out()).withColumns({"at": F.lit("x"), "v": F.lit(0), "score": F.lit(None).cast("double")})


def test_edge_cases(spark):
    known = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "12 !?", "de"), (5, "kein Etikett", None)] * 2
    languages, vectors = language.prototypes(frame(spark, known))
    assert languages == ["de", "en"] and vectors.shape == (2, language.DIMENSIONS)
    asked = [(1, None, None), (2, "", None), (3, "12 !?", None), (None, "the dog", None), (5, "die Katze", "en"), (5, "die Katze", "en"),
             (6, "und die " * 200_000, None), (7, "文字", None)]
    rows = language.predict(frame(spark, asked), languages, vectors).collect()
    assert [(r.doc_id, r.lang_pred) for r in rows][:7] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de"), (5, "de"), (6, "de")]
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[2].score == 0 and not rows[3].held_out
    assert rows[7].lang_pred in ("de", "en")  # a letter, though an unknown one
    # the same prototype twice: the first by name
    twice = language.prototypes(frame(spark, [(1, "abc", "zz"), (2, "abc", "aa")]))
    assert {r.lang_pred for r in language.predict(frame(spark, [(1, "abc", None)]), *twice).collect()} == {"aa"}


def test_nothing_to_learn_from(spark):
    none = language.prototypes(frame(spark, []))
    assert none[0] == []
    assert [(r.lang_pred, r.score) for r in language.predict(frame(spark, [(1, "abc", "en")]), *none).collect()] == [("und", 0.0)]
    assert language.predict(frame(spark, []), *none).count() == 0
