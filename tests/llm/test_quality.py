import math
import re
from collections import Counter

import duckdb
import pytest
import xxhash

from shelfmark.llm import quality

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    counts = (len(words), sum(map(len, words)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))
    return counts, len(words) < 20 or 100 * len(marked) > 30 * len(words)


def bucket(gram, buckets=quality.BUCKETS):
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return (h - 2 ** 64 if h >= 2 ** 63 else h) % buckets


def ending(word):
    return bucket(word[-3:])


def folded(word):
    return bucket(word.strip(quality.AROUND).lower(), quality.WORD_BUCKETS)


def brute(docs, good):
    sides = {f: (Counter(), Counter()) for f in (ending, folded)}
    for i, t in docs:
        for w in WORDS.findall(t or ""):
            for f, (raw, target) in sides.items():
                raw[f(w)] += 1
                target[f(w)] += i in good
    raw, target = sides[ending]
    n, r = sum(target.values()), sum(raw.values())
    ratio = lambda b: math.log((target[b] + 1) / (n + quality.BUCKETS)) - math.log((raw[b] + 1) / (r + quality.BUCKETS)) if n else 0.0
    raws, targets = sides[folded]
    floor = max(quality.FLOOR, 3 / n) if n else 0
    avoided = {b for b in raws if n and math.log((targets[b] / n + floor) / (raws[b] / r + floor)) < quality.AVOIDED}
    out = []
    for i, t in docs:
        words = WORDS.findall(t or "")
        llr = sum(ratio(ending(w)) for w in words) / len(words) if words else 0.0
        out.append((i, *base(t)[0], base(t)[1], llr, sum(folded(w) in avoided for w in words)))
    return out


def labelled(folder):
    """Ids of good and of toxic documents."""
    rows = duckdb.sql(f"select doc_id, quality, toxic from '{folder}/labels.parquet'").fetchall()
    return {i for i, q, x in rows if q == 1 and x == 0}, {i for i, q, x in rows if q == 1 and x == 1}


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    want = {r[0]: r for r in brute(docs, labelled(folder)[0])}
    got = quality.op4_ngram_llr(spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == w[1:7]
        assert r.llr == pytest.approx(w[7], abs=1e-9) and r.n_avoided == w[8]
        assert r.kept == (not w[6] and w[7] >= quality.THRESHOLD and 1000 * w[8] <= quality.MAX_AVOIDED_MILLI * w[1])


def test_junk_goes_and_clean_stays(spark):
    from shelfmark.llm.common import table
    rows = quality.op4_ngram_llr(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    clean = rows.filter("quality = 1 and toxic = 0 and not base_failed")
    assert clean.filter(f"llr < {quality.THRESHOLD}").count() == 0 and clean.filter("kept").count() >= 0.95 * clean.count()
    junk = rows.filter("quality = 0")
    assert junk.filter("kept").count() <= 0.03 * junk.count()


def test_words_seen_in_toxic_documents_alone_are_avoided(spark):
    """Clean documents stay and those with abuse go, labelled or not; the words are listed here only to tell which documents hold abuse."""
    folder = "/root/testdata/sf0.1"
    abuse = "(?i)\\b(trash|clown|idiot|scum|worthless|moron|pathetic|loser|disgusting|stupid)\\b"
    good, toxic = labelled(folder)
    rows = quality.op4_ngram_llr(spark, folder).filter("not base_failed").select("doc_id", "kept").collect()
    abusive = {r[0] for r in duckdb.sql(f"select doc_id from '{folder}/documents.parquet' where regexp_matches(text, '{abuse}')").fetchall()}
    share = lambda ids: sum(r.kept for r in rows if r.doc_id in ids) / sum(r.doc_id in ids for r in rows)
    assert share(good) >= 0.98 and share(toxic & abusive) <= 0.02 and share(abusive - toxic) <= 0.02


def test_edge_cases(spark, documents):
    loop = "a b c d e f g h " * 5000
    docs = [(1, None), (2, ""), (3, loop), (4, "one\n\none\n \ntwo"), (4, "one\n\none\n \ntwo"), (None, "é\x0bß\x1cx"), (5, "##$% <a> |"), (6, "a b c d e f g h a b c d e f g h z")]
    ids = spark.createDataFrame([], "doc_id long")
    out = quality.judge(documents(docs), ids)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.llr) for r in out.collect()), key=str)
    assert got == sorted(((i, *base(t)[0], base(t)[1], 0.0) for i, t in docs), key=str)
    assert quality.judge(documents([]), ids).count() == 0 and "leaks" in out.columns


def test_trusted_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(60, 0, 0), (61, 1, 1), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.trusted(labels, 10).count() == 10 and quality.trusted(labels).count() == 50
