import random
import re

import duckdb

from shelfmark.llm import linededup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, least=50):
    """Texts and deleted lines; ``docs`` in document order with distinct keys.

    A line goes if it lies in a run of at least ``least`` words that has an earlier place,
    and so do blank lines between two neighbours that go. Runs with a shorter one of enough
    words at both ends add nothing.
    """
    seen, out = set(), []
    for doc_id, t in docs:
        every = (t or "").split("\n")
        lines = [(k, x, len(WORD.findall(x))) for k, x in enumerate(every) if WORD.search(x)]
        gone = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total < least:
                    continue
                run = tuple(x[1] for x in lines[a:b + 1])
                if run in seen:
                    gone.update(range(a, b + 1))
                seen.add(run)
                if total - lines[a][2] >= least and total - lines[b][2] >= least:
                    break
        places = {p for k in gone for p in range(lines[k][0], lines[k + 1][0] if k + 1 in gone else lines[k][0] + 1)}
        out.append((doc_id, None if t is None else "\n".join(x for k, x in enumerate(every) if k not in places), len(places)))
    return out


def same(df, want):
    got = [(r.doc_id, r.text, r.deleted_lines) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    want = brute(docs)
    same(linededup.op10_winnowing(spark, SF), want)
    assert any(n for _, _, n in want)


def test_random_lines_against_brute_force(spark, documents):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(7)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    same(linededup.dedup(documents(docs), 6), brute(docs, 6))


def test_edge_cases(spark, documents):
    line = "one two three four five six"
    docs = [(1, None), (2, ""), (3, f"{line}\n\n{line}\n{line}"), (4, f"x\n{line}\ny"), (9, "q\n" * 4000)]
    same(linededup.dedup(documents(docs), 6), brute(docs, 6))
    twice = linededup.dedup(documents([(5, line), (5, line), (None, line)]), 6).collect()
    assert sorted((str(r.doc_id), r.text) for r in twice) == [("5", line), ("5", line), ("None", "")]
    assert linededup.dedup(documents([]), 6).count() == 0


def test_every_repeated_run_of_enough_words_goes(spark, documents):
    """The winnowing guarantee, whatever surrounds the run and wherever its parts were seen before."""
    rng = random.Random(8)
    run = [f"r{i} " + "w " * rng.randint(0, 9) for i in range(6)]
    docs = [(0, run[2] + "\nalone"), (1, "a\n" + "\n".join(run) + "\nb"), (2, "c\n" + "\n".join(run) + "\nd")]
    left = {r.doc_id: r.text for r in linededup.dedup(documents(docs), 10).collect()}
    assert left[2] == "c\nd" and left[1] == docs[1][1]


def test_stage_drops_what_was_nothing_else(spark, documents):
    text = "word " * 60
    rows = linededup.stage(spark, documents([(1, text), (2, text), (3, f"mine\n{text}"), (4, "")]), SF)
    assert {r.doc_id: r.text for r in rows.collect()} == {1: text, 3: "mine", 4: ""} and rows.columns == documents([]).columns


def test_tail_goes_when_the_first_place_is_shorter(spark, documents):
    """The head is matched with document 0, the whole run with document 1: the tail goes from every later copy."""
    head, tail = "p " * 60, "t " * 40
    docs = [(0, f"{head}\nz")] + [(i, f"{head}\n{tail}\nown {i}") for i in range(1, 5)]
    left = {r.doc_id: r.text for r in linededup.dedup(documents(docs)).collect()}
    assert left == {0: docs[0][1], 1: f"{tail}\nown 1"} | {i: f"own {i}" for i in range(2, 5)}


def test_random_lines_against_every_earlier_run(spark, documents):
    """A line goes if it lies in some run of enough words that has an earlier place."""
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(7)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    seen, want = set(), []
    for i, text in docs:
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(x.split()) for x in run) >= 6:
                    if run in seen:
                        gone.update(range(a, b))
                    seen.add(run)
        want.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    same(linededup.dedup(documents(docs), 6), want)
