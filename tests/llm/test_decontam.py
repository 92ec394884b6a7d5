import duckdb
from pyspark.sql import functions as F

from shelfmark.llm import decontam

SF = "/root/testdata/sf0.001"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("h", F.lit(1))


def leaks(df):
    return {(r.doc_id, x.item_id, x.changed) for r in df.collect() for x in r.leaks or []}


def test_query_finds_every_whole_passage(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in decontam.op5_templates(spark, SF).collect()}
    assert want and got == want


QUESTION = "Tom has 5 apples and buys 3.5 kg of pears from Anna, so how many apples does Tom have now"


def test_other_numbers_names_and_units_are_caught(spark, documents):
    docs = [(1, QUESTION), (2, "before " + QUESTION.replace("Tom", "Bob").replace("5 ", "17 ").replace("kg", "lb") + " after"),
            (3, QUESTION.replace("Tom has", "Max has").replace("does Tom", "does Eve")),  # one value stands for two
            (4, "Tom has 5 pears and sells 3 kg of plums to Anna, but why would he keep the rest of them"), (5, None), (6, "")]
    assert leaks(decontam.flag(documents(docs), bench(spark, [(7, QUESTION)]))) == {(1, 7, False), (2, 7, True)}


def test_edited_and_several_passages(spark, documents):
    """A word put in the middle moves the second half to another diagonal; two versions in one text do not hide each other."""
    long = "first the miller fills the hopper with rye then he opens the sluice and waits until the stone turns fast enough to grind it fine"
    docs = [(1, "x y " + long.replace("sluice", "old sluice") + " z"), (2, QUESTION + " and " + QUESTION.replace("Tom", "Bob").replace("Anna", "Tom"))]
    assert leaks(decontam.flag(documents(docs), bench(spark, [(7, QUESTION), (8, long)]))) == {(1, 8, False), (2, 7, True)}


def test_edge_cases(spark, documents):
    items = [(1, "short words only"), (2, "Name Name 5 6 Name"), (3, None), (4, ""), (5, "short words only")]
    docs = [(1, "these are short words only here"), (1, "these are short words only here"), (None, "short words only"), (2, "short words, but not only"), (3, "Name Name 5 6 Name"),
            (4, ("filler " * 30_000) + "short words only")]
    out = decontam.flag(documents(docs), bench(spark, items))
    assert leaks(out) == {(i, k, False) for i in (1, None, 4) for k in (1, 5)} and out.count() == len(docs)
    assert leaks(decontam.flag(documents(docs), bench(spark, []))) == set()
    assert decontam.flag(documents([]), bench(spark, items)).count() == 0


def test_stage_drops_leaking_documents_only(spark, documents):
    from shelfmark.llm.common import table
    item = table(spark, SF, "benchmark").first().text
    rows = decontam.stage(spark, documents([(1, f"x {item} y"), (2, "clean text"), (3, None)]), SF)
    assert sorted(r.doc_id for r in rows.collect()) == [2, 3] and rows.columns == documents([]).columns


def test_both_join_routes_agree(spark, documents, monkeypatch):
    docs = documents([(1, QUESTION), (2, "nothing")])
    broad = leaks(decontam.flag(docs, bench(spark, [(7, QUESTION)])))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert leaks(decontam.flag(docs, bench(spark, [(7, QUESTION)]))) == broad != set()


STORY = ("Old Peter the miller fills the hopper with 30 kg of rye before the Sunday market and then he opens the sluice and waits until the stone turns fast enough to grind it "
         "fine while his daughter Ruth counts the sacks that the farmers left at the gate and writes the sum of 12 coins in the long grey book of the house for Peter to read")


def test_runs_case_and_single_conflicts_are_caught(spark, documents):
    words = STORY.split()
    part = " ".join(words[13:33])  # twenty words are far below half of the windows
    docs = [(1, f"before that {part} and so on"), (2, STORY.lower()), (3, STORY.upper()), (4, STORY.title()), (5, STORY.replace("for Peter", "for Paul")),
            (6, STORY.replace("30 ", "12 ")), (7, "x " + " ".join(words[13:25]) + " y"), (8, QUESTION.upper())]
    want = {(1, 7, False), (2, 7, False), (3, 7, False), (4, 7, False), (5, 7, True), (6, 7, True), (8, 8, False)}
    assert leaks(decontam.flag(documents(docs), bench(spark, [(7, STORY), (8, QUESTION)]))) == want


def test_verbatim_copies_of_names_and_numbers(spark, documents):
    """An item without a window of enough literal words is found word for word, in any case, and not re-parameterised."""
    item = "Anna Bob Carl 5 7 9 Dora Emil Fritz 3 and 8 Gustav Hans"
    docs = [(1, item), (2, f"we say {item.upper()} here"), (3, item.replace("Dora", "Rosa")), (4, item.replace("5 7 9", "1 2 4"))]
    got = leaks(decontam.flag(documents(docs), bench(spark, [(7, item), (8, STORY)])))
    assert {x for x in got if x[0] in (1, 2)} == {(1, 7, False), (2, 7, False)}


def brute_windows(text, size, form):
    """Windows of typed, folded or plain tokens, token by token."""
    import regex
    raw = regex.findall(decontam.TOKEN, text or "")
    out = []
    for i, x in enumerate(raw):
        after = i > 0 and regex.match(r"\p{N}", raw[i - 1])
        y = x if form == "typed" else x.lower()
        if form == "plain":
            out.append(y)
        elif form == "typed" and regex.match(r"\p{Lu}", x):
            out.append("<name>")
        elif regex.match(r"\p{N}", y):
            out.append("<num>")
        else:
            out.append("<unit>" if y in decontam.UNITS and after else y.lower())
    return [tuple(out[i:i + size]) for i in range(len(out) - size + 1)]


def test_windows_against_brute_force(spark, documents, monkeypatch):
    """A window of a document is hit where, and only where, an item has a window of the same tokens, whatever the blocks."""
    import random
    rng = random.Random(3)
    words = ["Anna", "Bob", "5", "7.5", "kg", "KG", "m", "sold", "Sold", "a", "in", "é", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench_texts = [(i, text(rng.randint(3, 30))) for i in range(25)]
    taken = lambda: rng.choice([str, str.lower, str.upper])(" ".join(rng.choice(bench_texts)[1].split()[rng.randint(0, 3):]))
    docs = [(i, f"{text(rng.randint(0, 9))} {taken()} {text(2)} {taken()}") for i in range(40)] + [(90, None), (91, "")]
    known = decontam.items(bench(spark, bench_texts))
    index = {}
    for r in decontam.item_windows(known).collect():
        index.setdefault(r.h, set()).add((r.item_id, r.at, r.size))
    for block in (100_000, 10):
        monkeypatch.setattr(decontam, "BLOCK_TOKENS", block)
        rows = decontam.document_windows(documents(docs).selectExpr("doc_id as d", "0L as c", "text as body"), list(range(1, 9)), True, None).collect()
        got = {(r.d, r.pos, x) for r in rows for x in index.get(r.h, ())}
        want = set()
        plain = {r.item_id for r in known.where("plain").collect()}
        used = {x for places in index.values() for x in places}
        for d, t in docs:
            for i, b in bench_texts:
                for size in {s for k, _, s in used if k == i}:
                    own = ("plain",) if i in plain else ("typed", "folded")
                    for mine in own:
                        for theirs in own:
                            a, o = brute_windows(t, size, mine), brute_windows(b, size, theirs)
                            want |= {(d, p, (i, q, size)) for p, x in enumerate(a) for q, y in enumerate(o) if x == y and (i, q, size) in used}
        assert got == want and len(want) > 50
