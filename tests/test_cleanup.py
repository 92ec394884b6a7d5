import random
import re

from pyspark.sql import functions as F

from shelfmark.functions import cleanup as C
from shelfmark.operators import cleaning
from shelfmark.sources.config import Cleanup

# A recipe page as a converter might leave it.
CONVERTED = (
    "[]{#soup.xhtml}\n# [Leek soup]{.dish} {#leek}\n\n::: {.box}\nServes [four]{.count .big}.\n:::\n\n"
    "<p>Slice <span class=\"q\">two</span> leeks.</p>\n\n## [Stock]{.part}\n\n- one onion\n")


def test_converted_markup_is_removed(apply):
    (out,) = apply(C.markdown_cleanup, CONVERTED)
    assert out == "# Leek soup\n\nServes four.\n\nSlice two leeks.\n\n## Stock\n\n- one onion\n"


def test_headings(apply):
    out = apply(C.markdown_cleanup, "# S oup Kitchen", "#\nleeks\n#   \n", " \n\nbarley\n\n\t", "# Oats\n\n\n\n\nrye",
                "# BOOK I on A FARM , y")
    assert out == ["# Soup Kitchen\n", "# leeks\n", "barley\n", "# Oats\n\nrye\n", "# BOOK Ion AFARM, y\n"]


def test_inferred_headings(apply):
    out = apply(C.infer_headings, "go\n\nChapter 8 Bread\n\nz", "go\n\nWINTER VEGETABLE STEWS\n\nz",
                "go\n\nPart II. Ovens\n\nz", "go\n\nNO SALT\n\nz", "CHAPTER 3\nz", "go\nChapter 5\n")
    assert out == ["go\n\n# Chapter 8 Bread\n\nz", "go\n\n# Winter Vegetable Stews\n\nz", "go\n\n# Part II. Ovens\n\nz",
                   "go\n\nNO SALT\n\nz", "CHAPTER 3\nz", "go\nChapter 5\n"]


def test_page_artefacts(apply):
    raw = ("**SOUPS AND STEWS • 7**\n\nW hile onions fry, T homas peels.\xa0Salt.\n==> photo intentionally omitted <==\n"
           "**8 • SOUPS AND STEWS**\n### Pots •\nsea\xad son\n•  \nserve")
    (out,) = apply(C.pdf_cleanup, raw)
    assert "While onions fry, Thomas peels. Salt." in out and "season" in out
    for gone in ("•", "photo", "\xa0", "STEWS", "Pots"):
        assert gone not in out


def test_lone_capital_quirk(apply):
    assert apply(C.rejoin_capitals, "Plan B was", "A friend I am", "xB was", "éB was") == ["Plan Bwas", "A friend I am", "xB was", "éB was"]


def test_letterspacing_against_brute_force(apply):
    rng = random.Random(7)
    samples = ["B r e a d r o l l", "a b c", "a b c d ef", "xa b c d e", "é a b c d é f", "a  b c d e"]
    samples += ["".join(rng.choice("ab C ée1 \n") for _ in range(60)) for _ in range(300)]
    run = re.compile(r"\b(?:[A-Za-z] ){3,}[A-Za-z]\b")
    expected = [run.sub(lambda m: m.group(0).replace(" ", ""), s) for s in samples]
    assert apply(C.join_letterspaced, *samples) == expected


def test_line_dropping_against_brute_force(apply):
    rng = random.Random(3)
    samples = ["\n".join(rng.choice(["| a |", "|", " |x| ", "| open", "t", "", "::: d", ":: no"]) for _ in range(rng.randint(1, 9)))
               for _ in range(200)]
    def tables(t):
        return "\n".join(l for l in t.split("\n") if not (l.strip().startswith("|") and l.strip().endswith("|")))
    def fences(t):
        return "\n".join(l for l in t.split("\n") if not l.startswith(":::"))
    assert apply(C.strip_tables, *samples) == [tables(s) for s in samples]
    assert apply(C.drop_fences, *samples) == [fences(s) for s in samples]


def test_blank_line_squeeze_against_python(apply):
    rng = random.Random(5)
    samples = ["".join(rng.choice("a\n\n \t") for _ in range(25)) for _ in range(300)]
    assert apply(C.squeeze_blank_lines, *samples) == [re.sub(r"^\s*$\n", "\n", s, flags=re.M) for s in samples]


def test_images(apply):
    assert apply(C.strip_images, "A ![x](y.png){.z} B <IMG src=q> C <svg a>1\n2</svg> D") == ["A  B  C  D"]
    assert apply(C.strip_cover_images, "![](images/cover.jpg){w}\nx\n![](images/map.png)") == ["\nx\n![](images/map.png)"]


def test_quality_score(apply):
    good = "\n\n".join(["# Bread"] + [f"Step {i}: knead the dough again and let it rest." for i in range(100)])
    scores = apply(C.quality_score, "", "\n", "Flour now", good)
    assert scores[0] == 0.0 and scores[1] == 0.25
    assert abs(scores[2] - (1 / 50 + 0 + 0 + 1) / 4) < 1e-12
    assert abs(scores[3] - (0.2 + 1 + 1 + 1) / 4) < 1e-12


def test_source_type_routing(spark):
    rows = spark.createDataFrame([("pdf", "# D\n\nT hose loaves."), ("epub", "# D\n\nT hose loaves.")], "file_type string, raw_text string")
    done = {r.file_type: r for r in cleaning.clean(rows).collect()}
    assert "Those loaves" in done["pdf"].clean_text and "T hose loaves" in done["epub"].clean_text
    assert done["pdf"].cleanup_method == "regex" and done["pdf"].clean_chars == len(done["pdf"].clean_text)


def test_repair_sees_poor_texts_only_and_all_of_them(spark):
    long = "é" * 25_000
    good = "\n\n".join(f"# H{i}\n\n" + "plain words that are long enough. " * 3 for i in range(60))
    rows = spark.createDataFrame([("epub", long), ("epub", good)], "file_type string, raw_text string")
    repair = lambda t: f"<{len(t)}>"

    done = cleaning.clean(rows, Cleanup(), repair=repair).collect()
    assert done[0].clean_text == "<20000><5001>"
    assert done[0].cleanup_method == "regex+repair" and done[0].quality_score_after_repair is not None
    assert "<" not in done[1].clean_text and done[1].quality_score_after_repair is None and done[1].cleanup_method == "regex"
    whole = cleaning.clean(rows, Cleanup(), normalize=lambda t: t, repair=repair, window=None).collect()
    assert whole[0].clean_text == "<25001>" and whole[0].cleanup_method == "regex+normalize+repair"


def test_failed_rewrite_keeps_the_text(spark):
    def boom(text):
        raise RuntimeError("no")
    rows = spark.createDataFrame([("abc",)], "t string")
    assert cleaning.rewrite_text(rows, "t", boom).first().t == "abc"
