from shelfmark.functions import text as X


def test_book_slug(apply):
    assert apply(X.book_slug, "Miller - Bread at Home.pdf", "Oven Notes (3rd).epub", "Baker's Year: Rye?.pdf",
                 "Émile_Zola.v2.pdf", "a/b/Plain") == [
        "miller-bread-at-home", "oven-notes", "bakers-year-rye", "émile_zolav2".replace("_", "-"), "plain"]


def test_query_slug_keeps_double_dash_and_caps(apply):
    out = apply(X.query_slug, "What is a -- dash?", "x" * 59 + " yz")
    assert out == ["what-is-a----dash", "x" * 59]


def test_suffix_and_stem(apply):
    assert apply(X.suffix, "A.PDF", ".hidden", "x.tar.GZ", "none") == [".pdf", "", ".gz", ""]
    assert apply(X.stem, "A.PDF", ".hidden", "d/x.tar.gz") == ["A", ".hidden", "x.tar"]


def test_title_case_matches_python(apply):
    samples = ["don't-stop 3rd", "SOUR dough", "o'brien mc-donald", "élan vital"]
    assert apply(X.title_case, *samples) == [s.title() for s in samples]


def test_strip_matches_python(apply):
    samples = ["  x\n\t", "\xa0 y　", "\x1cz\x1f", "", "​w"]
    assert apply(X.strip, *samples) == [s.strip() for s in samples]


def test_slug_names(apply):
    assert apply(X.slug_author, "miller-bread-at-home", "plain") == ["Miller", "Plain"]
    assert apply(X.slug_title, "miller-bread-at-home", "plain") == ["Bread At Home", "plain"]


def test_code_fences(apply):
    assert apply(X.strip_code_fences, "```markdown\nhi\n```", "```\nx", "a```", "plain") == ["hi", "x", "a", "plain"]


def test_clean_heading(apply):
    assert apply(X.clean_heading, "[Part  I]{.x} {#id}", "plain") == ["Part I", "plain"]


def test_safe_file_name(apply):
    assert apply(X.safe_file_name, "B: Loaves!", "?!", "Été_1") == ["B Loaves.epub", "output.epub", "Été_1.epub"]


def test_word_tokens(apply):
    assert apply(X.word_tokens, "Été, l'an 1 – foo_bar", "--") == [["été", "l", "an", "1", "foo", "bar"], []]


def test_base64_has_no_line_breaks(apply):
    import base64
    long = "x" * 500
    assert apply(lambda c: X.base64_text(c.cast("binary")), long) == [base64.b64encode(long.encode()).decode()]


def test_previews(apply):
    assert apply(X.pretty_preview, "a\nb" * 200)[0] == ("a\nb" * 200)[:300].replace("\n", " ")
    short, long = apply(X.notes_preview, " hi ", "y" * 501)
    assert short == "hi" and long == "y" * 500 + "..."
