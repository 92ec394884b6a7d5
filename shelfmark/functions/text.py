"""Scalar text functions.

Regular expressions run on Java's engine.  ``rx`` prefixes the flags that make
it agree with Unicode-aware, newline-only line semantics: ``(?U)`` for Unicode
``\\s``/``\\b``, ``(?d)`` so that only ``\\n`` ends a line, ``(?m)`` on request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from shelfmark.schemas import NOTES_PREVIEW, PRETTY_PREVIEW, QUERY_SLUG_CHARS

# Every character that counts as white space when stripping.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Characters that end a line when whole texts are judged line by line.
# A "\r\n" pair counts twice, which only adds a blank line and never matters here.
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

WORD = r"\p{L}\p{N}_"
BLANKS = r"[^\S\n]"  # white space inside one line


def rx(pattern: str, multiline: bool = False) -> str:
    return ("(?dmU)" if multiline else "(?dU)") + pattern


def sub(c: Column, pattern: str, replacement: str = "", multiline: bool = False) -> Column:
    return F.regexp_replace(c, F.lit(rx(pattern, multiline)), F.lit(replacement))


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character (SQL ``trim`` only drops spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst inlines projected columns into lambda bodies, where they would be
    recomputed per element; binding through a one-element array prevents that.
    """
    return F.transform(F.array(value), body)[0]


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def unlines(c: Column) -> Column:
    return F.array_join(c, "\n")


def starts_with_heading(c: Column) -> Column:
    """True when some line starts with ``"# "``."""
    return c.startswith("# ") | c.contains("\n# ")


def squeeze(c: Column) -> Column:
    return strip(sub(c, r"\s+", " "))


def stem(name: Column) -> Column:
    """File name without directory and without its last extension."""
    base = F.substring_index(name, "/", -1)
    return F.regexp_replace(base, r"(?s)(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^./]+)$", 1))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, so ``"don't"`` becomes ``"Don'T"``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def book_slug(original_name: Column) -> Column:
    """Book id from an original file name."""
    name = sub(stem(original_name), r"\s*\(.*?\)\s*$")
    name = strip(F.lower(name))
    name = sub(name, rf"[^{WORD}\s-]")
    name = sub(name, r"[\s_]+", "-")
    return F.btrim(sub(name, "-+", "-"), F.lit("-"))


def query_slug(query: Column) -> Column:
    """File-name slug of a question: capped, inner dashes not collapsed."""
    text = strip(F.lower(query))
    text = sub(text, rf"[^{WORD}\s-]")
    text = sub(text, r"[\s_]+", "-")
    return F.rtrim(F.left(text, F.lit(QUERY_SLUG_CHARS)), F.lit("-"))


def slug_author(book_id: Column) -> Column:
    return title_case(F.substring_index(book_id, "-", 1))


def slug_title(book_id: Column) -> Column:
    at = F.instr(book_id, "-")
    rest = F.replace(F.substr(book_id, at + 1), F.lit("-"), F.lit(" "))
    return F.when(at > 0, title_case(rest)).otherwise(book_id)


def clean_heading(c: Column) -> Column:
    """Drop ``{...}``, unwrap ``[x]`` and squeeze white space in a heading."""
    return squeeze(sub(sub(c, r"\{[^}]*\}"), r"\[([^\]]*)\]", "$1"))


def safe_file_name(c: Column) -> Column:
    """Letters, digits, space, dash and underscore of a title plus ``.epub``."""
    kept = strip(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", ""))
    return F.when(kept == "", F.lit("output.epub")).otherwise(F.concat(kept, F.lit(".epub")))


def delivery_label(title: Column, author: Column) -> Column:
    return F.concat_ws(" — ", title, F.nullif(author, F.lit("")))


def strip_code_fences(c: Column) -> Column:
    """Remove a Markdown code fence around a whole model answer."""
    opened = F.when(c.startswith("```markdown"), strip(F.substr(c, F.lit(12)))).otherwise(c)
    bare = F.when(opened.startswith("```"), strip(F.substr(opened, F.lit(4)))).otherwise(opened)
    closed = strip(F.left(bare, F.length(bare) - 3))
    return F.when(bare.endswith("```"), closed).otherwise(bare)


def pretty_preview(c: Column) -> Column:
    return F.replace(F.left(c, F.lit(PRETTY_PREVIEW)), F.lit("\n"), F.lit(" "))


def notes_preview(c: Column) -> Column:
    body = strip(c)
    dots = F.when(F.length(body) > NOTES_PREVIEW, F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.left(body, F.lit(NOTES_PREVIEW)), dots)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def base64_text(content: Column) -> Column:
    """Base64 on one line (Spark may be configured to break lines)."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def escape_literal(value: Column) -> Column:
    return F.replace(value, F.lit("'"), F.lit("''"))


TERM = r"[\p{L}\p{N}]+"


def word_tokens(c: Column) -> Column:
    """Lower-case alphanumeric terms, the units of the keyword index."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TERM))


def whitespace_token_count(c: Column) -> Column:
    """Default offline token counter: runs of non-blank characters."""
    return F.regexp_count(c, F.lit(rx(r"\S+")))


def truncate_for_map(c: Column, limit: int) -> Column:
    return F.concat(F.left(c, F.lit(limit)), F.lit("\n\n[...truncated...]"))
