"""Books to chapters, parent chunks and child chunks.

Every step works inside one book row and fans out with ``posexplode``: no
shuffle, no window, and no group larger than the book it came from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import (
    clean_heading, let, lines, rx, squeeze, strip, whitespace_token_count,
)
from shelfmark.schemas import (
    CHAPTER_MIN_BODY, CHILD_TOKENS, OVERLAP_TOKENS, PARENT_TOKENS,
)

TokenCounter = Callable[[Column], Column]

# Headings that look like chapters and like part dividers.
CHAPTER_HEADING = r"(?i)chapter|ch\.\s*\p{Nd}|^\s*\p{Nd}+[\.\):]"
PART_HEADING = r"(?i)^[IVX]+[\.\s]|part\s|preliminar|appendix|glossary|reference|notes\s+for"

CHAPTER_TYPE = "struct<title:string,text:string,char_start:bigint>"
RANGE_TYPE = "struct<start:int,stop:int,offset:bigint>"
PARA_TYPE = "struct<tokens:int,width:int>"


def chapters(text: Column) -> Column:
    """H1 chapters as an array of (title, text, char_start).

    Splitting before each heading keeps the pieces verbatim, so an offset is
    the total length of the pieces (and newlines) before it.
    """
    pieces = F.split(text, r"\n(?=# )", -1)

    def titled(piece: Column) -> Column:
        first = strip(F.substr(F.substring_index(piece, "\n", 1), F.lit(3)))
        headed = F.when(piece.startswith("# ") & (first != ""), first)
        return F.coalesce(headed, F.lit("Untitled"))

    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array().cast(f"array<{CHAPTER_TYPE}>").alias("done"),
    )

    def add(state: Column, piece: Column) -> Column:
        chapter = F.struct(
            titled(piece).alias("title"), piece.alias("text"), state["at"].alias("char_start")
        )
        return F.struct(
            (state["at"] + F.length(piece) + 1).alias("at"),
            F.concat(state["done"], F.array(chapter)).alias("done"),
        )

    return F.aggregate(pieces, start, add, lambda state: state["done"])


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, stripped, empty ones dropped."""
    parts = F.transform(F.split(strip(text), "\n\n+", -1), strip)
    return F.filter(parts, lambda p: p != "")


def chunk_ranges(sizes: Column, target: int, overlap: int = 0) -> Column:
    """Greedy token-budget chunks over ``array<(tokens,width)>``.

    A chunk is a contiguous run of paragraphs, so only (start, stop, offset) is
    produced.  ``open`` remembers the sizes of the paragraphs in the chunk being
    filled; it is what the overlap is taken from and never outgrows one chunk.
    """
    no_sizes = F.array().cast(f"array<{PARA_TYPE}>")
    start = F.struct(
        F.lit(0).alias("n"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(0).alias("start"),
        F.lit(0).cast("bigint").alias("offset"),
        F.lit(0).alias("tokens"),
        no_sizes.alias("open"),
        F.array().cast(f"array<{RANGE_TYPE}>").alias("done"),
    )

    def closed_range(s: Column) -> Column:
        return F.array(F.struct(
            s["start"].alias("start"), s["n"].alias("stop"), s["offset"].alias("offset")))

    def carried(s: Column) -> Column:
        """Longest suffix of whole paragraphs within the overlap budget."""
        if overlap <= 0:
            return F.struct(F.lit(0).alias("count"), F.lit(0).alias("tokens"),
                            F.lit(0).alias("width"), F.lit(False).alias("full"))
        empty = F.struct(F.lit(0).alias("count"), F.lit(0).alias("tokens"),
                         F.lit(0).alias("width"), F.lit(False).alias("full"))

        def take(acc: Column, p: Column) -> Column:
            full = acc["full"] | (acc["tokens"] + p["tokens"] > overlap)
            return F.struct(
                F.when(full, acc["count"]).otherwise(acc["count"] + 1).alias("count"),
                F.when(full, acc["tokens"]).otherwise(acc["tokens"] + p["tokens"]).alias("tokens"),
                F.when(full, acc["width"]).otherwise(acc["width"] + p["width"] + 2).alias("width"),
                full.alias("full"),
            )

        return F.aggregate(F.reverse(s["open"]), empty, take)

    def add(s: Column, p: Column) -> Column:
        def grown(tokens, start_, offset, kept, done):
            opened = F.concat(kept, F.array(p)) if overlap > 0 else no_sizes
            return F.struct(
                (s["n"] + 1).alias("n"),
                (s["pos"] + p["width"] + 2).alias("pos"),
                start_.alias("start"), offset.alias("offset"),
                (tokens + p["tokens"]).alias("tokens"),
                opened.alias("open"), done.alias("done"),
            )

        def renewed(c: Column) -> Column:
            kept = F.slice(s["open"], F.size(s["open"]) - c["count"] + 1, c["count"])
            return grown(c["tokens"], s["n"] - c["count"], s["pos"] - c["width"], kept,
                         F.concat(s["done"], closed_range(s)))

        over = (s["n"] > 0) & (s["tokens"] + p["tokens"] > target)
        same = grown(s["tokens"], s["start"], s["offset"], s["open"], s["done"])
        return F.when(over, let(carried(s), renewed)).otherwise(same)

    def finish(s: Column) -> Column:
        return F.when(s["n"] > 0, F.concat(s["done"], closed_range(s))).otherwise(s["done"])

    return F.aggregate(sizes, start, add, finish)


def whitespace_counts(texts: Column) -> Column:
    return F.transform(texts, lambda t: whitespace_token_count(t).cast("int"))


def chunks(
    paras: Column, target: int, overlap: int = 0, count: TokenCounter | None = None
) -> Column:
    """Chunks of paragraphs as an array of (text, char_start_offset).

    ``count`` maps an array of texts to an array of token counts; it may be an
    Arrow UDF, which is why it is applied outside the lambdas.
    """

    def cut(texts: Column, tokens: Column) -> Column:
        sizes = F.zip_with(texts, tokens, lambda t, n: F.struct(
            n.cast("int").alias("tokens"), F.length(t).alias("width")))
        return F.transform(
            chunk_ranges(sizes, target, overlap),
            lambda r: F.struct(
                F.array_join(F.slice(texts, r["start"] + 1, r["stop"] - r["start"]), "\n\n").alias("text"),
                r["offset"].alias("char_start_offset"),
            ),
        )

    if count is None:
        return let(paras, lambda ps: cut(ps, whitespace_counts(ps)))
    both = F.struct(paras.alias("texts"), count(paras).alias("tokens"))
    return let(both, lambda b: cut(b["texts"], b["tokens"]))


def build_parents(
    books: DataFrame, target: int = PARENT_TOKENS, count: TokenCounter | None = None
) -> DataFrame:
    """(book_id, author, title, text) -> one row per parent chunk.

    Chapters are numbered before empty ones drop out, so numbers can have gaps.
    """
    per_chapter = books.select(
        "book_id", "author", "title", F.posexplode(chapters(F.col("text"))).alias("ch", "chapter")
    )
    per_parent = per_chapter.select(
        "book_id", "author", "title",
        (F.col("ch") + 1).alias("chapter_number"),
        F.col("chapter.title").alias("chapter_title"),
        F.col("chapter.char_start").alias("chapter_start"),
        F.posexplode(chunks(paragraphs(F.col("chapter.text")), target, 0, count)).alias(
            "parent_index", "chunk"),
    )
    begin = F.col("chapter_start") + F.greatest(F.lit(0).cast("bigint"), F.col("chunk.char_start_offset"))
    return per_parent.select(
        F.concat_ws("::", "book_id", F.concat(F.lit("ch"), "chapter_number"),
                    F.concat(F.lit("parent"), "parent_index")).alias("id"),
        "book_id", "author", "title", "chapter_number", "chapter_title", "parent_index",
        begin.alias("char_start"),
        (begin + F.length("chunk.text")).alias("char_end"),
        F.col("chunk.text").alias("text"),
    )


def build_children(
    parents: DataFrame, target: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS,
    count: TokenCounter | None = None,
) -> DataFrame:
    """Parent rows -> overlapping child chunks with their context prefix."""
    pieces = parents.select(
        F.col("id").alias("parent_id"), "book_id", "author", "title", "chapter_title",
        F.posexplode(chunks(paragraphs(F.col("text")), target, overlap, count)).alias(
            "chunk_index", "chunk"),
    )
    return pieces.select(
        F.concat(F.col("parent_id"), F.lit("::child"), F.col("chunk_index")).alias("id"),
        "parent_id", "book_id", "author", "chunk_index",
        F.col("chunk.text").alias("text"),
        context_text(F.col("author"), F.col("title"), F.col("chapter_title"),
                     F.col("chunk.text")).alias("context_text"),
    )


def context_text(author: Column, title: Column, chapter: Column, text: Column) -> Column:
    return F.concat(F.lit("Author: "), author, F.lit(" | Title: "), title,
                    F.lit(" | Chapter: "), chapter, F.lit("\n\n"), text)


def headings(text: Column, level: int) -> Column:
    marks = "#" * level
    return F.regexp_extract_all(text, F.lit(rx(rf"^{marks} (.+)$", multiline=True)), F.lit(1))


def count_matching(heads: Column, pattern: str) -> Column:
    return F.size(F.filter(heads, lambda h: clean_heading(h).rlike(rx(pattern))))


def heading_counts(text: Column) -> Column:
    """(h1, h2, h1_part, h2_chapter) heading counts."""
    return let(headings(text, 1), lambda one: let(headings(text, 2), lambda two: F.struct(
        F.size(one).alias("h1"), F.size(two).alias("h2"),
        count_matching(one, PART_HEADING).alias("h1_part"),
        count_matching(two, CHAPTER_HEADING).alias("h2_chapter"),
    )))


def chapter_level(text: Column) -> Column:
    """1 when chapters sit at H1, 2 when H1 only divides parts."""

    def decide(n: Column) -> Column:
        mostly = (n["h2_chapter"] >= n["h2"] * F.lit(0.4)) & (n["h1_part"] >= n["h1"] * F.lit(0.3))
        many = (n["h2"] > n["h1"] * 2) & (n["h2_chapter"] >= 3)
        return F.when(n["h2"] == 0, 1).when(mostly | many, 2).otherwise(1)

    return let(heading_counts(text), decide)


def chapters_at(text: Column, level: Column, min_body: int = CHAPTER_MIN_BODY) -> Column:
    """Chapters at H1 or H2 as (heading, text); preamble and spacers drop out."""

    def at(n: int) -> Column:
        mark = "#" * n + " "
        pieces = F.split(text, rf"\n(?={mark})", -1)
        kept = F.filter(pieces, lambda p: p.startswith(mark))
        return F.transform(kept, lambda p: F.struct(
            strip(F.substr(F.substring_index(p, "\n", 1), F.lit(n + 2))).alias("heading"),
            p.alias("text")))

    both = F.when(level == 2, at(2)).otherwise(at(1))
    return F.filter(both, lambda ch: (
        (clean_heading(ch["heading"]) != "")
        & (F.length(ch["text"]) - F.length(F.substring_index(ch["text"], "\n", 1)) > min_body)
    ))
