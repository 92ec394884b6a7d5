"""Chunks as a table function, for SQL and for texts of any length.

``chunk_text(TABLE(books), 'text', 800, 50)`` keeps the other columns of its table and
gives a row per chunk. It walks a text once, paragraph by paragraph, and holds only the
paragraphs of the open chunk, so its time is in proportion to the text, where the
column form (``structure.chunks``) folds a growing list inside one expression. Both cut alike.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from shelfmark.functions.text import WHITESPACE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "chunk_text"
# The separators of U+001C to U+001F are stripped but part no words, as in the column form.
WORD = re.compile("[^" + "".join(c for c in WHITESPACE if not "\x1c" <= c <= "\x1f") + "]+")
BREAK = re.compile("\n\n+")
ADDED = (("chunk", T.IntegerType()), ("chunk_text", T.StringType()), ("char_start_offset", T.LongType()))


def paragraphs(text: str) -> Iterator[str]:
    """Blank-line separated paragraphs, stripped, empty ones dropped; one at a time."""
    text, at = text.strip(WHITESPACE), 0
    for gap in BREAK.finditer(text):
        if part := text[at:gap.start()].strip(WHITESPACE):
            yield part
        at = gap.end()
    if part := text[at:].strip(WHITESPACE):
        yield part


def cut(text: str, target: int, overlap: int) -> Iterator[tuple[str, int]]:
    """(text, offset) of greedy chunks of at most ``target`` words; a longer paragraph is one by itself.

    A chunk begins with the longest run of whole paragraphs at the end of the one before
    that has at most ``overlap`` words.
    """
    held: list[tuple[str, int]] = []
    words = start = at = 0
    for part in paragraphs(text):
        size = sum(1 for _ in WORD.finditer(part))
        if at and words + size > target:
            yield "\n\n".join(p for p, _ in held), start
            kept = carried = 0
            while 0 < overlap and kept < len(held) and carried + held[-1 - kept][1] <= overlap:
                carried += held[-1 - kept][1]
                kept += 1
            held = held[len(held) - kept:]
            words, start = carried, at - sum(len(p) + 2 for p, _ in held)
        held.append((part, size))
        words += size
        at += len(part) + 2
    if at:
        yield "\n\n".join(p for p, _ in held), start


class ChunkText:
    """The table function; its arguments are a table, the name of the text column, the target and the overlap in words."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, target: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("the first argument must be TABLE(...)")
        if column.value not in rows.dataType.names:
            raise ValueError(f"no column named {column.value}")
        if not isinstance(target.value, int) or target.value < 1 or not isinstance(overlap.value, int) or overlap.value < 0:
            raise ValueError("target must be at least 1 and overlap at least 0, both constant")
        schema = T.StructType([f for f in rows.dataType.fields if f.name != column.value])
        taken = set(schema.names)
        for name, kind in ADDED:
            if name in taken:
                raise ValueError(f"the table has a column {name} of its own")
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row, column: str, target: int, overlap: int) -> Iterator[tuple]:
        text = row[column]
        rest = tuple(row[n] for n in row.__fields__ if n != column)
        for number, (part, offset) in enumerate(cut(text or "", target, overlap)):
            yield (*rest, number, part, offset)


def register(spark: SparkSession) -> None:
    """Make the function known to SQL."""
    spark.udtf.register(NAME, F.udtf(ChunkText))


def chunk_table(df: DataFrame, column: str, target: int, overlap: int = 0) -> DataFrame:
    """The same for a DataFrame; rows stay in their partitions."""
    arguments: list[Column] = [F.lit(column), F.lit(target), F.lit(overlap)]
    return F.udtf(ChunkText)(df.asTable(), *arguments)
