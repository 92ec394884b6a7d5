"""Token ids of whole texts under a byte-level BPE vocabulary, inside tasks.

The ids are those of ``tokenizers`` with the same vocabulary file. Its encoder is
slow on text with many rare words, so words are encoded once per task and looked
up again: under this vocabulary's splitting rule a blank always opens a new piece,
so a text may be cut at its single spaces. Texts with runs of blanks, or with the
spelling of a special token, go through an encoder as a whole.
"""

from __future__ import annotations

import base64
import struct
import sys
import types

from shelfmark.llm.common import carried

carried(__name__)

# Words remembered per task: bounds memory, not results.
REMEMBERED = 250_000
SPECIAL = "<|endoftext|>"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Irregular(Exception):
    """The text has blanks next to each other."""


class _Words(dict):
    """Encoded ids of a word as packed little-endian 32-bit numbers, with its leading space."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Irregular
        ids = self.encode(" " + word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < REMEMBERED:
            self[word] = packed
        return packed


class Encoder:
    """``ids(text)`` gives the ids of a text as packed little-endian 32-bit numbers."""

    def __init__(self, vocabulary_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = fast.encode_ordinary
        self.vocabulary_path = vocabulary_path
        self.full = None
        self.words = _Words(self.encode)

    def _exact(self, text: str) -> list[int]:
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.vocabulary_path)
        return self.full.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            ids = self._exact(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        try:
            if not first or first[0].isspace():
                raise _Irregular
            head = self.encode(first)
            return struct.pack(f"<{len(head)}I", *head) + b"".join(map(self.words.__getitem__, rest))
        except _Irregular:
            ids = self.encode(text)
            return struct.pack(f"<{len(ids)}I", *ids)


def encoder_of(vocabulary_path: str, ranks_path: str) -> Encoder:
    """The worker process's encoder: its tasks share one, so their number does not add to its memory."""
    kept = sys.modules.setdefault("shelfmark_encoders", types.ModuleType("shelfmark_encoders"))
    known = kept.__dict__.setdefault("by_path", {})
    key = (vocabulary_path, ranks_path)
    if key not in known:
        known[key] = Encoder(*key)
    return known[key]


def token_widths(ranks_path: str):
    """Bytes of each token id."""
    import numpy as np

    with open(ranks_path, "rb") as lines:
        pairs = [(int(rank), len(base64.b64decode(token))) for token, rank in map(bytes.split, lines)]
    widths = np.zeros(max(rank for rank, _ in pairs) + 2, np.int64)
    for rank, width in pairs:
        widths[rank] = width
    widths[-1] = len(SPECIAL)
    return widths
