"""Plug-in points for outside services, with deterministic offline defaults.

Everything that talks to the outside (token vocabularies, embeddings, text
models, document converters, mail) is a small callable handed to a Spark
operator, which runs it per Arrow batch inside the tasks.
"""

from __future__ import annotations

import os
import sys
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.schemas import EMBED_BATCH, EMBED_DIMS

# One vector, a list or an array of floats, per text.
EmbedBatch = Callable[[list[str]], list]

# Environment variable of each provider's key and its placeholders.
PROVIDER_KEYS = {"openrouter": "OPENROUTER_API_KEY", "gemini": "GEMINI_API_KEY"}
PLACEHOLDER_KEYS = ("...", "sk-or-...")
RETRY_STATUS = (429, 500, 502, 503)
RETRY_TEXTS = ("429", "500", "502", "503", "RESOURCE_EXHAUSTED")

# Model calls travel with the plan, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Retry:
    """Exponential back-off: ``attempts`` tries, waits clamped to [low, high] seconds."""

    attempts: int
    factor: float
    low: float
    high: float
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def wait(self, attempt: int) -> float:
        return max(self.low, min(self.high, self.factor * 2 ** attempt))

    def call(self, fn: Callable, *args):
        for attempt in range(self.attempts):
            try:
                return fn(*args)
            except Exception as exc:
                if attempt + 1 == self.attempts or not is_retryable(exc):
                    raise
                self.sleep(self.wait(attempt))


# Retry policy of each kind of call.
RETRIES = {
    "gemini_documents": Retry(8, 4, 10, 120),
    "gemini_query": Retry(3, 2, 2, 30),
    "openrouter_documents": Retry(5, 2, 4, 60),
    "openrouter_query": Retry(3, 2, 2, 30),
    "book_map": Retry(5, 2, 4, 120),
}


def is_retryable(exc: BaseException) -> bool:
    """Rate limits and transient server errors, by status when known, else by text."""
    status = getattr(exc, "status_code", None)
    if status is not None:
        return status in RETRY_STATUS
    return any(mark in str(exc) for mark in RETRY_TEXTS)


def api_key(provider: str) -> str:
    if provider not in PROVIDER_KEYS:
        raise ValueError(f"Unknown provider: {provider}")
    name = PROVIDER_KEYS[provider]
    value = os.getenv(name, "")
    if not value or value in PLACEHOLDER_KEYS:
        raise ValueError(f"Missing {name}")
    return value


class RateLimited(RuntimeError):
    """Raised by a page request the service asks to repeat later."""


def patient(request: Callable[..., str], attempts: int = 3, pause: float = 5.0,
            sleep: Callable[[float], None] = time.sleep) -> Callable[..., str]:
    """Repeat a page-conversion request: rate limits wait 10, 20, 40 s, other faults ``pause``."""

    def run(*args) -> str:
        last: Exception | None = None
        for attempt in range(attempts):
            try:
                return request(*args)
            except RateLimited as exc:
                last = exc
                sleep(10 * 2 ** attempt)
            except Exception as exc:
                last = exc
                if attempt + 1 < attempts:
                    sleep(pause)
        raise last

    return run


def hashed_embedding(texts: list[str], dims: int = EMBED_DIMS) -> list[np.ndarray]:
    """Offline stand-in: a unit vector of hashed word counts, equal for equal texts."""
    out = []
    for text in texts:
        vector = np.zeros(dims, dtype=np.float64)
        for word in text.lower().split():
            code = zlib.crc32(word.encode("utf-8"))
            vector[code % dims] += 1.0 if code & 0x10000 else -1.0
        norm = np.linalg.norm(vector)
        out.append(vector / norm if norm else vector)
    return out


@dataclass(frozen=True)
class Embedder:
    """Documents and questions may be embedded with different task types."""

    name: str = "hashed"
    dims: int = EMBED_DIMS
    documents: EmbedBatch | None = None
    query: Callable[[str], list[float]] | None = None
    retry: Retry | None = None

    def embed_documents(self, texts: list[str]) -> list:
        fn = self.documents or partial(hashed_embedding, dims=self.dims)
        vectors = self.retry.call(fn, texts) if self.retry else fn(texts)
        if len(vectors) != len(texts) or any(len(v) != self.dims for v in vectors):
            raise ValueError(f"embedder {self.name} must return {len(texts)} vectors of {self.dims}")
        return vectors

    def embed_query(self, text: str) -> list[float]:
        if self.query is not None:
            return self.retry.call(self.query, text) if self.retry else self.query(text)
        return self.embed_documents([text])[0]


def embed_children(children: DataFrame, embedder: Embedder, batch: int = EMBED_BATCH) -> DataFrame:
    """Add ``vector``; texts go to the embedder in groups of ``batch`` per call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["context_text"].tolist()
            vectors: list = []
            for at in range(0, len(texts), batch):
                vectors.extend(np.asarray(v, dtype=np.float32) for v in embedder.embed_documents(texts[at:at + batch]))
            if any(v.shape != (embedder.dims,) or np.isnan(v).any() for v in vectors):
                raise ValueError(f"embedder {embedder.name} must give {embedder.dims} numbers per text")
            yield frame.assign(vector=vectors)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in children.schema) + ", vector array<float>"
    return children.mapInPandas(run, schema)


def arrow_token_counter(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """Turn a tokenizer's ``encode`` into a counter over ``array<string>`` columns."""

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        flat = texts.flatten().to_pylist()
        sizes = pa.array([len(encode(t)) for t in flat], pa.int32())
        offsets = np.concatenate([[0], np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sizes)

    return count


def bpe_token_counter() -> Callable[[Column], Column]:
    """cl100k_base counts; needs the vocabulary on every worker."""
    import tiktoken

    class Lazy:
        encoding = None

        def __call__(self, text: str) -> list:
            if Lazy.encoding is None:
                Lazy.encoding = tiktoken.get_encoding("cl100k_base")
            return Lazy.encoding.encode(text)

    return arrow_token_counter(Lazy())
