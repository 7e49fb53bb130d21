"""Model services behind protocols, with deterministic stand-ins.

A stand-in hashes words; what it returns says nothing about any model's quality.
Providers are called per batch in Arrow batches, and built once per task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
EMBED_BATCH = 10
RETRIES = 3


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[float]: ...


class Writer(Protocol):
    """Contexts, summaries, rewritten queries, transcriptions: text from text."""

    def write(self, prompt: str) -> str: ...


class ImageEmbedder(Protocol):
    """Vectors of images, and of texts in the images' space."""

    def embed_images(self, images: list[bytes]) -> np.ndarray: ...

    def embed_texts(self, texts: list[str]) -> np.ndarray: ...


class Viewer(Protocol):
    """Text from an image: a transcription, the tags of a tile, a page's gist; and why it ended."""

    def view(self, image: bytes, strict: bool) -> tuple[str, str | None]: ...


class Answerer(Protocol):
    """An answer in pieces, from a prompt and the images of pages (data URIs)."""

    def stream(self, prompt: str, images: list[str]) -> Iterator[str]: ...


class HashEmbedder:
    """Words hashed into a vector; a stand-in, not a model."""

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % DIMENSIONS] += 1 if h >> 16 & 1 else -1
        return out


class HashImageEmbedder:
    """Bytes of images and words of texts hashed into one space; a stand-in, not a model."""

    def embed_images(self, images: list[bytes]) -> np.ndarray:
        return np.stack([np.bincount(np.frombuffer(b, np.uint8) % DIMENSIONS, minlength=DIMENSIONS) for b in images]).astype(np.float32)

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return HashEmbedder().embed(texts)


class PrintedText:
    """Takes an image's bytes for the text that it shows; a stand-in, not a model."""

    def view(self, image: bytes, strict: bool) -> tuple[str, str | None]:
        return image.decode("utf-8", "replace"), "stop"


class FirstWords:
    """Streams the first words of a prompt; a stand-in, not a model."""

    def stream(self, prompt: str, images: list[str]) -> Iterator[str]:
        yield from (word + " " for word in prompt.split()[:3])


#: Fixed value: what stands before the question in a prompt.
QUESTION_HEAD = "用户问题："


class KeywordReply:
    """Answers a question (behind its head in the prompt) with JSON: the question, and its longer words as keywords; a stand-in, not a model."""

    def write(self, prompt: str) -> str:
        question = prompt.rsplit(QUESTION_HEAD, 1)[-1]
        return json.dumps({"query": question, "keywords": " ".join(w for w in question.split(" ") if len(w) > 6)}, ensure_ascii=False)


class OverlapReranker:
    """Share of the query's words that a document has; a stand-in, not a model."""

    def rerank(self, query: str, documents: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(d.lower().split())) / max(1, len(words)) for d in documents]


class FirstSentence:
    """The first 120 characters of the prompt's last paragraph; a stand-in, not a model."""

    def write(self, prompt: str) -> str:
        return prompt.rsplit("\n\n", 1)[-1][:120]


def embedded(text: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    """Vectors of a text column, ``EMBED_BATCH`` texts a call.  Null counts as empty; a failing provider fails the task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [provider.embed(texts[i : i + EMBED_BATCH]) for i in range(0, len(texts), EMBED_BATCH)]
            yield pd.Series([v for p in parts for v in p])

    return run(text)


def answered(columns: list[Column], call: Callable[..., object], make: Callable[[], object], kind: str, failing: bool = True) -> Column:
    """``call(provider, *values)`` for every row, one provider a task.

    Null where a call fails, if ``failing`` is allowed; else the task fails with it.
    """

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        provider = make()

        def one(*values):
            try:
                return call(provider, *values)
            except Exception:
                if not failing:
                    raise
                return None  # a provider's failure costs this row only

        for batch in batches:
            series = batch if isinstance(batch, tuple) else (batch,)
            yield pd.Series([one(*values) for values in zip(*series, strict=True)], dtype=object)

    return run(*columns)


def written_or(prompt: Column, default: Column, make: Callable[[], Writer] = FirstSentence) -> Column:
    """What the provider writes; ``default`` where it fails or writes nothing."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()

        def one(p: str | None) -> str | None:
            try:
                return (provider.write(p or "") or "").strip() or None
            except Exception:
                return None  # a provider's failure costs this text only

        for batch in batches:
            yield batch.map(one)

    return F.coalesce(run(prompt), default)


def reranked(pool: DataFrame, make: Callable[[], Reranker] = OverlapReranker, top: int = 5) -> DataFrame:
    """(query_id, chunk_id, score, rank) of a pool (query_id, query_text, chunk_id, text, rank): the provider's order.

    A pool is at most a few rows a query.  Where the provider fails, the order it had stays.
    """

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        try:
            rows["score"] = make().rerank(rows["query_text"].iloc[0], rows["text"].tolist())
            rows = rows.sort_values(["score", "rank"], ascending=[False, True])
        except Exception:
            rows["score"] = 1.0 / (61 + rows["rank"])
        rows = rows.head(top)
        rows["rank"] = range(len(rows))
        return rows[["query_id", "chunk_id", "score", "rank"]]

    return pool.groupBy("query_id").applyInPandas(order, "query_id long, chunk_id long, score double, rank int")


def transcribed(attempt: Callable[[int], tuple[str, str | None]], is_bad: Callable[[str, str | None], bool]) -> str:
    """A page's text: the first attempt that isn't bad, else the longest of 1 + ``RETRIES``."""
    texts = []
    for i in range(1 + RETRIES):
        text, reason = attempt(i)
        if not is_bad(text, reason):
            return text
        texts.append(text)
    return max(texts, key=len)
