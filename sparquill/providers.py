"""Embeddings and language models behind interfaces; the offline ones are deterministic."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import blocks

#: Text bytes that a provider gets at once.
PART_BYTES = 1 << 20


class EmbeddingProvider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class LLMProvider(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class HashEmbedding:
    """Signed feature hashing of words, scaled to unit length; a text without words is zero."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class ExtractiveModel:
    """Answers with the prompt's first lines: a stand-in that needs no network."""

    def __init__(self, lines: int = 3):
        self.lines = lines

    def complete(self, prompts: list[str]) -> list[str]:
        return ["\n".join([x for x in p.split("\n") if x.strip()][: self.lines]) for p in prompts]


_EMBEDDINGS: dict[str, Callable[[], EmbeddingProvider]] = {"hash": HashEmbedding}
_MODELS: dict[str, Callable[[], LLMProvider]] = {"extractive": ExtractiveModel}


def register_embedding(name: str, make: Callable[[], EmbeddingProvider]) -> None:
    _EMBEDDINGS[name] = make


def register_model(name: str, make: Callable[[], LLMProvider]) -> None:
    _MODELS[name] = make


def embed(text: Column, provider: str = "hash") -> Column:
    """Vectors of texts; a null or blank text has the zero vector."""
    make = _EMBEDDINGS[provider]

    @F.arrow_udf("array<float>")
    def udf(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in _parts(columns):
            out = np.asarray(model.embed(texts), np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return udf(text)


def complete(prompt: Column, provider: str = "extractive") -> Column:
    make = _MODELS[provider]

    @F.arrow_udf("string")
    def udf(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for prompts in _parts(columns):
            yield pa.array(model.complete(prompts), pa.string())

    return udf(prompt)


def _parts(columns: Iterator[pa.Array]) -> Iterator[list[str]]:
    """Texts, nulls as empty ones, so many at once as take ``PART_BYTES``: what a worker holds doesn't grow with the Arrow batch."""
    for column in columns:
        for a, b in blocks(column, PART_BYTES):
            yield [x or "" for x in column.slice(a, b - a).to_pylist()]


def embed_missing(chunks: DataFrame, cached: DataFrame, provider: str = "hash") -> DataFrame:
    """Embeddings of the chunks that ``cached(chunk_id, vec)`` lacks; append them to it."""
    todo = chunks.join(cached.select("chunk_id"), "chunk_id", "left_anti")
    return todo.select("chunk_id", embed(F.col("text"), provider).alias("vec"))


def understood(docs: DataFrame, model: str = "extractive", provider: str = "hash") -> DataFrame:
    """``docs`` with ``summary``, what the model says of the text, and with the vectors of both: ``vec`` and ``summary_vec``.

    A null or blank text has an empty summary and zero vectors. Rows stay where they are.
    """
    told = docs.withColumn("summary", complete(F.coalesce("text", F.lit("")), model))
    return told.withColumn("vec", embed(F.col("text"), provider)).withColumn("summary_vec", embed(F.col("summary"), provider))


def audited(answers: DataFrame, model: str = "extractive") -> DataFrame:
    """The audit table of ``(prompt, response)`` rows: with the model's name and the words of either side."""
    n = lambda c: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).cast("long")
    return answers.select(F.lit(model).alias("model"), "prompt", "response", n(F.col("prompt")).alias("prompt_tokens"), n(F.col("response")).alias("completion_tokens"))


def usage(audit: DataFrame) -> DataFrame:
    """Calls and tokens of each model."""
    return audit.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def prompt(system: Column, contexts: Column, question: Column) -> Column:
    """System text, numbered contexts (path, text), question."""
    shown = F.array_join(F.transform(contexts, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". File: "), c["path"], F.lit("\n"), c["text"])), "\n\n")
    return F.concat(system, F.lit("\n\n"), shown, F.lit("\n\n"), question)
