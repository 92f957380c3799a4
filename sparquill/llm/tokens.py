"""Token counts by a two-tier look-up on the map side.

A first pass gives each partition's most frequent pre-tokens (a summary of bounded size, over all
documents); the most frequent of all are encoded once, and a compact table of their hashes and
lengths is broadcast. In the second pass a pre-token is looked up in that table; a miss is encoded
by the worker, which keeps what it has encoded. Pre-tokens themselves are never shuffled.

What is looked up is a piece: what lies between two spaces that begin pre-tokens, mostly one pre-token, or
one with its punctuation; it is always whole pre-tokens, so lengths add up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship, stored
from .bpe import Vocabulary, merge_all, pieces, vocabulary, vocabulary_path
from .common import BLOCK_BYTES, add_columns, strings

#: Pre-tokens in the broadcast table, at most, and of each partition's summary.
TABLE, SUMMARY = 65_536, 8192
#: Steps in a doubling of the count.
STEPS = 64
#: Counters a partition holds while it reads; beyond, the rarer half goes (lossy counting).
HELD = 400_000
CACHE = 300_000


def frequent(docs: DataFrame, text_col: str = "text", table: int = TABLE) -> list[str]:
    """The most frequent pieces that follow a space, most frequent first; ties by code points.

    Counts are cut at a step of their logarithm, so there can be somewhat fewer than ``table``.
    """
    ship(docs.sparkSession)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in strings(batch.column(0)).to_pylist():
                if t:
                    counts.update(pieces(t)[1:])
            if len(counts) > HELD:
                counts = Counter(dict(counts.most_common(HELD // 2)))
        top = counts.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    summary = docs.select(text_col).mapInArrow(run, "piece string, n bigint").where("piece <> ''")
    counts = stored(summary.groupBy("piece").agg(F.sum("n").alias("n")).withColumn("step", (F.log2("n") * STEPS).cast("int")), "pieces")
    # how many pieces each step of the (logarithmic) count has: a few thousand rows, whatever the corpus
    room, cut = table, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        if r["count"] > room:
            break
        room, cut = room - r["count"], r.step
    if cut is None:
        return []
    top = counts.where(F.col("step") >= cut).select("piece", "n").collect()  # at most ``table`` rows
    return [r.piece for r in sorted(top, key=lambda r: (-r.n, r.piece))]


def piece_lengths(vocab: Vocabulary, todo: list[str]) -> np.ndarray:
    """Numbers of tokens of pieces that are whole pre-tokens, or several."""
    out = np.ones(len(todo), np.int64)
    rest: list[bytes] = []
    owner: list[int] = []
    ranks, find = vocab.ranks, vocab.pattern.findall
    for i, piece in enumerate(todo):
        raw = piece.encode()
        if raw in ranks:
            continue
        out[i] = 0
        # a space and letters are one pre-token
        for token in (raw,) if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()) else [t.encode() for t in find(piece)]:
            if token in ranks:
                out[i] += 1
            else:
                rest.append(token)
                owner.append(i)
    np.add.at(out, np.array(owner, np.int64), merge_all(vocab, rest)[1])
    return out


class Table:
    """Sorted hashes of pieces, and their lengths: 9 bytes a piece."""

    def __init__(self, words: list[str], path: str):
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        n = piece_lengths(vocabulary(path), [" " + w for w in words])
        fits = n < 256
        order = np.argsort(h[fits], kind="stable")
        self.keys, self.lengths = h[fits][order], n[fits][order].astype(np.uint8)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Lengths, and -1 for a miss."""
        if not len(self.keys) or not words:
            return np.full(len(words), -1, np.int64)
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.lengths[at].astype(np.int64), -1)


class Lengths:
    """Lengths of pieces that a worker has met: from the table, or encoded."""

    def __init__(self, table: Table, path: str):
        self.table, self.path, self.known = table, path, {}

    def counts(self, texts: list[str | None]) -> list[int | None]:
        if len(self.known) > CACHE:
            self.known.clear()
        known, rows, new = self.known, [], {}
        for t in texts:
            parts = pieces(t) if t else None
            rows.append(parts)
            if parts:
                for p in parts[1:]:
                    if p not in known:
                        new[p] = None
        words = list(new)
        n = self.table.look_up(words)
        miss = np.flatnonzero(n < 0).tolist()
        heads = [i for i, r in enumerate(rows) if r]
        # all that needs encoding goes at once: merges are shared by its pieces
        found = piece_lengths(vocabulary(self.path), [" " + words[k] for k in miss] + [rows[i][0] for i in heads])
        n[miss] = found[: len(miss)]
        known.update(zip(words, n.tolist()))
        first = dict(zip(heads, found[len(miss) :].tolist()))
        get = known.__getitem__
        return [None if t is None else 0 if not t else first[i] + sum(map(get, rows[i][1:])) for i, t in enumerate(texts)]


_LENGTHS: dict[int, Lengths] = {}


def token_counts(docs: DataFrame, vocab_path: str | None = None, text_col: str = "text", table: int = TABLE) -> DataFrame:
    """Add ``n_tokens``, the number of tokens that encoding the text gives.

    A null text has null, an empty one 0; a very long one is cut into pieces and counted whole, and double spaces, line
    breaks and white space at the end change nothing about that. Repeated rows have the same count, an empty table has
    no row. Input columns of that name are replaced; all others stay.
    """
    path = vocab_path or vocabulary_path()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Table(frequent(docs, text_col, table), path))

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own = _LENGTHS.get(id(shared.value))
        if own is None:
            _LENGTHS.clear()
            own = _LENGTHS[id(shared.value)] = Lengths(shared.value, path)
        texts = strings(batch.column(text_col))
        return {"n_tokens": pa.array(own.counts(texts.to_pylist()), pa.int64())}

    return add_columns(docs, make, [T.StructField("n_tokens", T.LongType())], text_col, 4 * BLOCK_BYTES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
