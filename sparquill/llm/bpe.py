"""Byte-pair encoding by a pair occurrence index, and its decoding.

The unique pre-tokens of an Arrow batch of a partition are laid out as one array of symbols.
An index maps the rank of each adjacent pair to all its positions. Active ranks are applied in
ascending order, each to all of its positions at once; the lists of the pairs that begin or
end at a merged position are updated. A worker keeps what it has encoded, so a pre-token is
merged once a worker as long as the cache (``CACHE`` pieces) holds it. No row is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BLOCK_BYTES, Ids, add_columns, blocks, ragged, strings

CACHE = 200_000
NONE = np.int32(2**31 - 1)
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: A space before white space or at the end.
_LOOSE = re.compile(r" (?:\s|\Z)")
#: A space that begins a pre-token: the one before what isn't white space. (White space as the pre-token pattern has it.)
_LEADING = regex.compile(r" (?=\S)")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Ranks of a byte-level vocabulary, with pair ranks in an open-addressing table."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.size = max(self.ranks.values()) + 1
        words = [b""] * self.size
        for w, r in self.ranks.items():
            words[r] = w
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        keys, values = [], []
        get = self.ranks.get
        for w, r in self.ranks.items():
            for k in range(1, len(w)):
                a = get(w[:k])
                if a is not None:
                    b = get(w[k:])
                    if b is not None:
                        keys.append(a << 32 | b)
                        values.append(r)
        self._build(np.array(keys, np.uint64), np.array(values, np.int32))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        left = np.flatnonzero((out == NONE) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]] == keys[left]
            out[left[found]] = self.values[slot[left[found]]]
            left = left[~found & (self.keys[slot[left]] != np.uint64(2**64 - 1))]
        return out


def pieces(text: str) -> list[str]:
    """The text cut at the spaces that begin pre-tokens, without these spaces: every piece is one or more whole pre-tokens."""
    return _LEADING.split(text) if _LOOSE.search(text) else text.split(" ")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(vocab: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after another, and how many each piece has."""
    counts = np.array([len(p) for p in pieces], np.int64)
    sym = vocab.of_byte[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
    n = len(sym)
    if not n:
        return np.zeros(0, np.int32), counts
    if (sym < 0).any():
        raise ValueError("the vocabulary lacks a byte")
    owner = np.repeat(np.arange(len(pieces)), counts)
    same = np.zeros(n, bool)
    same[:-1] = owner[1:] == owner[:-1]
    nxt = np.where(same, np.arange(1, n + 1), -1).astype(np.int32)
    prv = np.full(n, -1, np.int32)
    prv[1:][same[:-1]] = np.flatnonzero(same)
    rank = np.full(n, NONE, np.int32)
    at = np.flatnonzero(same)
    rank[at] = vocab.pair_ranks(sym[at], sym[at + 1])
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(positions: np.ndarray) -> None:
        r = rank[positions]
        known = r != NONE
        positions, r = positions[known], r[known]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        positions, r = positions[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for one, part in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts) if len(cuts) else [positions]):
            if one in index:
                index[one].append(part)
            else:
                index[one] = [part]
                heapq.heappush(heap, one)

    note(at)
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        pos = pos[rank[pos] == r]
        if len(pos) > 1:  # of overlapping pairs, every other one counts, from the left
            joined = nxt[pos[:-1]] == pos[1:]
            if joined.any():
                i = np.arange(len(pos))
                begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~joined)), i, 0))
                pos = pos[(i - begin) % 2 == 0]
        if not len(pos):
            continue
        right = nxt[pos]
        after = nxt[right]
        sym[pos] = r
        alive[right] = False
        rank[right] = NONE
        nxt[pos] = after
        has = after >= 0
        prv[after[has]] = pos[has]
        rank[pos] = NONE
        if has.any():
            rank[pos[has]] = vocab.pair_ranks(sym[pos[has]], sym[after[has]])
        left = prv[pos]
        left = left[left >= 0]
        if len(left):
            rank[left] = vocab.pair_ranks(sym[left], sym[nxt[left]])
            note(np.unique(np.concatenate((left, pos))))
        else:
            note(pos)
    return sym[alive], np.bincount(owner[alive], minlength=len(pieces)).astype(np.int64)


class Encoder:
    """Encodes texts; pieces already met are looked up."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.reset()

    def reset(self) -> None:
        self.seen: list[bytes] = []
        self.led = Ids(self.seen, lambda p: (" " + p).encode())  # keys lack their leading space
        self.bare = Ids(self.seen, str.encode)
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def piece_ids(self, text: str) -> list[int]:
        """Numbers of the text's pieces; a piece is one or more whole pre-tokens."""
        if not text:
            return []
        parts = pieces(text)
        head = parts[0]
        out = list(map(self.led.__getitem__, parts))
        out[0] = self.bare[head]
        return out

    def _encode_new(self) -> None:
        new = self.seen[len(self.lengths) :]
        if not new:
            return
        get, find = self.vocab.ranks.get, self.vocab.pattern.findall
        whole, todo, tokens_of = {}, [], []
        for i, piece in enumerate(new):
            one = get(piece)
            if one is not None or not piece:
                whole[i] = one
                continue
            for token in [t.encode() for t in find(piece.decode())]:
                one = get(token)
                tokens_of.append(i)
                todo.append(token if one is None else one)
        merged, counts = merge_all(self.vocab, [t for t in todo if isinstance(t, bytes)])
        ids: list[list[int]] = [[] if whole.get(i, 0) is None else [whole[i]] if i in whole else [] for i in range(len(new))]
        merged, at, k = merged.tolist(), 0, 0
        for i, t in zip(tokens_of, todo):
            if isinstance(t, bytes):
                ids[i] += merged[at : at + counts[k]]
                at += counts[k]
                k += 1
            else:
                ids[i].append(t)
        lengths = np.array([len(x) for x in ids], np.int64)
        starts = np.cumsum(lengths) - lengths + len(self.flat)
        self.flat = np.concatenate((self.flat, np.array([y for x in ids for y in x], np.int32)))
        self.starts = np.concatenate((self.starts, starts))
        self.lengths = np.concatenate((self.lengths, lengths))

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of the texts, encoded, and how many each text has."""
        if len(self.seen) > CACHE:
            self.reset()
        parts, counts = [], np.zeros(len(texts), np.int64)
        for a, b in blocks(texts):
            block: list[int] = []
            for i, t in enumerate(texts.slice(a, b - a).to_pylist(), a):
                ids = self.piece_ids(t) if t else []
                counts[i] = len(ids)
                block += ids
            parts.append(np.array(block, np.int32))
        self._encode_new()
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), counts

    def encode(self, texts: pa.Array) -> pa.Array:
        ids, counts = self.pieces(texts)
        per = self.lengths[ids]
        flat = self.flat[ragged(self.starts[ids], per)]
        ends = np.concatenate(([0], np.cumsum(per)))[np.concatenate(([0], np.cumsum(counts)))]
        return lists(ends, flat, texts)

    def count(self, texts: pa.Array) -> np.ndarray:
        ids, counts = self.pieces(texts)
        sums = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        ends = np.concatenate(([0], np.cumsum(counts)))
        return sums[ends[1:]] - sums[ends[:-1]]


def lists(ends: np.ndarray, flat: np.ndarray, texts: pa.Array) -> pa.Array:
    mask = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=mask)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, vocab_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Add ``token_ids`` (array of int) and ``n_tokens`` (bigint).

    A null text has null ids and a null count; an empty text has an empty list and 0. Repeated
    rows are encoded alike. Input columns named like the added ones are replaced; all others stay.
    """
    path = vocab_path or vocabulary_path()

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = encoder(path).encode(strings(batch.column(text_col)))
        lengths = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        return {"token_ids": ids, "n_tokens": pa.array(lengths, mask=ids.is_null().to_numpy(zero_copy_only=False))}

    return add_columns(df, make, [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())], text_col, 2 * BLOCK_BYTES)


def decode_ids(ids: pa.Array, vocab: Vocabulary) -> pa.Array:
    """Texts of lists of ids; bytes that aren't UTF-8 become U+FFFD. A list with an unknown id, or a null, gives null."""
    bounds = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.to_numpy(zero_copy_only=False)
    first = bounds[0] if len(bounds) else 0
    flat = np.asarray(flat[first : bounds[-1]])
    bounds = bounds - first
    known = np.isfinite(flat) if flat.dtype.kind == "f" else np.ones(len(flat), bool)
    known &= (flat >= 0) & (flat < vocab.size)
    out: list[pa.Array] = []
    for at in range(0, len(ids), 512):
        end = min(at + 512, len(ids))
        lo, hi = bounds[at], bounds[end]
        ok = known[lo:hi]
        tokens = np.where(ok, flat[lo:hi], 0).astype(np.int64)
        per = vocab.lengths[tokens]
        raw = vocab.blob[ragged(vocab.starts[tokens], per)].tobytes()
        ends = np.concatenate(([0], np.cumsum(per)))[bounds[at : end + 1] - lo]
        bad = np.add.reduceat(np.concatenate((~ok, [False])), bounds[at:end] - lo) > 0 if hi > lo else np.zeros(end - at, bool)
        bad &= bounds[at + 1 : end + 1] > bounds[at:end]
        bad |= ids.slice(at, end - at).is_null().to_numpy(zero_copy_only=False)
        out.append(pa.array([None if b else raw[i:j].decode(errors="replace") for b, i, j in zip(bad.tolist(), ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def decode(df: DataFrame, vocab_path: str | None = None, ids_col: str = "token_ids") -> DataFrame:
    """Add ``decoded``, the text of the ids. Null ids, and lists with an id outside the vocabulary, give null."""
    path = vocab_path or vocabulary_path()

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"decoded": decode_ids(batch.column(ids_col), vocabulary(path))}

    return add_columns(df, make, [T.StructField("decoded", T.StringType())], ids_col, 2 * BLOCK_BYTES)


def encode_checked(df: DataFrame, vocab_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Add ``token_ids``, ``n_tokens`` and ``round_trip``, whether decoding the ids gives the text again.

    One pass of one worker over the rows does both. A null text has nulls, and its round trip is true.
    """
    path = vocab_path or vocabulary_path()

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = strings(batch.column(text_col))
        ids = encoder(path).encode(texts)
        lengths = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        same = pc.equal(decode_ids(ids, vocabulary(path)), texts).fill_null(True)
        return {"token_ids": ids, "n_tokens": pa.array(lengths, mask=ids.is_null().to_numpy(zero_copy_only=False)), "round_trip": same}

    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return add_columns(df, make, fields, text_col, 2 * BLOCK_BYTES)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text again."""
    return encode_checked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
