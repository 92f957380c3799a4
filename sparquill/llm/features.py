"""Byte-level features of texts and of their lines, computed for a whole Arrow batch at once."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
import xxhash

from .common import utf8

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "high")
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[128:] = 6

#: Features of a segment, in this order; all are shares but the length.
NAMES = ("one", "upper", "digit", "symbol", "stop", "high", "space", "adjacent", "distinct", "length", "symbol_words")


def segment_features(starts: np.ndarray, ends: np.ndarray, raw: np.ndarray, words: list[list[str]]) -> np.ndarray:
    """One row for each segment ``raw[starts[i]:ends[i]]``; ``words`` are its words.

    An empty segment has zeros, but for the constant.
    """
    n = len(starts)
    out = np.zeros((n, len(NAMES)), np.float32)
    out[:, 0] = 1
    if not n:
        return out
    length = (ends - starts).astype(np.float64)
    per = length + 40  # so that the shares of a few words tell little
    classes = _CLASS[raw]
    share = {}
    for c in (0, 1, 2, 3, 4, 5, 6):
        sums = np.concatenate(([0], np.cumsum(classes == c, dtype=np.int64)))
        share[c] = sums[ends] - sums[starts]
    letters = share[0] + share[1] + share[6] + 20
    out[:, 1] = share[1] / letters
    out[:, 2] = share[2] / per
    out[:, 3] = share[5] / per
    out[:, 4] = share[4] / per
    out[:, 5] = share[6] / per
    out[:, 6] = share[3] / per
    count = np.array([len(w) for w in words], np.float64)
    some = count + 6
    out[:, 7] = np.array([sum(map(eq, w, w[1:])) for w in words]) / some
    # the number of distinct words grows with about the 0.7th power of their number; a few words say nothing
    out[:, 8] = np.where(count < 8, 1.5, np.minimum(1.5, np.array([len(set(w)) for w in words]) / np.maximum(count, 1) ** 0.7))
    out[:, 9] = np.log1p(length) / 10
    out[:, 10] = np.minimum(1, share[5] / some)
    return out


def document_features(texts: pa.Array) -> np.ndarray:
    offsets, raw = utf8(texts)
    return segment_features(offsets[:-1], offsets[1:], raw, [t.split() if t else [] for t in texts.to_pylist()])


#: Buckets that byte trigrams are hashed to.
GRAMS = 256


def gram_shares(texts: pa.Array, buckets: int = GRAMS) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, a row a text; the shares of a short text are damped."""
    offsets, raw = utf8(texts)
    n = len(offsets) - 1
    if len(raw) < 3:
        return np.zeros((n, buckets), np.float32)
    b = raw.astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    row = np.repeat(np.arange(n), np.diff(offsets))
    inside = row[:-2] == row[2:]  # not across texts
    counts = np.bincount(row[:-2][inside] * buckets + h[inside] % np.uint32(buckets), minlength=n * buckets).reshape(n, buckets)
    return np.sqrt(counts / (counts.sum(1, keepdims=True) + 300)).astype(np.float32)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that aren't blank, their bytes, whether an earlier line of the text is the same, their hashes, and how many lines each text has."""
    offsets, raw = utf8(texts)
    breaks = np.flatnonzero(raw == 10)
    lines_of = np.zeros(len(texts), np.int64)
    words: list[list[str]] = []
    again: list[bool] = []
    hashes: list[int] = []
    bounds = np.searchsorted(breaks, offsets)
    starts_all, ends_all = [], []
    for i, t in enumerate(texts.to_pylist()):
        if not t:
            continue
        cuts = breaks[bounds[i] : bounds[i + 1]]
        s = np.concatenate(([offsets[i]], cuts + 1))
        e = np.concatenate((cuts, [offsets[i + 1]]))
        keep, seen = [], set()
        for line in t.split("\n"):
            w = line.split()
            keep.append(bool(w))
            if w:
                words.append(w)
                again.append(line in seen)
                seen.add(line)
                hashes.append(xxhash.xxh3_64_intdigest(line.strip()))
        mask = np.array(keep, bool)
        starts_all.append(s[mask])
        ends_all.append(e[mask])
        lines_of[i] = int(mask.sum())
    none = np.zeros(0, np.int64)
    starts = np.concatenate(starts_all) if starts_all else none
    ends = np.concatenate(ends_all) if ends_all else none
    used = segment_features(starts, ends, raw, words)
    return used, ends - starts, np.array(again, bool), np.array(hashes, np.uint64), lines_of
