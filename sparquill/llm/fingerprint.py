"""Document fingerprints by consistent weighted sampling.

For a term and each of ``SAMPLES`` samples, seeded draws give r ~ Gamma(2, 1), c ~ Gamma(2, 1) and
b ~ Uniform(0, 1). For weight w the sample is the integer t = floor(ln w / r + b), with
ln y = r (t - b) and ln a = ln c - ln y - r; a document's sample is the (term, t) with the least a.
Two documents have the same sample with a probability that is their generalised Jaccard similarity,
the sum of the lesser weights over the sum of the greater ones.

Weights are a function of the count, so ln a and the hash of (term, t) are kept for each (term,
count) a worker has met; a document takes the least of its rows. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, mix64, strings, unit

SAMPLES = 64
CACHE = 80_000
#: Rows gathered at once for a document: a longer one is handled in parts, whole.
PART = 8192
_WORD = re.compile(r"\w+")


def weight_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def draws(terms: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b) of 64-bit term hashes, a row each."""
    base = mix64(terms[:, None] ^ mix64(np.arange(1, samples + 1, dtype=np.uint64))[None, :])
    u = []
    for _ in range(5):
        base = mix64(base)
        u.append(unit(base))
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]


def sample_rows(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, hash of (term, t)) for weighted terms, a row each."""
    r, c, b = draws(terms, samples)
    t = np.floor(np.log(weights)[:, None] / r + b)
    a = c - r * (t - b) - r
    return a.astype(np.float32), mix64(terms[:, None] ^ mix64(t.astype(np.int64).view(np.uint64))).view(np.int64)


class Sampler:
    def __init__(self, samples: int):
        self.samples = samples
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple[str, int], int] = {}
        self.a = np.zeros((1024, self.samples), np.float32)
        self.value = np.zeros((1024, self.samples), np.int64)

    def _add(self, new: list[tuple[str, int]]) -> None:
        first, need = len(self.number), len(self.number) + len(new)
        for k, key in enumerate(new):
            self.number[key] = first + k
        if need > len(self.a):
            size = max(need, len(self.a) * 3 // 2)
            for name in ("a", "value"):
                old = getattr(self, name)
                more = np.zeros((size, self.samples), old.dtype)
                more[:first] = old[:first]
                setattr(self, name, more)
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            terms = np.array([xxhash.xxh3_64_intdigest(w) for w, _ in part], np.uint64)
            a, value = sample_rows(terms, weight_of(np.array([n for _, n in part], np.float64)), self.samples)
            self.a[first + k : first + k + len(part)] = a
            self.value[first + k : first + k + len(part)] = value

    def signature(self, text: str | None) -> np.ndarray | None:
        items = Counter(_WORD.findall(text.lower())).items() if text else ()
        if not items:
            return None
        number = self.number
        new = [k for k in items if k not in number]
        if new:
            if len(number) + len(new) > CACHE:
                self.reset()
                number, new = self.number, list(items)
            self._add(new)
        ids = np.fromiter(map(number.__getitem__, items), np.int64, len(items))
        column = np.arange(self.samples)
        best, value = None, None
        for k in range(0, len(ids), PART):
            rows = ids[k : k + PART]
            some = self.a[rows]
            at = some.argmin(0)
            least, got = some[at, column], self.value[rows[at], column]
            if best is None:
                best, value = least, got
            else:
                better = least < best
                best, value = np.where(better, least, best), np.where(better, got, value)
        return value


_SAMPLERS: dict[int, Sampler] = {}


def fingerprints(docs: DataFrame, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Add ``fingerprint``, an array of ``samples`` bigints.

    Terms are lower-case words, weighted 1 + ln(count). A text that is null or has no word has a null fingerprint.
    Repeated rows have the same one. Input columns of that name are replaced; all others stay.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sampler = _SAMPLERS.setdefault(samples, Sampler(samples))
        texts = strings(batch.column(text_col))
        got = [sampler.signature(t) for t in texts.to_pylist()]
        some = [g for g in got if g is not None]
        ends = np.concatenate(([0], np.cumsum([0 if g is None else samples for g in got]))).astype(np.int32)
        mask = pa.array([g is None for g in got], pa.bool_())
        flat = np.concatenate(some) if some else np.zeros(0, np.int64)
        return {"fingerprint": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()), mask=mask)}

    return add_columns(docs, make, [T.StructField("fingerprint", T.ArrayType(T.LongType(), False))], text_col)


def similarity(a, b) -> F.Column:
    """Estimated generalised Jaccard similarity of two fingerprint columns: the share of equal samples."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return equal / F.size(a)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
