"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import BLOCK_BYTES, blocks, ship, strings, utf8  # noqa: F401  (operators take them from here)


class Ids(dict):
    """Numbers for keys in order of first sight; ``seen`` is shared by tables with one number range."""

    def __init__(self, seen: list, mark):
        super().__init__()
        self.seen, self.mark = seen, mark

    def __missing__(self, key):
        i = self[key] = len(self.seen)
        self.seen.append(self.mark(key))
        return i


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i]+lengths[i]`` of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): counters to independent-looking words."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit words to the open interval (0, 1)."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField], by: str = "text", limit: int = 2 * BLOCK_BYTES) -> DataFrame:
    """``df`` and the columns that ``make`` gives for each part of an Arrow batch.

    A part is so many rows that the texts in column ``by`` take up to ``limit`` bytes, one row at least: what a worker
    holds doesn't grow with the batch. An input column that has the name of a new one (in any case of letters) gives
    way to it.
    """
    taken = {f.name.lower() for f in fields}
    kept = [f.name for f in df.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(by), limit):
                part = batch.slice(a, b - a)
                new = make(part)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [new[k] for k in names], names=kept + names)

    ship(df.sparkSession)
    schema = T.StructType([df.schema[k] for k in kept] + fields)
    return df.mapInArrow(run, schema)


def keyed(df: DataFrame, id_col: str) -> tuple[Column, Column]:
    """(id as text, hash of all columns): what tells rows apart; rows that have both alike are equal in all columns.

    A null id has a text that no id has. Columns with maps can't be hashed and aren't. A null is hashed by its place.
    """
    c = F.col(f"`{id_col}`")
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "interval"))]
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string"))), F.xxhash64(*hashable, *[c.isNull() for c in hashable])
