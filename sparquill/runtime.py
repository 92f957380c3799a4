"""What every plan needs: shared storage, lineage cuts, shipping of this package, parts of Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a local folder takes its place, if executors are threads of this process (tests, a
    laptop); on a cluster its absence is an error, as executors couldn't read what others wrote.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparquill.shared.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparquill-")
        spark.conf.set("sparquill.shared.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Folders that ``stored`` writes to, the innermost last.
_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """What ``stored`` writes inside is deleted at the end: write the result before."""
    base = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(base)
    try:
        yield base
    finally:
        _SCRATCH.remove(base)
        remove(spark, base)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Inside ``scratch`` it goes when that ends."""
    base = _SCRATCH[-1] if _SCRATCH else shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}.parquet"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back. Inside ``scratch`` it goes when that ends."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """What the rounds of a loop give, a stored table each. Nothing of a round's plan is in the next one's: a checkpoint
    keeps the constraints that Spark found for its rows, and those of a union multiply from round to round."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths, self.schema = spark, name, [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Store a round and read it."""
        self.paths.append(folder(self.spark, self.name))
        self.schema = self.schema or df.schema
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or ".zip/" in str(root):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="sparquill-ship-"), "sparquill_ship.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(out)


#: Text bytes handled at once as Python strings.
BLOCK_BYTES = 1 << 21


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One ``string`` array (32-bit offsets fit: an Arrow batch holds less than 2 GB)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if column.type == pa.string() else column.cast(pa.string())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null rows are empty."""
    column = strings(column)
    if column.null_count:
        column = column.fill_null("")
    n, first = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int32)[first : first + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts (or lists) take up to ``limit`` bytes; a longer one stands alone, whole."""
    if pa.types.is_list(column.type):
        offsets = column.offsets.to_numpy().astype(np.int64) * 8
    else:
        offsets, _ = utf8(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
