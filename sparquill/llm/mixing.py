"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to have the share w of the mixture gets c = w * budget / (its characters) copies of
each document on average. floor(c) copies are certain; the fraction is rounded by the pivotal method:
two fractional documents meet, and mass moves from one to the other, at random but without bias,
until one is integral. The other goes on. So each document keeps its expected number of copies, and
the number of copies of a source is its expected value, rounded up or down.

Metadata alone (never texts) is spread over hash buckets; each bucket rounds its documents a source at
a time, and the one residual of each (bucket, source) goes up a reduction tree, ``FAN_IN`` buckets a
node, first within the source and at the root across sources. All draws are hashes of the rows, so a
task that runs again decides alike, and so does another layout of the files. The rates of sources are a
table that is joined: there may be as many sources as one likes, and one of them may hold most rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship, stored
from .common import keyed, mix64, unit

#: The mixture's shares are those of the sources raised to this power, where none are given.
ALPHA = 0.5
FAN_IN = 32
#: Documents in a bucket, about.
BUCKET_ROWS = 100_000
_EPS = 1e-9


def pivot(ids: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int, float]:
    """Rounds ``p`` in [0, 1) by meetings of neighbours: (0 or 1 each, index of the residual or -1, its mass)."""
    n = len(p)
    out = np.zeros(n, np.int8)
    u = unit(mix64(ids.astype(np.int64).view(np.uint64) ^ mix64(np.array([seed], np.uint64)))).tolist()
    mass = p.tolist()
    held, a = -1, 0.0
    for j in range(n):
        b = mass[j]
        if b <= _EPS:
            continue
        if b >= 1 - _EPS:
            out[j] = 1
            continue
        if held < 0:
            held, a = j, b
            continue
        s = a + b
        if s < 1:  # one of them goes to 0
            if u[j] * s < a:
                a = s
            else:
                held, a = j, s
        else:  # one of them goes to 1
            if u[j] * (2 - s) < 1 - b:
                out[held] = 1
                held, a = j, s - 1
            else:
                out[j] = 1
                a = s - 1
        if a <= _EPS or a >= 1 - _EPS:
            out[held] = a >= 0.5
            held = -1
    return out, held, a if held >= 0 else 0.0


def source_rates(meta: DataFrame, weights: dict[str, float] | None, budget: float | None, alpha: float = ALPHA) -> DataFrame:
    """``(key, rate)``: expected copies of a document of each source. A source without a weight gets none."""
    spark = meta.sparkSession
    totals = meta.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).cast("double").alias("total"))
    if weights is None:
        totals = totals.withColumn("weight", F.pow("total", F.lit(float(alpha))))
    else:
        given = [(_key(s), float(w)) for s, w in weights.items() if w > 0]
        totals = totals.join(spark.createDataFrame(given, "key string, weight double"), "key")
    totals = stored(totals.where("total > 0"), "sources")
    whole = meta.agg(F.sum(F.col("size") * F.col("rows"))).first()[0] if budget is None else budget
    norm = totals.agg(F.sum("weight")).first()[0]
    return totals.select("key", (F.col("weight") / F.lit(float(norm or 1)) * F.lit(float(whole or 0)) / F.col("total")).alias("rate"))


def _key(source: str | None) -> str:
    return "-" if source is None else "=" + source


_PARTS = "node int, k string, h bigint, key string, expected double, copies int, residual double"


def rounded(table: pa.Table, seed: int) -> pa.Table:
    """The rows of a bucket with their copies rounded, a source at a time, in an order by hash; at most one residual a source."""
    h = table.column("h").to_numpy().astype(np.int64)
    _, source = np.unique(np.array(table.column("key").to_pylist(), dtype=object), return_inverse=True) if len(h) else (None, np.zeros(0, np.int64))
    order = np.lexsort((h, mix64(h.view(np.uint64) ^ np.uint64(seed)), source))
    table, h, source = table.take(pa.array(order)), h[order], source[order]
    expected = table.column("expected").to_numpy()
    whole = np.floor(expected + _EPS)
    part = np.maximum(expected - whole, 0)
    got, residual = whole.astype(np.int32), np.zeros(len(h))
    cuts = np.flatnonzero(np.diff(source, prepend=-1, append=-1))
    for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        up, held, mass = pivot(h[at:end], part[at:end], seed)
        got[at:end] += up
        if held >= 0:
            residual[at + held] = mass
    node = pa.array(np.asarray(table.column("node")).astype(np.int32))
    return pa.table({"node": node, "k": table.column("k"), "h": pa.array(h), "key": table.column("key"), "expected": pa.array(expected, pa.float64()), "copies": pa.array(got, pa.int32()), "residual": pa.array(residual)})


def copies(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """``(id, source, expected, copies)`` of every document.

    ``weights`` give the target shares (by characters) of the sources; without them each has its own share to
    the power ``ALPHA``. ``budget`` is the characters of the mixture, those of the input by default. A null source
    is a source too, weighted under the key None. A null or empty text takes no characters but is rounded like
    its source's others; where a source has no characters at all, its documents get no copy. Rows that are equal in
    all columns are one document, which expects as many times the copies; any other row is a document of its own,
    whatever its id, and a null id is an id like any other. The id may have any type.
    """
    return _copies(docs, weights, budget, id_col, source_col, text_col, seed).select("id", "source", "expected", "copies")


def _copies(docs, weights, budget, id_col, source_col, text_col, seed) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    k, h = keyed(docs, id_col)
    size = F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    meta = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), k.alias("k"), h.alias("h"))
    meta = meta.groupBy("k", "h").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("rows"))
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    meta = stored(meta.withColumn("key", key), "mixing")
    rates = source_rates(meta, weights, budget)
    buckets = max(1, -(-meta.count() // BUCKET_ROWS))
    expected = F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("rows")
    spread = meta.join(rates, "key", "left").select(F.pmod(F.xxhash64("k", "h"), F.lit(buckets)).cast("int").alias("node"), "k", "h", "key", expected.alias("expected"))
    first = stored(spread.groupBy("node").applyInArrow(lambda t: rounded(t, seed), _PARTS), "rounded")
    ups = _resolve(first.where("residual > 0").select("node", "k", "h", "key", "residual"), buckets, seed)
    done = meta.join(first.select("k", "h", "expected", "copies"), ["k", "h"]).join(ups, ["k", "h"], "left")
    return done.select("k", "h", "id", "source", "rows", "expected", (F.col("copies") + F.coalesce("up", F.lit(0))).alias("copies"))


def _resolve(residuals: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``(k, h, up)`` of the residual documents, by the reduction tree: one a (bucket, source), so few."""
    done, level, width = [], 0, buckets
    now = residuals
    schema = "node int, k string, h bigint, key string, residual double, up int"
    while True:
        level += 1
        draw = seed + level
        root = width == 1  # the last step goes across sources
        width = -(-width // FAN_IN)

        def reduce(table: pa.Table) -> pa.Table:
            h = table.column("h").to_numpy().astype(np.int64)
            order = np.argsort(h, kind="stable")
            table, h = table.take(pa.array(order)), h[order]
            up, held, mass = pivot(h, table.column("residual").to_numpy(), draw)
            left = np.zeros(len(h))
            if held >= 0:
                left[held] = mass
            return pa.table({"node": table.column("node"), "k": table.column("k"), "h": pa.array(h), "key": table.column("key"), "residual": pa.array(left), "up": pa.array(up.astype(np.int32))})

        grouped = now.select((F.col("node") / F.lit(1 if root else FAN_IN)).cast("int").alias("node"), "k", "h", "key", "residual")
        # beside the node, the source is part of the key, but at the root
        keys = ["node"] if root else ["node", "key"]
        step = stored(grouped.groupBy(*keys).applyInArrow(reduce, schema), "residuals")
        done.append(step.where("residual = 0").select("k", "h", "up"))
        now = step.where("residual > 0")
        if root:
            # the whole mixture's last residual: rounded without bias
            draws = F.xxhash64("k", "h", F.lit(seed))
            done.append(now.select("k", "h", ((F.pmod(draws, F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("residual")).cast("int").alias("up")))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """The mixture: the rows of ``docs``, each as many times as ``copies`` says, with all their columns."""
    wanted = stored(_copies(docs, weights, budget, id_col, source_col, text_col, seed).where("copies > 0").select("k", "h", "copies", "rows"), "copies")
    repeated = not wanted.where("rows > 1").isEmpty()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column's name clashes
    k, h = keyed(docs, id_col)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], k.alias("k"), h.alias("h")).join(wanted, ["k", "h"])
    if repeated:  # rows that are equal in all columns: one of them stands for all
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k", "h").orderBy("rows"))).where("nth = 1")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mixture."""
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
