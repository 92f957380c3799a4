"""Sharding by a k-d tree over metadata.

A node whose documents take more than the target bytes is split along its widest dimension (extent over
the whole table's extent) at the weighted median of that dimension, weights being bytes; so on until every
leaf fits. Nodes of more than ``LOCAL_ROWS`` rows are split level by level, all nodes of a level together.
Their medians are found by histograms of value prefixes: each round sums bytes by (node, next bits), a
map-side combined aggregation, and goes on below the prefix where half of the node's bytes are reached,
until it is a single value. What is smaller is split to its leaves in one task of its own, a node at a time,
by the same rule. Medians are exact either way, no round sorts the rows, and texts are read once, for their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship, stored

TARGET_BYTES = 64 << 20
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")
#: Bits of a value that a round looks at.
ROUND_BITS = 12
#: A node of so many rows, or fewer, is split to its leaves by one task: about 6 MB of metadata.
LOCAL_ROWS = 1 << 17
#: Bytes of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the column ``name`` replaced by dense ranks from 0, by a distributed distinct and sort; null stays."""
    values = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct().orderBy("value")
    # the upper bits of this id are the partition's number, the lower ones the place in it
    values = stored(values.withColumn("at", F.monotonically_increasing_id()), "values")
    part = F.shiftright("at", 33)
    sizes = values.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("value").cast("string"))).alias("size"))
    counts = sorted((r.part, r.n, r.size) for r in sizes.collect())  # a row a partition
    firsts, total = [], 0
    for k, n, _ in counts:
        firsts.append((k, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(firsts, "part long, first long")
    ranks = values.join(F.broadcast(offsets), part == F.col("part")).select("value", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))
    joined = rows.join(_small(ranks, sum(c[2] + 16 * c[1] for c in counts)), F.col(name) == F.col("value"), "left")
    return joined.select(*[F.col("rank").alias(c) if c == name else F.col(c) for c in rows.columns])


_LEAST = -(1 << 63)


def _keys(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``(id, bytes, k0, k1, ...)``: dimensions as whole numbers. A null is one below the least value."""
    named = {f.name.lower(): f for f in docs.schema.fields}
    fields = [named[d.lower()] for d in dims]
    names = [f"k{i}" for i in range(len(fields))]
    ranked, exprs = [], []
    for f, n in zip(fields, names):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            exprs.append(c.cast("long").alias(n))
        elif isinstance(f.dataType, T.DateType):
            exprs.append(F.unix_date(c).cast("long").alias(n))
        elif isinstance(f.dataType, T.TimestampType):
            exprs.append(F.unix_micros(c).alias(n))
        else:
            ranked.append(n)
            exprs.append((F.when(F.isnan(c), F.lit(None)).otherwise(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c).alias(n))
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")).cast("long"), F.lit(0)).alias("bytes")
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), size, *exprs), "metadata")
    least = rows.agg(*[F.min(n).alias(n) for n in names if n not in ranked], F.lit(0).alias("none")).first().asDict()
    nulls = rows.agg(*[F.max(F.col(n).isNull()).alias(n) for n in names]).first().asDict()
    # where the least value has nothing below it, ranks take its place
    ranked += [n for n in names if n not in ranked and nulls[n] and least[n] == _LEAST]
    for n in ranked:
        rows = _ranked(rows, n)
        least[n] = 0
    filled = [F.coalesce(F.col(n), F.lit((least[n] or 0) - 1)).cast("long").alias(n) if nulls[n] else F.col(n).cast("long").alias(n) for n in names]
    rows = rows.select("id", "bytes", *filled)
    return (stored(rows, "metadata") if ranked else rows), names


def split_rows(size: np.ndarray, keys: np.ndarray, spans: list[float], target: int, node: str) -> np.ndarray:
    """Leaf paths of rows: ``keys`` has a row a dimension."""
    out = np.full(len(size), node, dtype=object)
    todo = [(np.arange(len(size)), node)]
    while todo:
        rows, path = todo.pop()
        out[rows] = path
        if int(size[rows].sum()) <= target:
            continue
        own = keys[:, rows]
        extent = (own.max(1).astype(np.float64) - own.min(1).astype(np.float64)) / np.array(spans)
        dim = int(extent.argmax())
        if not extent[dim] > 0:
            continue
        v = own[dim]
        order = np.argsort(v, kind="stable")
        run = np.cumsum(size[rows][order])
        cut = v[order[int(np.searchsorted(2 * run, run[-1]))]]
        right = (v > cut) | ((cut == v.max()) & (v == cut))
        todo += [(rows[~right], path + "0"), (rows[right], path + "1")]
    return out


def kd_shards(docs: DataFrame, target_bytes: int = TARGET_BYTES, dims: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, bytes, shard, shard_bytes)`` of every row; ``shard`` is the leaf's path: "1" the root, then 0 or 1 for either half.

    The median goes left, with all that equals it; if nothing were right of it, it goes right. Whole numbers, dates
    and times go by their values, strings and fractions by the ranks of their distinct values (NaN is taken for
    null). A null in a dimension comes before all values. Rows equal in all dimensions can't be parted: their leaf may
    exceed the target, and so may a single long document. Ties for the widest dimension go to the first named. A
    null text has 0 bytes. Repeated rows, and rows with a null id, are rows like any other. An empty table gives no
    row. Only the named columns are looked at, whatever the others' names.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, names = _keys(docs, dims, id_col, text_col)
    ends = rows.agg(*[F.min(n).alias("l" + n) for n in names], *[F.max(n).alias("h" + n) for n in names]).first()
    spans = [max(1.0, float(ends["h" + n] or 0) - float(ends["l" + n] or 0)) for n in names]
    rows = rows.withColumn("node", F.lit("1"))
    settled, local = [], []
    while True:
        stats = rows.groupBy("node").agg(F.count("*").alias("rows"), F.sum("bytes").alias("total"), *[F.min(n).alias("l" + n) for n in names], *[F.max(n).alias("h" + n) for n in names])
        extent = [(F.col("h" + n).cast("double") - F.col("l" + n).cast("double")) / F.lit(s) for n, s in zip(names, spans)]
        widest = F.greatest(*extent) if len(extent) > 1 else extent[0]
        dim = F.coalesce(*[F.when(e == widest, F.lit(k + 1)) for k, e in enumerate(extent)])
        leaf = (F.col("total") <= target_bytes) | ~(widest > 0)
        kind = F.when(leaf, 0).when(F.col("rows") <= LOCAL_ROWS, 1).otherwise(2).alias("kind")
        state = stored(stats.select("node", kind, "total", dim.alias("dim"), F.element_at(F.array(*["l" + n for n in names]), dim).alias("low"), F.element_at(F.array(*["h" + n for n in names]), dim).alias("high")), "nodes")
        counts = {r.kind: r["count"] for r in state.groupBy("kind").count().collect()}
        size = 64 * sum(counts.values())
        marked = rows.join(_small(state.select("node", "kind"), size), "node")
        if counts.get(0):
            settled.append(marked.where("kind = 0").drop("kind"))
        if counts.get(1):
            local.append(marked.where("kind = 1").drop("kind"))
        if not counts.get(2):
            break
        rows = _level(rows, state.where("kind = 2").drop("kind"), names, size)
    parts = [s.select("id", "bytes", F.col("node").alias("shard")) for s in settled]
    target, schema = int(target_bytes), T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("bytes", T.LongType()), T.StructField("shard", T.StringType())])

    def down(table: pa.Table) -> pa.Table:
        keys = np.stack([table.column(n).to_numpy().astype(np.int64) for n in names])
        size = table.column("bytes").to_numpy().astype(np.int64)
        return pa.table({"id": table.column("id"), "bytes": pa.array(size), "shard": pa.array(split_rows(size, keys, spans, target, table.column("node")[0].as_py()), pa.string())})

    for part in local:
        parts.append(part.groupBy("node").applyInArrow(down, schema))
    if not parts:  # an empty table
        parts = [rows.select("id", "bytes", F.col("node").alias("shard"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stored(out, "shards")
    totals = stored(out.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes")), "totals")
    return out.join(_small(totals, 64 * totals.count()), "shard").select(F.col("id").alias(id_col), "bytes", "shard", "shard_bytes")


def _level(rows: DataFrame, state: DataFrame, names: list[str], size: int) -> DataFrame:
    """The rows of the nodes in ``state``, in the halves that the weighted median makes of each."""
    value = F.element_at(F.array(*names), F.col("dim"))
    # as unsigned, so that the order of the bits is that of the values
    flip = lambda c: c.bitwiseXOR(F.lit(_LEAST))
    bits = F.length(F.bin(F.col("low").bitwiseXOR(F.col("high"))))
    shift = F.greatest(bits - ROUND_BITS, F.lit(0))
    # of a value, the bits from ``shift`` up are looked at in a round, among values that share the bits from ``above`` up
    above = F.when(bits >= 64, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(low ^ {_LEAST}L, cast(length(bin(low ^ high)) AS int))"))
    state = state.select("node", "dim", "total", "high", F.lit(0).cast("long").alias("before"), bits.alias("above"), above.alias("prefix"), shift.alias("shift"))
    rows = rows.join(_small(state.select("node", "dim"), size), "node").withColumn("x", flip(value)).drop("dim")
    while True:
        state = stored(state, "nodes")
        inside = rows.select("node", "x", "bytes").join(_small(state.select("node", "above", "prefix", "shift"), size), "node")
        inside = inside.where("above >= 64 OR shiftrightunsigned(x, above) = prefix")
        bins = inside.groupBy("node", F.expr("shiftrightunsigned(x, shift)").alias("bin")).agg(F.sum("bytes").alias("w"))
        run = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        # at most 2 ** ROUND_BITS bins a node; without a sign bit, as the shift is above 0, or the order is that of a whole 64 bits
        reached = bins.join(_small(state, size), "node").withColumn("sum", F.col("before") + run).where("2 * sum >= total")
        first = reached.groupBy("node").agg(F.min_by(F.struct("dim", "total", "high", F.col("shift").alias("above"), F.col("bin").alias("prefix"), (F.col("sum") - F.col("w")).alias("before"), F.greatest(F.col("shift") - ROUND_BITS, F.lit(0)).alias("shift")), "bin").alias("s"))
        state = stored(first.select("node", "s.*"), "nodes")
        if state.where("above > 0").isEmpty():
            break
    cuts = state.select("node", "dim", flip(F.col("prefix")).alias("cut"), (flip(F.col("prefix")) == F.col("high")).alias("top"))
    moved = rows.drop("x").join(_small(cuts, size), "node")
    right = (value > F.col("cut")) | (F.col("top") & (value == F.col("cut")))
    return stored(moved.select("id", "bytes", *names, F.concat("node", F.when(right, "1").otherwise("0")).alias("node")), "metadata")


def write_shards(docs: DataFrame, path: str, target_bytes: int = TARGET_BYTES, dims: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, a folder a shard. Rows that share an id, null among them, go with one shard."""
    shards = kd_shards(docs, target_bytes, dims, id_col, text_col).groupBy(F.col(id_col).alias("__id")).agg(F.min("shard").alias("__shard"))
    joined = docs.join(shards, docs[id_col].eqNullSafe(shards["__id"])).drop("__id", "shard").withColumnRenamed("__shard", "shard")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) AS k0, dense_rank() OVER (ORDER BY source NULLS FIRST) AS k1,
    coalesce(n_chars, (SELECT min(n_chars) FROM documents) - 1) AS k2, coalesce(doc_id, (SELECT min(doc_id) FROM documents) - 1) AS k3
  FROM documents),
spans AS (SELECT {", ".join(f"greatest(max(k{i})::DOUBLE - min(k{i})::DOUBLE, 1.0) AS s{i}" for i in range(4))} FROM base),
tree(doc_id, bytes, k0, k1, k2, k3, shard) AS (
  SELECT doc_id, bytes, k0, k1, k2, k3, '1' FROM base
  UNION ALL
  SELECT doc_id, bytes, k0, k1, k2, k3, shard || CASE WHEN v > cut OR (cut = top AND v = cut) THEN '1' ELSE '0' END FROM (
    SELECT *, min(CASE WHEN 2 * run >= total THEN v END) OVER (PARTITION BY shard) AS cut, max(v) OVER (PARTITION BY shard) AS top FROM (
      SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY v) AS run FROM (
        SELECT *, CASE greatest(e0, e1, e2, e3) WHEN e0 THEN k0 WHEN e1 THEN k1 WHEN e2 THEN k2 ELSE k3 END AS v FROM (
          SELECT tree.*, sum(bytes) OVER n AS total, {", ".join(f"(max(k{i}) OVER n::DOUBLE - min(k{i}) OVER n::DOUBLE) / s{i} AS e{i}" for i in range(4))}
          FROM tree, spans WINDOW n AS (PARTITION BY shard))
        WHERE total > {TARGET_BYTES} AND greatest(e0, e1, e2, e3) > 0)))),
leaves AS (SELECT doc_id, any_value(bytes) AS bytes, arg_max(shard, length(shard)) AS shard FROM tree GROUP BY doc_id)
SELECT doc_id, bytes, shard, sum(bytes) OVER (PARTITION BY shard)::BIGINT AS shard_bytes FROM leaves
"""
