"""Fixed-size chunks of documents, their links, and the context around a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = {"word": " ", "sentence": ".", "passage": "\n\n", "page": "\f", "token": ""}


def units(text: F.Column, split_by: str = "word") -> F.Column:
    """The text cut at the separator, without an empty unit at its end."""
    sep = SEPARATORS[split_by]
    if not sep:
        return F.filter(F.split(text, "", -1), lambda u: u != "")
    parts = F.split(text, "\\Q" + sep + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_chunks(docs: DataFrame, size: int = 256, overlap: int = 0, split_by: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ord, n_units, text, start_line, end_line)``: windows of ``size`` units, each ``size - overlap`` after the last.

    The last window takes what is left. Lines are numbered from 0. A null or empty text has no chunk. It is one
    pass over the rows: windows are slices of an array, so nothing is shuffled.
    """
    step = size - overlap if size > overlap else size
    sep = SEPARATORS[split_by]
    cut = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), units(F.col(text_col), split_by).alias("u")).where(F.size("u") > 0)
    # a window starts at 0, step, ... until one reaches the end; lines before it are summed a step at a time
    last = F.greatest(F.ceil((F.size("u") - size) / F.lit(step)), F.lit(0)).cast("int")
    breaks = F.transform("u", lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + sep.count("\n"))
    rows = cut.select("doc_id", "u", breaks.alias("b"), F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")).alias("k"))
    lines = F.aggregate("k", F.array(F.lit(0)), lambda s, k: F.array_append(s, F.element_at(s, -1) + F.aggregate(F.slice(F.col("b"), (k - 1) * step + 1, F.lit(step)), F.lit(0), lambda n, x: n + x)))
    # windows are cut before rows are made of them: the units of a document aren't copied for each of its chunks
    windows = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.slice(F.col("u"), i * step + 1, F.lit(size)).alias("w")))
    joined = F.transform(windows, lambda s: F.struct(s["line"].alias("line"), F.size(s["w"]).alias("n"), F.array_join(s["w"], sep).alias("text")))
    rows = rows.select("doc_id", F.posexplode(joined).alias("ord", "c"))
    rows = rows.select("doc_id", "ord", F.col("c.n").alias("n_units"), F.col("c.text").alias("text"), F.col("c.line").alias("start_line"))
    inner = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return rows.withColumn("end_line", (F.col("start_line") + inner).cast("int"))


def link(chunks: DataFrame) -> DataFrame:
    """Add ``chunk_id``, ``prev_id`` and ``next_id``."""
    by = Window.partitionBy("doc_id").orderBy("ord")
    named = chunks.withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")))
    return named.withColumn("prev_id", F.lag("chunk_id").over(by)).withColumn("next_id", F.lead("chunk_id").over(by))


def context(chunks: DataFrame, count: int = 1, direction: str = "both") -> DataFrame:
    """Add ``context``, the chunk with up to ``count`` neighbours, and ``cannot_extend``, whether there are no more."""
    if direction not in ("both", "previous", "next"):
        raise ValueError(f"direction is {direction!r}")
    before = count if direction in ("both", "previous") else 0
    after = count if direction in ("both", "next") else 0
    by = Window.partitionBy("doc_id").orderBy("ord")
    whole = Window.partitionBy("doc_id")
    first, last = F.min("ord").over(whole), F.max("ord").over(whole)
    at_start, at_end = F.col("ord") - count <= first, F.col("ord") + count >= last
    done = {"both": at_start & at_end, "previous": at_start, "next": at_end}[direction]
    near = F.collect_list("text").over(by.rowsBetween(-before, after))
    return chunks.withColumn("context", F.array_join(near, "")).withColumn("cannot_extend", done)


def chunk_at_line(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Each ``(doc_id, line)`` with the chunks whose lines contain it: an equi-join on the document with a range on top."""
    return lines.join(chunks, "doc_id").where("line BETWEEN start_line AND end_line")


def first_chunk(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.min_by("chunk_id", "ord").alias("first_id"))
