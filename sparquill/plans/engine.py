"""The engine as one object: transformers by name, an index on disk, and questions put to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions.code_tokens import tokenize
from ..operators import chunks, retrieval, splitters
from ..runtime import stored
from ..sources import files


@dataclass(frozen=True)
class Config:
    """Settings of the engine; ``with_value("bm25.k1", 1.5)`` gives a changed copy."""

    chunk_size: int = 256
    chunk_overlap: int = 0
    split_by: str = "word"
    dynamic_splitter: bool = False
    top_k: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.0
    weight: float = 0.5
    fusion: str = "normal_add"
    rrf_k: int = 60
    embedding: str = "hash"
    model: str = "extractive"
    neighbours: int = 1
    extensions: tuple[str, ...] = field(default=files.CODE_EXTENSIONS + files.TEXT_EXTENSIONS)

    def with_value(self, key: str, value) -> Config:
        return replace(self, **{key.replace(".", "_"): value})


class Engine:
    def __init__(self, spark: SparkSession, config: Config = Config()):
        self.spark, self.config = spark, config
        self.transformers: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.register("split", self._split)
        self.register("tokens", tokenize)
        self.register("embed", lambda c: c.withColumn("vec", providers.embed(F.col("text"), config.embedding)))
        self.register("split_embed", lambda d: self.transform(self.transform(d, "split"), "embed"))

    def register(self, name: str, transformer: Callable[[DataFrame], DataFrame]) -> None:
        self.transformers[name] = transformer

    def transform(self, docs: DataFrame, name: str) -> DataFrame:
        if name not in self.transformers:
            raise KeyError(f"no transformer {name!r}")
        return docs.transform(self.transformers[name])

    def _split(self, docs: DataFrame) -> DataFrame:
        c = self.config
        cut = splitters.split_dynamic(docs, c.chunk_size, c.chunk_overlap) if c.dynamic_splitter else chunks.split_chunks(docs, c.chunk_size, c.chunk_overlap, c.split_by)
        return chunks.link(cut)

    def build(self, path: str, to: str) -> None:
        """Scan a folder and write ``documents``, ``tokens`` and ``chunks`` with vectors under ``to``."""
        files.scan(self.spark, path, self.config.extensions).write.mode("overwrite").parquet(f"{to}/documents")
        docs = self.spark.read.parquet(f"{to}/documents")
        self.transform(docs, "tokens").write.mode("overwrite").parquet(f"{to}/tokens")
        self.transform(docs, "split_embed").write.mode("overwrite").parquet(f"{to}/chunks")

    def add(self, docs: DataFrame, to: str) -> None:
        """Append documents that the index hasn't got, with their tokens, chunks and vectors."""
        have = self.spark.read.parquet(f"{to}/documents").select("doc_id")
        new = stored(docs.dropDuplicates(["doc_id"]).join(have, "doc_id", "left_anti"), "added")
        self.transform(new, "tokens").write.mode("append").parquet(f"{to}/tokens")
        self.transform(new, "split_embed").write.mode("append").parquet(f"{to}/chunks")
        new.write.mode("append").parquet(f"{to}/documents")

    def retrieve(self, index: str, keywords: str = "", question: str = "") -> DataFrame:
        """Ranked chunks of an index: ``(query_id, doc_id, score, rank)`` with a numeric ``doc_id`` for a chunk.

        ``keywords`` are words or typed tokens, split at ``[TOKEN_SPLIT]``; without them the ranking is by vectors
        alone, without a question by words alone.
        """
        if not keywords and not question:
            raise ValueError("neither keywords nor a question")
        c = self.config
        rows = self.numbered(index)
        lexical = dense = None
        if keywords:
            typed = self.spark.read.parquet(f"{index}/tokens")
            spans = rows.select("doc_id", "ord", "start_line", "end_line", "chunk")
            owned = splitters.assign_tokens(spans, typed).join(spans, ["doc_id", "ord"])
            lists = owned.groupBy(F.col("chunk").alias("doc_id")).agg(F.collect_list("token").alias("tokens"))
            asked = self.spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.split(F.lit(keywords), r"\[TOKEN_SPLIT\]").alias("tokens"))
            lexical = retrieval.bm25(lists, asked, c.top_k, c.bm25_k1, c.bm25_b)
        if question:
            q = self.spark.range(1).select(F.col("id").alias("query_id"), providers.embed(F.lit(question), c.embedding).alias("vec"))
            dense = retrieval.knn(rows.select(F.col("chunk").alias("doc_id"), "vec"), q, c.top_k)
        if lexical is None or dense is None:
            return lexical if dense is None else dense
        return retrieval.fuse_rrf(lexical, dense, c.weight, c.rrf_k, c.top_k) if c.fusion == "rrf" else retrieval.fuse_add(lexical, dense, c.weight, c.top_k)

    def numbered(self, index: str) -> DataFrame:
        return self.spark.read.parquet(f"{index}/chunks").withColumn("chunk", F.xxhash64("chunk_id"))

    def answer(self, index: str, keywords: str, question: str) -> DataFrame:
        """``(prompt, response)`` from the best chunks with their neighbours."""
        rows = self.numbered(index)
        wide = chunks.context(rows, self.config.neighbours)
        best = self.retrieve(index, keywords, question).select(F.col("doc_id").alias("chunk"), "rank")
        paths = self.spark.read.parquet(f"{index}/documents").select("doc_id", "file_path")
        shown = wide.join(best, "chunk").join(paths, "doc_id")
        ctx = shown.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("file_path").alias("path"), F.col("context").alias("text")))), lambda s: F.struct(s["path"], s["text"])).alias("c"))
        out = ctx.select(providers.prompt(F.lit("Answer from the code."), F.col("c"), F.lit(question)).alias("prompt"))
        return out.select("prompt", providers.complete(F.col("prompt"), self.config.model).alias("response"))
