"""Where results go: score listings, chains, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_scores(scores: DataFrame, path: str, by: str = "score") -> None:
    """CSV with a header, best score first; range-partitioned, so the files are in order without one task sorting all."""
    scores.orderBy(F.desc(by), "doc_id").write.option("header", True).csv(path)


def write_chains(rendered: DataFrame, path: str) -> None:
    rendered.select(F.col("chain").alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("chain")).where("chain <> ''").distinct()


def write_answer(answer: DataFrame, path: str) -> None:
    """Responses with their prompts and contexts as JSON lines."""
    answer.write.json(path)


def previews(docs: DataFrame, n: int = 200) -> DataFrame:
    return docs.select("doc_id", F.substring("text", 1, n).alias("preview"))


def write_rankings(path: str, **rankings: DataFrame) -> None:
    """A CSV folder for each ranking, best score first: ``write_rankings(p, bm25=a, dense=b, sum=c, rrf=d)``."""
    for name, scores in rankings.items():
        write_scores(scores, f"{path}/{name}_scores.csv")


def write_report(path: str, prompt: DataFrame, response: DataFrame, retrieved: DataFrame, context: DataFrame, lexical: DataFrame, metadata: DataFrame) -> None:
    """What a question gave, a folder each: prompt and response as text, the retrieved rows, context, lexical hits and metadata as JSON lines."""
    prompt.select(F.col("prompt").alias("value")).write.text(f"{path}/prompt")
    response.select(F.col("response").alias("value")).write.text(f"{path}/response")
    for name, rows in (("retrieved_documents", retrieved), ("context", context), ("bm25_retrieved", lexical), ("metadata", metadata)):
        rows.write.json(f"{path}/{name}")


def write_edges(edges: DataFrame, path: str) -> None:
    """A tree or forest of calls as Parquet, ``(root, caller, callee)``."""
    edges.select("root", "caller", "callee").write.parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("root", "caller", "callee")


def audit(rows: DataFrame, path: str) -> None:
    """Append prompts and responses to the audit table."""
    rows.write.mode("append").parquet(path)
