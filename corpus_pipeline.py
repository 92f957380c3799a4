"""A corpus made ready for training: rules, classifier, near-duplicates, mixture, token ids.

All stages keep the columns of their input, whatever their names, but the last one, which has the ids in place of
the text. Each takes null and repeated ids, ids of any type, and an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import bpe, mixing, quality, simhash
from sparquill.runtime import remove, scratch, shared_dir, table


def _kept(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; no column of ``docs`` meets one that it adds."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    judged = judge(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names["text"])
    return judged.where("keep").select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose content share is high enough. A text that is null or blank has none, so it goes; repeated rows stay or go alike."""
    model = quality.train_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d, text: quality.quality_rules(d, model, text))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold. A text that is null or blank has none, so it goes; repeated rows stay or go alike."""
    model = quality.train_ranker(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d, text: quality.quality_classifier(d, model, text))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id. Texts that are null or without a word all stay."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target weight asks for. A null source is a source; a null text is rounded like others."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_chars, token_ids, n_tokens)`` of each row. A null text has null ids, an empty one none."""
    return bpe.encode(docs.select("doc_id", "text", "lang", "source", "n_chars")).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses none of the models and roundings; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again, and deleted when the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    return docs
